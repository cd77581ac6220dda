"""Time-hierarchy aggregation: mergeable partials at the finest duration, merged upward."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import duration_ms
from tidewright.lang.lexer import DialectError

#: The durations from the finest to the coarsest.
LADDER = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR")


def durations(names: tuple[str, ...]) -> list[str]:
    """``(SEC, ..., YEAR)`` is a range without weeks; others are a list."""
    full = {n[:3]: n for n in LADDER}
    known = [x if x == "..." else full.get(x[:3].upper(), x.upper()) for x in names]
    if "..." in known:
        a, b = LADDER.index(known[0]), LADDER.index(known[-1])
        return [x for x in LADDER[a : b + 1] if x != "WEEK" or "WEEK" in known]
    return sorted(known, key=duration_ms)


@dataclass
class Rollup:
    """Partials by duration; ``aggregates`` maps an output name to (function, input column)."""

    base: DataFrame
    keys: list[str]
    aggregates: dict[str, tuple[str, str | None]]
    levels: list[str]

    def _partials(self, df: DataFrame, ms: int) -> DataFrame:
        made: list[Column] = []
        for name, (f, c) in self.aggregates.items():
            x = F.col(c) if c else F.lit(1)
            if f in ("sum", "avg", "stddev"):
                made.append(F.sum(x.cast("double") if f != "sum" else x).alias(f"{name}$sum"))
            if f in ("avg", "count", "stddev"):
                made.append(F.count(x).alias(f"{name}$count"))
            if f == "stddev":
                made.append((F.var_pop(x.cast("double")) * F.count(x)).alias(f"{name}$m2"))
            if f in ("min", "max"):
                made.append(getattr(F, f)(x).alias(f"{name}${f}"))
            if f not in ("sum", "avg", "count", "stddev", "min", "max"):
                raise DialectError(f"{f} has no mergeable partial")
        return df.groupBy((F.col("_ts") - F.pmod(F.col("_ts"), F.lit(ms))).alias("AGG_TIMESTAMP"), *self.keys).agg(*made)

    def partials(self, level: str) -> DataFrame:
        """From the finest level; a coarser one merges partials and reads no event again, unless its width is no multiple."""
        out = self._partials(self.base, duration_ms(self.levels[0]))
        if level == self.levels[0]:
            return out
        ms = duration_ms(level)
        merge = [(F.min if c.endswith("$min") else F.max if c.endswith("$max") else F.sum)(c).alias(c) for c in out.columns if "$" in c]
        if ms % duration_ms(self.levels[0]):
            return self._partials(self.base, ms)
        t = F.col("AGG_TIMESTAMP")
        out = out.withColumn("AGG_TIMESTAMP", t - F.pmod(t, F.lit(ms)))
        # Squares about a part's own mean become squares about the whole's; sums of plain squares would lose digits. One exchange serves the mean and the sums.
        w = Window.partitionBy("AGG_TIMESTAMP", *self.keys)
        for name in (n for n, (f, _) in self.aggregates.items() if f == "stddev"):
            total, count = F.col(f"`{name}$sum`"), F.col(f"`{name}$count`")
            off = F.try_divide(total, count) - F.try_divide(F.sum(total).over(w), F.sum(count).over(w))
            out = out.withColumn(f"{name}$m2", F.col(f"`{name}$m2`") + count * off * off)
        return out.groupBy("AGG_TIMESTAMP", *self.keys).agg(*merge)

    def query(self, per: str, within: tuple[int, int] | None = None) -> DataFrame:
        """The values of one duration, of buckets that start in ``within`` (the end excluded)."""
        level = durations((per,))[0]
        if level not in self.levels:
            raise DialectError(f"no {per} in {self.levels}")
        df = self.partials(level)
        if within:
            df = df.where((F.col("AGG_TIMESTAMP") >= within[0]) & (F.col("AGG_TIMESTAMP") < within[1]))
        out = []
        for name, (f, _) in self.aggregates.items():
            part = lambda p, name=name: F.col(f"`{name}${p}`")
            if f == "avg":
                c = F.try_divide(part("sum"), part("count"))
            elif f == "stddev":
                c = F.sqrt(F.try_divide(part("m2"), part("count")))
            else:
                c = part(f)
            out.append(c.alias(name))
        return df.select("AGG_TIMESTAMP", *self.keys, *out)
