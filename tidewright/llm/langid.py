"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fresh, map_batches, text_or_empty

UNKNOWN = "und"
#: Symbols: 0 stands between words, 1 for any letter that no sample has.
SPACE, OTHER = 0, 1
#: Symbols after which a parse starts anew; 0: never, a phrase may stand anywhere in a text.
BLOCK = 0
#: Symbols that are parsed in lockstep, and the commonest symbols of a language that get columns in its table.
LANE, DENSE = 256, 64


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of other characters than letters as one 32."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, 32)
    blank = points == 32
    return points[~(blank & np.concatenate([[False], blank[:-1]]))] if len(points) else points


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


class Automaton:
    """The suffix automaton of a text over symbols, for greedy longest-match parses.

    The ``DENSE`` - 1 commonest symbols have columns in a table of all states,
    the others sorted keys. ``step[state * DENSE + column]`` is twice the next
    state's row, plus one if the symbol starts a phrase: it can't go on from
    here. A symbol that the text lacks is a phrase of its own and leads to
    ``start``, the state from which every symbol starts one.
    """

    def __init__(self, symbols: list[int], width: int):
        nexts, link, length = [{}], [-1], [0]
        last = 0
        for s in symbols:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in nexts[p]:
                nexts[p][s] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][s]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(s) == q:
                        nexts[p][s] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
        ranked = [s for s, _ in sorted(Counter(symbols).items(), key=lambda x: (-x[1], x[0]))]
        self.size, self.start = len(symbols), len(nexts) * DENSE
        self.column = np.full(width, DENSE - 1, np.int32)  # of a symbol; the last one is of symbols that the text lacks
        for column, s in enumerate(ranked):
            self.column[s] = column if column < DENSE - 1 else column + 1
        fail = np.full(len(ranked) + 2, self.start * 2 + 1, np.int32)
        fail[self.column[ranked]] = [nexts[0][s] * DENSE * 2 + 1 for s in ranked]
        table = np.tile(fail[:DENSE] if len(fail) >= DENSE else np.pad(fail, (0, DENSE - len(fail)), constant_values=self.start * 2 + 1), (len(nexts) + 1, 1))
        keys, values = [], []
        own = self.column.tolist()
        for state, out in enumerate(nexts):
            for s, to in out.items():
                if own[s] < DENSE:
                    table[state, own[s]] = to * DENSE * 2
                else:
                    keys.append((state * DENSE << 32) | own[s])
                    values.append(to * DENSE * 2)
        self.step = np.ascontiguousarray(table, np.int32).ravel()
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values, self.fail = np.array(keys, np.int64)[order], np.array(values, np.int32)[order], fail

    def go(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """What ``step`` holds for each state and column."""
        if not len(self.keys):
            return self.step.take(state + column)
        v = self.step.take(state + np.minimum(column, DENSE - 1))
        rare = np.nonzero(column >= DENSE)[0]
        if len(rare):
            key = (state[rare].astype(np.int64) << 32) | column[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            v[rare] = np.where(self.keys[at] == key, self.values[at], self.fail[column[rare]])
        return v

    def phrases(self, lanes: np.ndarray, used: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The phrases that start in each row of symbols, of which the first ``used`` count; rows by falling ``used``.

        ``follows`` is the row that a row goes on from, or -1. All rows are
        parsed at once from ``start``; then those whose text goes on from
        another state are parsed again, until they meet the states of before,
        which takes a few phrases, and so on until no row ends otherwise.
        """
        n, length = lanes.shape
        seen = np.zeros((length, n), np.int32)
        state = np.full(n, self.start, np.int32)
        for t in range(length):
            k = int(np.searchsorted(-used, -t, side="left"))  # rows with a symbol here
            if not k:
                break
            seen[t, :k] = v = self.go(state[:k], self.column.take(lanes[:k, t]))
            state[:k] = v >> 1
        entry, goes_on = np.full(n, self.start, np.int32), follows >= 0
        while True:
            now = np.where(goes_on, state[follows], self.start)
            todo = np.nonzero(now != entry)[0]
            if not len(todo):
                return (seen & 1).sum(0)
            entry[todo] = at = now[todo]
            for t in range(length + 1):
                live = used[todo] > t
                if not live.all():  # these end in another state than before
                    state[todo[~live]] = at[~live]
                    todo, at = todo[live], at[live]
                if not len(todo):
                    break
                v = self.go(at, self.column.take(lanes[todo, t]))
                new = (v >> 1) != (seen[t, todo] >> 1)
                seen[t, todo] = v
                todo, at = todo[new], v[new] >> 1


class Parser:
    """Counts phrases against the automaton of every language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        held = {x: letters(samples[x]) for x in self.languages}
        known = np.unique(np.concatenate([np.array([32], np.uint32), *held.values()]))
        known = known[known != 32]
        self.symbol = np.full(0x110000, OTHER, np.int32)
        self.symbol[32] = SPACE
        self.symbol[known] = np.arange(2, len(known) + 2)
        self.automata = [Automaton(self.symbol[held[x]].tolist(), len(known) + 2) for x in self.languages]
        #: Bits that name a phrase: its place in the sample.
        self.bits = np.log2([a.size + 2 for a in self.automata])

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each language: the phrases of the whole text; a row of zeros without a letter."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        start, held, size = 0, [], 0
        for i, t in enumerate(texts):
            points = letters(t)
            held.append(self.symbol[points] if (points != 32).any() else points[:0].astype(np.int32))
            size += len(points)
            if size > 1 << 21 or i == len(texts) - 1:
                out[start : i + 1] = self._count(held)
                start, held, size = i + 1, [], 0
        return out

    def _count(self, texts: list[np.ndarray]) -> np.ndarray:
        lane = BLOCK or LANE
        rows = np.array([-(-len(t) // lane) for t in texts])
        owner = np.repeat(np.arange(len(texts)), rows)
        lanes, used = np.zeros((len(owner), lane), np.int32), np.full(len(owner), lane)
        flat, at = lanes.reshape(-1), 0
        for t, r in zip(texts, rows.tolist()):
            flat[at * lane : at * lane + len(t)] = t
            if r:
                used[at + r - 1] = len(t) - (r - 1) * lane
            at += r
        order = np.argsort(-used, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.full(len(order), -1)
        if not BLOCK:
            inner = np.nonzero(owner[1:] == owner[:-1])[0] + 1
            follows[place[inner]] = place[inner - 1]
        columns, used = np.asfortranarray(lanes[order]), used[order]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, a in enumerate(self.automata):
            np.add.at(out[:, k], owner[order], a.phrases(columns, used, follows))
        return out

    def best(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language whose phrases need the fewest bits (of equal ones the first by name) and its share of the inverse costs."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = self.counts(texts)
        bits = counts * self.bits
        inverse = 1 / np.maximum(bits, 1) ** 4.0
        score = inverse.max(1) / inverse.sum(1)
        return [(self.languages[k], float(s)) if c else (UNKNOWN, 0.0) for k, s, c in zip(bits.argmin(1).tolist(), score.tolist(), counts.max(1).tolist())]


def training_text(rows: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, max_chars: int) -> dict[str, str]:
    """Per language, a piece of each of the ``max_docs`` rows with the smallest hash of (id, text); ``max_chars`` characters together at most.

    Every text is cut into pieces of ``max_chars / max_docs``, and a hash says
    which of them a row gives, so any part of any text may be in the sample.
    A first pass counts the rows of each language; by that number the second
    keeps a few times the rows that are needed, and the driver the smallest.
    """
    size = max(1, max_chars // max_docs - 1)
    base = rows.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    total = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not total:
        return {}
    of = F.create_map(*(F.lit(x) for pair in sorted(total.items()) for x in pair))
    place = F.pmod(F.xxhash64("h"), F.ceil(F.length("t") / size)).cast("int")
    some = base.where(F.pmod("h", of[F.col("lang")]) < 4 * max_docs).select("lang", "h", F.substr("t", place * size + 1, F.lit(size)).alias("t"))
    held: dict[str, set] = {}
    for r in some.collect():
        held.setdefault(r["lang"], set()).add((r["h"], r["t"]))
    return {lang: " ".join(t for _, t in sorted(found)[:max_docs]) for lang, found in held.items()}


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and a score from 0 to 1.

    A text becomes lower-case letters, with one space for each run of anything
    else. Greedy longest matches with the sample of a language cut all of it
    into phrases; a letter that the sample lacks is a phrase. The language
    wins whose phrases, times the bits that name a place in its sample, cost
    least. Null texts and texts without a letter are ``und`` with score 0, as
    is everything without samples. An empty table gives no rows; repeated rows
    stay rows; columns of these names are replaced, all others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(dict(samples))  # max_chars for each language
    rest = [c for c in docs.columns if c not in (lang_col, score_col)]
    rows = docs.select(*rest, text_or_empty(text_col).alias(fresh(rest, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(tuple(sorted(held.value.items())))
        for b in batches:
            found = parser.best([t or "" for t in b.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*rest, lang_col, score_col])

    from pyspark.sql import types as T

    return map_batches(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


@lru_cache(maxsize=1)
def _parser(samples: tuple) -> Parser:
    return Parser(dict(samples))


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def language_digest(docs: DataFrame, max_docs: int = 100, max_chars: int = 30_000) -> DataFrame:
    """One row per document. Samples come from rows outside the held-out ones, by a language and a text; null and empty texts are ``und``, a null id is never held out."""
    out = held_out("doc_id", 4, 2)
    samples = training_text(docs.where(~out), "doc_id", "text", "lang", max_docs, max_chars)
    return identify(docs.select("doc_id", "text", out.alias("held_out")), samples).select("doc_id", "held_out", "lang_pred", "score")
