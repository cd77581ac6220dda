"""Steps whose work must not grow faster than their input: plans, and results against naive loops."""

from __future__ import annotations

import pytest

from tests.test_simulator import bound, events, some


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def timed(seed: int):
    """Distinct times, so that the order of two streams' events is that of the rows."""
    return [(i, t * 1000 + i, kind, k, v) for i, t, kind, k, v in events(seed)]


def pairs(rows, a, b, one_way=False):
    """Joins A and B on A's value below B's while the earlier is among the last ``a`` of A or ``b`` of B; each with whether B came first."""
    out, held = [], {"A": [], "B": []}
    for r in rows:
        if r[2] not in held:
            continue
        other, n = ("B", b) if r[2] == "A" else ("A", a)
        for x in held[other][-n:] if n else held[other]:
            left, right = (r, x) if r[2] == "A" else (x, r)
            if left[4] is not None and right[4] is not None and left[4] < right[4] and not (one_way and r[2] == "B"):
                out.append((left[0], right[0], r[2] == "A"))
        held[r[2]].append(r)
    return out


@pytest.mark.parametrize(("how", "outer", "one_way"), [("JOIN", "eager", False), ("JOIN", "eager", True), ("LEFT JOIN", "eager", False), ("FULL OUTER JOIN", "final", False)])
def test_f1_length_windows_join_by_bands(spark, how, outer, one_way):
    rows = timed(21)
    out = bound(spark, rows, outer=outer).run(f"INSERT INTO o SELECT x.id AS l, y.id AS r FROM A AS x WINDOW('length', 5) {'UNIDIRECTIONAL ' * one_way}{how} B AS y WINDOW('length', 3) ON x.v < y.v")["o"]
    if how == "JOIN":
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    found = pairs(rows, 5, 3, one_way)
    want = [(a, b) for a, b, _ in found]
    if how != "JOIN":
        met = {a for a, _, later in found if later or outer == "final"}
        want += [(r[0], None) for r in rows if r[2] == "A" and r[0] not in met]
    if "FULL" in how:
        want += [(None, r[0]) for r in rows if r[2] == "B" and r[0] not in {b for _, b, _ in found}]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize(("name", "text"), [("pt_every", "EVERY(e1=A -> e2=B -> e3=C)"), ("pt_once", "e1=A -> e2=B -> e3=C"), ("pt_within_events", "EVERY(e1=A -> e2=B) WITHIN 3 EVENTS")])
def test_f2_f3_f7_next_pointers_take_no_shrinking_frames(spark, name, text):
    ids = "e1.id AS a, e2.id AS b" + ", e3.id AS c" * ("e3" in text)
    e = bound(spark, timed(22))
    for q in (f"INSERT INTO o SELECT {ids} FROM PATTERN ({text})", f"PARTITION WITH (k OF A, k OF B, k OF C) BEGIN INSERT INTO o SELECT {ids} FROM PATTERN ({text}); END"):
        assert "unboundedfollowing" not in plan(e.run(q)["o"])


def test_f4_f5_numbers_as_times_are_dealt_to_many_tasks(spark, monkeypatch):
    """Dense ids as a stream's time: no task numbers most of them, and numbers are dense and in order."""
    from pyspark.sql import functions as F

    from tidewright.operators import order

    monkeypatch.setattr(order, "IDS", 100, raising=False)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        df = order.ordered(spark.range(40_000).select("id", (F.col("id") + 1_000).alias("t")), "t", ["id"])
        rows = df.select("id", order.SEQ, F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset(coalesce)
    assert all(r.id == r[order.SEQ] for r in rows)
    assert max(sum(r.p == p for r in rows) for p in {r.p for r in rows}) < 20_000


def test_f8_rows_whose_number_nobody_reads_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from tidewright.runner import Runner

    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    small = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(small, "-1")  # as if the table of offsets were not known to be small
    try:
        out = Runner(spark).stream("s", rows, "ts", ["id"]).run("INSERT INTO o SELECT id, uuid() AS u FROM s")["o"]
        assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)
        assert out.select("u").distinct().count() == 100
    finally:
        spark.conf.unset(small)


def test_f6_f10_f11_time_windows_take_only_growing_frames(spark):
    """Counts, sums, means and bounds over a time, with nulls, ties, groups, a partition and a window's own column, as naive loops have them."""
    rows = events(23, ties=True)
    aggs = "count(*) AS n, count(v) AS c, sum(v) AS s, avg(v) AS a, min(v) AS lo, max(v) AS hi"
    part = "PARTITION WITH (k OF s) BEGIN {q}; END"
    for ms, group, text in (
        (5_000, None, f"INSERT INTO o SELECT id, {aggs} FROM s WINDOW('time', 5 SECONDS)"),
        (700, 2, f"INSERT INTO o SELECT id, {aggs} FROM s WINDOW('time', 700 MS) GROUP BY kind"),
        (9, None, f"INSERT INTO o SELECT id, {aggs} FROM s WINDOW('externalTime', id, 9)"),
        (9_000, 3, part.format(q=f"INSERT INTO o SELECT id, {aggs} FROM s WINDOW('time', 9 SECONDS)")),
    ):
        out, at = bound(spark, rows).run(text)["o"], 0 if "external" in text else 1
        shown = plan(out)
        assert f"-{ms - 1}, currentrow" not in shown and "RangeFrame" in shown
        want = []
        for r in rows:  # events of one time are in each other's frames
            win = [x for x in rows if r[at] - ms < x[at] <= r[at] and (group is None or x[group] == r[group])]
            v = some(x[4] for x in win)
            want.append((r[0], len(win), len(v), float(sum(v)), sum(v) / len(v) if v else None, min(v, default=None), max(v, default=None)))
        assert [tuple(r) for r in out.orderBy("id").collect()] == [(*w[:4], w[4] and pytest.approx(w[4]), *w[5:]) for w in want]


def test_f9_a_large_key_is_numbered_and_framed_in_chunks(spark, monkeypatch):
    from tidewright.operators import order, windows

    monkeypatch.setattr(order, "RUN", 16)
    monkeypatch.setattr(windows, "CHUNK", 8)
    rows = events(24)
    out = bound(spark, rows).run("PARTITION WITH (CASE WHEN v < 9 THEN 'lo' WHEN v < 99 THEN 'hi' END OF s) BEGIN INSERT INTO o SELECT id, sum(id) AS s FROM s WINDOW('length', 5); END")["o"]
    held, want = {}, {}
    for r in rows:
        key = None if r[4] is None else r[4] < 9
        held.setdefault(key, []).append(r[0])
        want[r[0]] = sum(held[key][-5:])
    assert dict(tuple(r) for r in out.collect()) == want
    frames = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "sum(_n#" not in x]
    assert frames and all("_chunk#" in x or "_b#" in x for x in frames)  # none of one key alone
