"""Live forms against replay: the same events as a file stream, one file for each part, in order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.runner import Runner
from tidewright.lang import ast as A
from tidewright.lang.parser import parse
from tidewright.streaming import live
from tests.test_simulator import events

SCHEMA = "id bigint, t bigint, kind string, k bigint, v double"


@pytest.fixture
def feed(spark, tmp_path):
    """A streaming DataFrame of random events, and the events."""
    rows = events(11)
    for n in range(4):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{n}")
    paths = f"{tmp_path}/in/*"
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(paths).withColumn("ts", F.timestamp_millis("t"))
    return sdf, rows, tmp_path


def drain(df, path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp_{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return sorted((tuple(r) for r in df.sparkSession.table(name).collect()), key=repr)


def replay(spark, rows, text, **choices):
    df = spark.createDataFrame(rows, SCHEMA)
    e = Runner(spark, **choices).stream("s", df, "t", ["id"])
    for c in "ABC":
        e.stream(c, df.where(f"kind = '{c}'"), "t", ["id"])
    return sorted((tuple(r) for r in e.run(text)["o"].collect()), key=repr)


def test_tumbling_is_replay_but_for_open_windows(spark, feed):
    sdf, rows, path = feed
    got = drain(live.tumbling(sdf, "ts", "1 minute", ["k"], [F.count(F.lit(1)).alias("n")]), path, "tumble")
    want = replay(spark, rows, "INSERT INTO o SELECT k, count(*) AS n FROM s WINDOW TUMBLING(1 MINUTE) GROUP BY k", align="epoch")
    mine = sorted(((k, n) for _, k, n in got), key=repr)
    assert len(mine) >= len(want) // 2 and not [x for x in mine if x not in want]


def test_length_and_batches(spark, feed):
    sdf, rows, path = feed
    got = drain(live.length(sdf, ["k"], ["t", "id"], 5, "v", ["id"]).select("id", "n", "min"), path, "len")
    assert got == replay(spark, rows, "PARTITION WITH (k OF s) BEGIN INSERT INTO o SELECT id, count(*) AS n, min(v) AS m FROM s WINDOW('length', 5); END")
    got = drain(live.length_batch(sdf, ["k"], ["t", "id"], 6, "v").select("k", "n", "max"), path, "batch")
    assert got == replay(spark, rows, "PARTITION WITH (k OF s) BEGIN INSERT INTO o SELECT k, count(*) AS n, max(v) AS m FROM s WINDOW('lengthBatch', 6); END")


def test_pattern(spark, feed):
    sdf, rows, path = feed
    (q,) = parse("SELECT e1.id AS a, e2.id AS b FROM PATTERN (EVERY(e1=A -> e2=B))")
    out = live.pattern(sdf.where("kind IN ('A', 'B')"), q.source, ["k"], "kind", "t", ["t", "id"], lambda s, r, g: True, {"a": ("e1", "id"), "b": ("e2", "id")})
    assert isinstance(q.source, A.Pattern)
    want = replay(spark, rows, "PARTITION WITH (k OF A, k OF B) BEGIN INSERT INTO o SELECT e1.id AS a, e2.id AS b FROM PATTERN (EVERY(e1=A -> e2=B)); END")
    assert drain(out.select("a", "b"), path, "pat") == want


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = [(i, 1000 + i, "A", 0, float(i)) for i in range(7)]
    spark.createDataFrame(rows[:4], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/0")

    def go():
        sdf = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*")
        out = live.length_batch(sdf, ["k"], ["t"], 3, "v")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["sum"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert go() == [3.0]
    spark.createDataFrame(rows[4:], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/1")
    assert go() == [3.0, 12.0]


def test_keyed_table(spark, feed):
    sdf, rows, path = feed
    q = sdf.drop("ts").writeStream.foreachBatch(live.upsert_sink(f"{path}/table", ["k"], ["t", "id"])).option("checkpointLocation", f"{path}/cp_t").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.k, r.id) for r in live.upserted(spark, f"{path}/table", ["k"]).collect())
    last = {}
    for i, _, _, k, _ in rows:
        last[k] = i
    assert got == sorted(last.items())


def test_sessions_are_replay_but_for_open_ones(spark, feed):
    sdf, rows, path = feed
    got = drain(live.sessions(sdf, "ts", "10 seconds", ["k"], [F.count(F.lit(1)).alias("n"), F.min("id").alias("lo")]), path, "sess")
    times: dict[int, list[tuple[int, int]]] = {}
    for id_, t, _, k, _ in rows:
        times.setdefault(k, []).append((t, id_))
    want = []
    for k, all_ in times.items():
        held = []
        for t, id_ in sorted(all_):
            if held and t - held[-1][0] >= 10_000:
                want.append((k, len(held), min(i for _, i in held)))
                held = []
            held.append((t, id_))
        want.append((k, len(held), min(i for _, i in held)))
    mine = [(k, n, lo) for _, k, n, lo in got]
    assert mine and not [x for x in mine if x not in want]
    assert len(want) - len(mine) <= len(times) + 2  # those that the last watermark has not passed


def test_interval_join(spark, feed):
    sdf, rows, path = feed
    a = sdf.where("kind = 'A'").select(F.col("id").alias("a"), F.col("k").alias("ka"), F.col("ts").alias("ta"))
    b = sdf.where("kind = 'B'").select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("ts").alias("tb"))
    out = live.interval_join(a, b, "ta", "tb", F.col("ka") == F.col("kb"), "5 seconds", "30 seconds", delay="1 hour")
    want = [(x[0], y[0]) for x in rows if x[2] == "A" for y in rows if y[2] == "B" and x[3] == y[3] and -5_000 <= y[1] - x[1] <= 30_000]
    assert want and drain(out.select("a", "b"), path, "near") == sorted(want, key=repr)


def test_lookup_and_dedup(spark, feed):
    sdf, rows, path = feed
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "key bigint, name string")
    got = drain(live.lookup(sdf, names, F.col("k") == F.col("key"), "left").select("id", "name"), path, "look")
    assert got == sorted(((r[0], {0: "zero", 1: "one"}.get(r[3])) for r in rows), key=repr)
    twice = sdf.withColumn("id", F.explode(F.array("id", "id")))
    assert drain(live.deduplicated(twice, "ts", ["id"], "1 hour").select("id"), path, "once") == sorted(((r[0],) for r in rows), key=repr)


def test_top(spark, feed):
    sdf, rows, path = feed
    got = drain(live.top(sdf, ["k"], ["t", "id"], 3, "v", True, ["id"]).select("id", "top"), path, "top")
    held: dict[int, list[float]] = {}
    want = []
    for id_, _, _, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        held[k] = sorted([*held.get(k, []), *([v] if v is not None else [])], reverse=True)[:3]
        want.append((id_, held[k]))
    assert got == sorted(want, key=repr)


def test_ticks(spark, tmp_path):
    (t,) = parse("CREATE TRIGGER beat AT EVERY 5 SECONDS")
    from tidewright.operators.triggers import live_ticks

    q = live_ticks(spark, t).writeStream.format("memory").queryName("beat").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("beat").count() > 2:
                break
    finally:
        q.stop()
    times = sorted(r[0] for r in spark.table("beat").collect())
    assert len(times) > 2 and {b - a for a, b in zip(times, times[1:])} == {5000}
