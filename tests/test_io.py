"""Mappers, connectors and error handling."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from tidewright import types
from tidewright.lang.lexer import DialectError
from tidewright.lang.parser import parse
from tidewright.sources import connectors, errors, formats

SCHEMA = types.schema((("symbol", "STRING"), ("price", "DOUBLE"), ("volume", "INT"), ("up", "BOOL")))


def test_json(spark):
    deep = '{"a":' + "[" * 40 + "]" * 40 + "}"
    texts = ['{"symbol": "A", "price": 1.5, "volume": 7, "up": true}', '{"SYMBOL": "B", "Price": "x", "volume": "8"}', '{"symbol": {"n": 1}, "volume": 2.5}', "[1]", "nonsense", None, deep, '{"symbol": "[[[[", "price": 2}']
    rows = formats.from_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"), SCHEMA).orderBy("i").collect()
    assert [tuple(r)[1:5] for r in rows[:3]] == [("A", 1.5, 7, True), ("B", None, 8, None), ('{"n":1}', None, None, None)]
    assert [r._error is None for r in rows] == [True, True, True, False, False, False, False, True] and rows[7].symbol == "[[[["
    paths = formats.from_json(spark.createDataFrame([('{"a": {"b": [5, 6]}}',)], "value string"), types.schema((("x", "INT"),)), mappings={"x": "$.a.b[1]"})
    assert paths.first().x == 6


def test_json_out(spark):
    df = spark.createDataFrame([("A", 1.5, None)], "s string, p double, n int")
    assert formats.to_json(df).first().value == '{"s":"A","p":1.5,"n":null}'
    assert formats.to_json(df, generic=True).first().value == '{"field_0":"A","field_1":1.5,"field_2":null}'
    assert formats.to_json(df, template='<{{s}}|{{ p }}|{{n}}>').first().value == "<A|1.5|null>"
    with pytest.raises(DialectError):
        formats.to_json(df, template="{{nope}}")


def test_csv(spark):
    texts = ['A,1.5,7,TRUE', '"x, y",oops,8,no', "short", "B,2,,false"]
    rows = formats.from_csv(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"), SCHEMA).orderBy("i").collect()
    assert [tuple(r)[1:5] for r in rows] == [("A", 1.5, 7, True), ("x, y", None, 8, None), (None, None, None, None), ("B", 2.0, None, False)]
    assert [r._error is None for r in rows] == [True, True, False, True]


def test_error_strategies(spark):
    raw = spark.createDataFrame([('{"price": 1}', '{"price": 1}'), ("bad", "bad")], "value string, _payload string")
    made = formats.from_json(raw, SCHEMA)
    good, dead = errors.handled(made, "dlq", "s")
    assert good.columns == SCHEMA.names and good.count() == 1
    d = dead.first()
    assert (d.originalEvent, d.errorType, d.attemptCount, d.streamName) == ("bad", "mapping", 1, "s") and dead.schema.simpleString() == "struct<" + errors.DLQ.replace(" ", ":").replace(",:", ",") + ">"
    assert errors.handled(made, "drop", "s")[0].count() == 1
    with pytest.raises(PySparkException):
        errors.handled(made, "fail", "s")[0].collect()
    with pytest.raises(DialectError):
        errors.handled(made, "shrug", "s")
    errors.check_dead_letter_stream((("originalEvent", "STRING"), ("errorMessage", "STRING"), ("errorType", "STRING"), ("timestamp", "BIGINT"), ("attemptCount", "INT"), ("streamName", "STRING")), "d")


def test_retry():
    calls = []

    def flaky(df):
        calls.append(df)
        if len(calls) < 3:
            raise OSError("no")

    errors.retried(flaky, 3, 0)("x")
    assert len(calls) == 3
    kept = []
    errors.retried(lambda df: 1 / 0, 2, 0, fallback=lambda df, e, n: kept.append((df, n)))("y")
    assert kept == [("y", 2)]
    with pytest.raises(ZeroDivisionError):
        errors.retried(lambda df: 1 / 0, 2, 0)("y")


def test_broker_double_there_and_back(spark, tmp_path):
    text = """CREATE STREAM out (symbol STRING, price DOUBLE) WITH (type = 'sink', extension = 'rabbitmq', format = 'json', "rabbitmq.host" = 'h', "rabbitmq.exchange" = 'x', folder = '{f}');
        CREATE STREAM back (symbol STRING, price DOUBLE) WITH (type = 'source', extension = 'rabbitmq', format = 'json', "rabbitmq.host" = 'h', "rabbitmq.queue" = 'q', folder = '{f}', "error.strategy" = 'dlq')"""
    out, back = parse(text.format(f=f"{tmp_path}/queue"))
    connectors.sink(out)(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, price double"))
    connectors.FolderTransport(f"{tmp_path}/queue").send([b"broken"])
    good, dead = connectors.open_source(spark, back)
    assert sorted(map(tuple, good.collect())) == [("A", 1.0), ("B", 2.0)] and [r.originalEvent for r in dead.collect()] == ["broken"]
    stream, _ = connectors.open_source(spark, back, live=True)
    q = stream.writeStream.format("memory").queryName("broker").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("broker").count() == 2
    with pytest.raises(DialectError):
        connectors.check("rabbitmq", "source", {"rabbitmq.host": "h"})


def test_file_and_log(spark, tmp_path, caplog):
    (s, r) = parse(f"CREATE STREAM o (a INT, b STRING) WITH (type = 'sink', extension = 'file', format = 'csv', path = '{tmp_path}/f'); CREATE STREAM i (a INT, b STRING) WITH (type = 'source', extension = 'file', format = 'csv', path = '{tmp_path}/f')")
    df = spark.createDataFrame([(1, "x"), (2, "y, z")], "a int, b string")
    connectors.sink(s)(df)
    assert sorted(map(tuple, connectors.open_source(spark, r)[0].collect())) == [(1, "x"), (2, "y, z")]
    (log,) = parse("CREATE STREAM l (a INT, b STRING) WITH (type = 'sink', extension = 'log', prefix = 'got ')")
    with caplog.at_level("INFO", "tidewright.sink"):
        connectors.sink(log)(df)
    assert 'got {"a":1,"b":"x"}' in caplog.text


def test_jdbc_table(spark):
    """A database's table by the driver that Spark ships: declared types, and rows that a stream looks up."""
    from tidewright.runner import Runner

    url, driver = "jdbc:derby:memory:tidewright;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "k bigint, name string").write.jdbc(url, "names", mode="overwrite", properties={"driver": driver})
    e = Runner(spark).stream("s", spark.createDataFrame([(10, 1), (20, 3), (30, 9)], "t bigint, k bigint"), "t")
    out = e.run(f"""CREATE TABLE names (k BIGINT, name STRING) WITH (extension = 'jdbc', url = '{url}', "jdbc.driver" = '{driver}');
        INSERT INTO o SELECT s.k AS k, names.name AS name FROM s LEFT JOIN names ON s.k = names.k""")["o"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == [(1, "one"), (3, None), (9, None)]


def test_timer_source(spark):
    from tidewright.sources.connectors import open_source

    (s,) = parse("CREATE STREAM beat (at BIGINT) WITH (type = 'source', extension = 'timer', interval = '200')")
    df, dead = open_source(spark, s)
    assert dead is None and df.isStreaming and df.columns == ["at"]
    q = df.writeStream.format("memory").queryName("beats").start()
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if spark.table("beats").count() > 4:
                break
    finally:
        q.stop()
    times = sorted(r[0] for r in spark.table("beats").collect())
    assert len(times) > 4 and {b - a for a, b in zip(times, times[1:])} == {200}


def test_websocket_double(spark, tmp_path):
    from tidewright.sources.connectors import open_source, sink

    text = """CREATE STREAM out (a INT, b STRING) WITH (type = 'sink', extension = 'websocket', format = 'json', "websocket.url" = 'ws://h', folder = '{f}');
        CREATE STREAM back (a INT, b STRING) WITH (type = 'source', extension = 'websocket', format = 'json', "websocket.url" = 'ws://h', folder = '{f}')"""
    (o, i) = parse(text.format(f=tmp_path))
    sink(o)(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    back, _ = open_source(spark, i)
    assert sorted(tuple(r) for r in back.select("a", "b").collect()) == [(1, "x"), (2, None)]
