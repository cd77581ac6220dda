from __future__ import annotations

import pytest

from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError
from tidewright.lang.parser import parse, parse_expression
from tidewright.sources.validation import check_options, cycles


def one(text: str):
    (s,) = parse(text)
    return s


def test_select_clauses_in_any_order():
    a = one("INSERT INTO o SELECT a, sum(b) AS s FROM x WINDOW('length', 5) WHERE a > 1 GROUP BY a HAVING sum(b) > 2 ORDER BY a DESC LIMIT 3 OFFSET 1")
    b = one("SELECT a, sum(b) AS s FROM x WHERE a > 1 GROUP BY a WINDOW('length', 5) HAVING sum(b) > 2 ORDER BY a DESC LIMIT 3 OFFSET 1 INSERT INTO o")
    assert a == b and a.target == "o" and a.window == A.WindowSpec("length", (A.Lit(5, "int"),)) and (a.limit, a.offset) == (3, 1)


@pytest.mark.parametrize(("text", "ms"), [("TUMBLING(5 MINUTES)", 300_000), ("('tumbling', 100 ms)", 100), ("('time', 1 min)", 60_000), ("('timeBatch', 2 weeks)", 1_209_600_000), ("('time', INTERVAL '2' DAY)", 172_800_000)])
def test_durations(text, ms):
    assert one(f"SELECT a FROM x WINDOW {text}").window.args[0].value == ms


def test_statements():
    app = parse("""-- a comment
        CREATE STREAM s (a INT, b DOUBLE PRECISION, c VARCHAR(20)) WITH (type = 'source', extension = 'kafka', "kafka.bootstrap.servers" = 'x', topic = 't');
        CREATE TABLE t (k BIGINT PRIMARY KEY, v STRING) WITH ('extension' = 'inMemory');
        CREATE TRIGGER g AT EVERY 5 SECONDS; CREATE TRIGGER h AT START; CREATE TRIGGER i AT CRON '0 * * * * *';
        PARTITION WITH (a OF s) BEGIN INSERT INTO o SELECT a FROM s; INSERT INTO p SELECT b FROM s; END;
        /* more */ CREATE AGGREGATION agg AS SELECT a, sum(b) AS x FROM s GROUP BY a AGGREGATE EVERY SECOND TO YEAR""")
    assert [type(x) for x in app] == [A.CreateStream, A.CreateTable, A.CreateTrigger, A.CreateTrigger, A.CreateTrigger, A.Partition, A.CreateAggregation]
    assert app[0].options["kafka.bootstrap.servers"] == "x" and app[1].key == ("k",) and app[2].every == 5000 and len(app[5].body) == 2


def test_patterns():
    p = one("SELECT e1.a FROM PATTERN (EVERY(e1=A[x > 1]{2,3} -> (e2=B AND e3=C) -> e4=D) WITHIN 5 SECONDS)").source
    assert p.every and p.within == 5000 and p.steps[0] == A.Step("A", "e1", A.Binary(">", A.Col("x"), A.Lit(1, "int")), 2, 3)
    assert isinstance(p.steps[1], A.Logical) and p.steps[2] == A.Step("D", "e4")
    assert one("SELECT a.x FROM SEQUENCE (a=A -> NOT B FOR 2 SEC) WITHIN 10 EVENTS").source.within_events == 10


def test_expressions():
    assert parse_expression("a + b * 2 = -c AND NOT d OR e") == A.Binary("or", A.Binary("and", A.Binary("=", A.Binary("+", A.Col("a"), A.Binary("*", A.Col("b"), A.Lit(2, "int"))), A.Unary("-", A.Col("c"))), A.Unary("not", A.Col("d"))), A.Col("e"))
    assert parse_expression("x NOT IN (1, 2)") == A.InList(A.Col("x"), (A.Lit(1, "int"), A.Lit(2, "int")), True)
    assert parse_expression("e1[last].x") == A.Col("x", "e1", -1)
    assert parse_expression("3000000000").kind == "long"


@pytest.mark.parametrize("text", [
    "SELECT a FROM x UNION SELECT a FROM y", "WITH q AS (SELECT 1) SELECT a FROM q", "SELECT sum(a) OVER (PARTITION BY b) FROM x", "SELECT a FROM x, y", "SELECT a FROM (SELECT b FROM y)",
    "SELECT count(*) FILTER (WHERE a > 1) FROM x", "SELECT a FROM x GROUP BY ROLLUP(a)", "SELECT a FROM x GROUP BY a + 1", "SELECT a FROM x LIMIT 1, 2", "SELECT a FROM x NATURAL JOIN y", "SELECT a FROM x JOIN y USING (a)",
    "SELECT e.a FROM PATTERN (e=A+ -> f=B)", "SELECT e.a FROM PATTERN (e=A{,3} -> f=B)", "SELECT e.a FROM PATTERN (e=A{2,} -> f=B)", "SELECT e.a FROM PATTERN (e=A{0,2} -> f=B)", "SELECT e.a FROM PATTERN (e=A -> f=B{1,2})",
    "SELECT e.a FROM SEQUENCE (EVERY(e=A -> f=B))", "SELECT e.a FROM PATTERN (e=A -> EVERY(f=B))", "SELECT A.x FROM PATTERN (A -> A)", "SELECT a FROM x WHERE a LIKE 'b' ESCAPE 'c'", "SELECT ceil(a TO DAY) FROM x", "SELECT a FROM x WHERE", "SELECT 'a FROM x",
])
def test_rejected(text):
    with pytest.raises(DialectError):
        parse(text)


def test_options_and_cycles():
    check_options("s", {"type": "source", "extension": "kafka", "format": "json"}, table=False)
    for bad in ({"type": "source"}, {"extension": "kafka"}, {"type": "internal", "format": "json"}, {"type": "what"}, {"type": "sink", "extension": "log", "format": "xml"}):
        with pytest.raises(DialectError):
            check_options("s", bad, table=False)
    with pytest.raises(DialectError):
        check_options("t", {"extension": "cache"}, table=True)
    assert cycles([("b", ["a"]), ("c", ["b"])]) is None
    assert cycles([("b", ["a"]), ("a", ["b"])]) == ["a", "b", "a"]
