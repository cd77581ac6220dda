"""Windows and patterns against naive event-at-a-time simulators on random events, ties in time included."""

from __future__ import annotations

import random

import pytest

from tidewright.runner import Runner

N = 160


def events(seed: int, ties: bool = False) -> list[tuple[int, int, str, int, float | None]]:
    """(id, time, kind, key, value) in arrival order."""
    r = random.Random(seed)
    t, out = 1_700_000_000_000, []
    for i in range(N):
        t += r.choice([0, 1, 500, 3_000]) if ties else r.choice([1, 500, 3_000, 20_000])
        out.append((i, t, r.choice("ABC"), r.randrange(3), r.choice([None, r.randrange(50) / 2])))
    return out


def bound(spark, rows, **choices) -> Runner:
    df = spark.createDataFrame(rows, "id bigint, t bigint, kind string, k bigint, v double")
    e = Runner(spark, **choices).stream("s", df, "t", ["id"])
    for c in "ABC":
        e.stream(c, df.where(f"kind = '{c}'"), "t", ["id"])
    return e


def run(spark, rows, text, **choices):
    return sorted(tuple(r) for r in bound(spark, rows, **choices).run(f"INSERT INTO o {text}")["o"].collect())


def some(values):
    return [x for x in values if x is not None]


@pytest.mark.parametrize("seed", [1, 2])
def test_length(spark, seed):
    rows = events(seed)
    got = run(spark, rows, "SELECT id, count(*) AS n, sum(v) AS s, min(v) AS m FROM s WINDOW('length', 7) GROUP BY k")
    want = []
    for i, r in enumerate(rows):
        win = [x for x in rows[max(0, i - 6) : i + 1] if x[3] == r[3]]
        v = some(x[4] for x in win)
        want.append((r[0], len(win), float(sum(v)), min(v, default=None)))
    assert got == sorted(want)


def test_length_batch(spark):
    rows = events(3)
    got = run(spark, rows, "SELECT k, count(v) AS n, last(id) AS l FROM s WINDOW('lengthBatch', 9) GROUP BY k")
    want = []
    for b in range(N // 9):
        part = rows[b * 9 : b * 9 + 9]
        for k in {x[3] for x in part}:
            g = [x for x in part if x[3] == k]
            want.append((k, len(some(x[4] for x in g)), g[-1][0]))
    assert got == sorted(want)


def test_time_and_session(spark):
    rows = events(4)
    got = run(spark, rows, "SELECT id, count(*) AS n FROM s WINDOW('time', 5 SECONDS)")
    assert got == sorted((r[0], sum(1 for x in rows[: i + 1] if x[1] > r[1] - 5_000)) for i, r in enumerate(rows))
    got = run(spark, rows, "SELECT k, count(*) AS n FROM s WINDOW('session', 3 SECONDS, k) GROUP BY k")
    want, last = [], {}
    for r in rows:
        if r[3] in last and r[1] - last[r[3]][1] <= 3_000:
            last[r[3]] = (last[r[3]][0] + 1, r[1])
        else:
            if r[3] in last:
                want.append((r[3], last[r[3]][0]))
            last[r[3]] = (1, r[1])
    assert got == sorted(want + [(k, n) for k, (n, _) in last.items()])


def test_running_and_null_rules(spark):
    rows = events(5, ties=True)
    got = run(spark, rows, "SELECT id, sum(v) AS s, count(v) AS n, count(*) AS m, avg(v) AS a FROM s GROUP BY k")
    want = []
    for i, r in enumerate(rows):
        v = some(x[4] for x in rows[: i + 1] if x[3] == r[3])
        want.append((r[0], float(sum(v)), len(v), sum(x[3] == r[3] for x in rows[: i + 1]), sum(v) / len(v) if v else None))
    assert [(a, b, c, d, e and round(e, 9)) for a, b, c, d, e in got] == sorted((a, b, c, d, e and round(e, 9)) for a, b, c, d, e in want)


def simulate(rows, steps, every, within=None, keyed=False):
    """steps: (kind, least, most); candidates as the dialect defines them."""
    out, keys = [], sorted({r[3] for r in rows}) if keyed else [None]
    for key in keys:
        live, done = [], False
        for r in [x for x in rows if key is None or x[3] == key]:
            if done:
                break
            live = [i for i in live if within is None or r[1] - i[2] <= within]
            kept, found = [], []
            for i in [*live, (0, (), r[1], ())]:
                step, got, t0, cur = i
                kind, least, most = steps[step]
                moved = False
                if r[2] == kind and len(cur) < most:
                    moved = True
                    now = (*cur, r[0])
                    if len(now) >= least:
                        nxt = (step + 1, (*got, now), t0, ())
                        (found if step + 1 == len(steps) else kept).append(nxt)
                    if len(now) < most:
                        kept.append((step, got, t0, now))
                if not moved and i[1:2] + i[3:] != ((), ()):
                    kept.append(i)
            if found and not every:
                done, found = True, found[:1]
            out += [f[1] for f in found]
            live = kept
    return sorted(out)


@pytest.mark.parametrize(("every", "keyed", "within"), [(True, True, None), (True, False, None), (False, False, None), (False, True, None), (True, True, 30_000), (False, False, 9_000)])
def test_chain(spark, every, keyed, within):
    rows = events(6 + every, ties=True)
    body = "EVERY(e1=A -> e2=B -> e3=C)" if every else "e1=A -> e2=B -> e3=C"
    q = f"SELECT e1.id AS a, e2.id AS b, e3.id AS c FROM PATTERN ({body})" + (f" WITHIN {within} MS" if within else "")
    text = f"INSERT INTO o {q}"
    df_rows = [(i, t * 1000 + i, kind, k, v) for i, t, kind, k, v in rows]  # distinct times: streams' ties go by name
    if within:
        q_within = within * 1000
        text = text.replace(f"{within} MS", f"{q_within} MS")
    e = bound(spark, df_rows)
    text = f"PARTITION WITH (k OF A, k OF B, k OF C) BEGIN {text}; END" if keyed else text
    got = sorted(tuple(r) for r in e.run(text)["o"].collect())
    want = simulate(df_rows, [("A", 1, 1), ("B", 1, 1), ("C", 1, 1)], every, within and within * 1000, keyed)
    assert got == sorted((a[0], b[0], c[0]) for a, b, c in want)


def test_counts(spark):
    rows = [(i, t * 1000 + i, kind, k, v) for i, t, kind, k, v in events(9)]
    e = bound(spark, rows)
    q = "PARTITION WITH (k OF A, k OF B) BEGIN INSERT INTO o SELECT count(e1) AS n, e1[0].id AS f, e1[last].id AS l, e2.id AS b FROM PATTERN (EVERY(e1=A{1,3} -> e2=B)); END"
    got = sorted(tuple(r) for r in e.run(q)["o"].collect())
    want = simulate([r for r in rows if r[2] in "AB"], [("A", 1, 3), ("B", 1, 1)], True, None, True)
    assert got == sorted((len(a), a[0], a[-1], b[0]) for a, b in want)


def test_sequence_restarts_after_a_match(spark):
    rows = [(i, 1000 + i, c, 0, 1.0) for i, c in enumerate("AAABABBAAB")]
    got = run(spark, rows, "SELECT e1.id AS a, e2.id AS b FROM SEQUENCE (e1=A -> e2=A)")
    assert got == [(0, 1), (2, 4), (7, 8)]  # events of other streams are not looked at
    got = run(spark, rows, "SELECT e1.id AS a, e2.id AS b FROM SEQUENCE (e1=A -> e2=B)")
    assert got == [(2, 3), (4, 5), (8, 9)]


def test_errors(spark):
    from tidewright.lang.lexer import DialectError

    e = bound(spark, events(1))
    for text in ("SELECT nope FROM s", "SELECT id FROM nowhere", "SELECT id FROM s WHERE kind > 1", "SELECT id FROM s WHERE id", "SELECT sum(kind) AS x FROM s", "SELECT CASE WHEN id > 1 THEN 1 ELSE 'a' END AS x FROM s", "SELECT id, id FROM s", "SELECT wat(id) AS x FROM s", "SELECT id FROM s WINDOW('length', 0)", "SELECT * FROM PATTERN (a=A -> b=B)", "SELECT concat(id, 'a') AS x FROM s"):
        with pytest.raises(DialectError):
            e.run(f"INSERT INTO o {text}")
    with pytest.raises(DialectError):
        e.run("INSERT INTO x SELECT id FROM y; INSERT INTO y SELECT id FROM x")


def test_running_aggregates_without_keys_are_spread(spark, monkeypatch):
    """Chunks of 7 events, nulls and a filter among them, give what one pass over all events gives."""
    from tidewright.operators import windows

    monkeypatch.setattr(windows, "CHUNK", 7)
    rows = events(5)
    text = "SELECT id, count(*) AS n, count(v) AS c, sum(v) AS s, avg(v) AS a, min(v) AS lo, max(v) AS hi, maxForever(k) AS mk, round(stddev(v), 9) AS d FROM s WHERE kind != 'C'"
    got = bound(spark, rows).run(f"INSERT INTO o {text}")["o"]
    simple = bound(spark, rows).run("INSERT INTO o SELECT id, count(*) AS n, avg(v) AS a FROM s")["o"]
    plan = [x for x in simple._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert plan and all(x.count("], [") == 2 or "sum(_n#" in x or "AS _p0#" in x for x in plan)  # only the sizes and sums of chunks meet in one task
    held, want = [], {}
    for id_, t, kind, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind != "C":
            held.append((k, v))
            vs = [x for _, x in held if x is not None]
            want[id_] = (len(held), len(vs), sum(vs), sum(vs) / len(vs) if vs else None, min(vs, default=None), max(vs, default=None), max(x for x, _ in held))
    found = {r["id"]: r for r in got.collect()}
    assert found.keys() == want.keys()
    for id_, w in want.items():
        r = found[id_]
        assert (r.n, r.c, r.lo, r.hi, r.mk) == (w[0], w[1], w[4], w[5], w[6])
        assert r.s == pytest.approx(w[2]) and r.a == (pytest.approx(w[3]) if w[3] is not None else None)
