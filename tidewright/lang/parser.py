"""Recursive-descent parser of the dialect."""

from __future__ import annotations

from collections.abc import Callable

from tidewright.lang import ast as A
from tidewright.lang.lexer import DialectError, Token, lex

#: Milliseconds of the unit words. A month is 30 days and a year 365.
UNITS = {
    1: ("MILLISECOND", "MILLISECONDS", "MS", "MILLIS"),
    1_000: ("SECOND", "SECONDS", "SEC", "SECS", "S"),
    60_000: ("MINUTE", "MINUTES", "MIN", "MINS"),
    3_600_000: ("HOUR", "HOURS", "H"),
    86_400_000: ("DAY", "DAYS", "D"),
    604_800_000: ("WEEK", "WEEKS", "W"),
    2_592_000_000: ("MONTH", "MONTHS"),
    31_536_000_000: ("YEAR", "YEARS"),
}
MS = {word: ms for ms, words in UNITS.items() for word in words}
RESERVED = set("SELECT FROM WHERE WINDOW GROUP BY HAVING ORDER LIMIT OFFSET INSERT INTO JOIN LEFT RIGHT FULL INNER OUTER ON AS AND OR NOT IN IS NULL LIKE BETWEEN CASE WHEN THEN ELSE END WITHIN OUTPUT UNION INTERSECT EXCEPT PARTITION BEGIN PATTERN SEQUENCE EVERY FOR UNIDIRECTIONAL USING NATURAL CROSS AGGREGATE".split())


def parse(text: str) -> list:
    """The statements of an application."""
    return Parser(text).statements()


def parse_expression(text: str) -> A.Expr:
    p = Parser(text)
    x = p.expression()
    p.need_end()
    return x


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = lex(text), 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def fail(self, what: str) -> DialectError:
        return DialectError(f"{what}, found {self.now.text or 'the end'!r} at {self.now.at}")

    def word(self, *words: str) -> bool:
        """Takes these words if they come next."""
        if all(self.ahead(k).upper == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            raise self.fail(f"{text} expected")

    def need_end(self) -> None:
        if self.now.kind != "end":
            raise self.fail("end expected")

    def name(self, what: str = "a name") -> str:
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.upper not in RESERVED:
            self.i += 1
            return self.tokens[self.i - 1].text
        raise self.fail(f"{what} expected")

    def integer(self) -> int:
        if self.now.kind == "number" and self.now.text.isdigit():
            self.i += 1
            return int(self.tokens[self.i - 1].text)
        raise self.fail("a whole number expected")

    def commas(self, one: Callable) -> tuple:
        out = [one()]
        while self.op(","):
            out.append(one())
        return tuple(out)

    # statements

    def statements(self) -> list:
        out = []
        while self.now.kind != "end":
            if self.op(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end":
                self.need(";")
        return out

    def statement(self):
        if self.word("CREATE"):
            for kind, make in (("STREAM", self.create_stream), ("TABLE", self.create_table), ("TRIGGER", self.create_trigger), ("AGGREGATION", self.create_aggregation)):
                if self.word(kind):
                    return make()
            raise self.fail("STREAM, TABLE, TRIGGER or AGGREGATION expected")
        if self.word("PARTITION", "WITH"):
            return self.partition()
        for op in ("UPDATE", "DELETE", "UPSERT"):
            if self.word(op):
                return self.write(op.lower())
        return self.query()

    def columns(self) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
        self.need("(")
        columns, key = [], []
        while True:
            if self.word("PRIMARY", "KEY"):
                self.need("(")
                key += self.commas(self.name)
                self.need(")")
            else:
                name = self.name("a column")
                columns.append((name, self.type()))
                while self.now.kind == "word":
                    if self.word("PRIMARY", "KEY"):
                        key.append(name)
                    elif not (self.word("NOT", "NULL") or self.word("NULL")):
                        raise self.fail("a column option is not known")
            if not self.op(","):
                break
        self.need(")")
        return tuple(columns), tuple(key)

    def type(self) -> str:
        t = self.name("a type").upper()
        if t == "DOUBLE":
            self.word("PRECISION")
        if self.op("("):
            self.commas(self.integer)
            self.need(")")
        return t

    def options(self) -> dict:
        out = {}
        if self.word("WITH"):
            self.need("(")
            while True:
                key = self.tokens[self.i].text
                self.i += 1
                while self.op("."):
                    key += "." + self.name()
                self.need("=")
                if self.now.kind not in ("string", "number", "word"):
                    raise self.fail("an option's value expected")
                out[key] = self.now.text
                self.i += 1
                if not self.op(","):
                    break
            self.need(")")
        return out

    def create_stream(self) -> A.CreateStream:
        name = self.name()
        columns, key = self.columns()
        if key:
            raise DialectError(f"stream {name} cannot have a primary key")
        return A.CreateStream(name, columns, self.options())

    def create_table(self) -> A.CreateTable:
        name = self.name()
        columns, key = self.columns()
        return A.CreateTable(name, columns, self.options(), key)

    def create_trigger(self) -> A.CreateTrigger:
        name = self.name()
        self.need("AT")
        if self.word("START"):
            return A.CreateTrigger(name, start=True)
        if self.word("EVERY"):
            return A.CreateTrigger(name, every=self.duration())
        self.word("CRON")
        if self.now.kind == "string":
            self.i += 1
            return A.CreateTrigger(name, cron=self.tokens[self.i - 1].text)
        raise self.fail("START, EVERY or a cron string expected")

    def create_aggregation(self) -> A.CreateAggregation:
        name = self.name()
        self.word("AS")
        select = self.select()
        self.need("AGGREGATE")
        by = self.name() if self.word("BY") else None
        self.need("EVERY")
        first = self.name("a duration").upper()
        if self.op("-") or self.word("TO"):
            last = self.name("a duration").upper()
            return A.CreateAggregation(name, select, (first, "...", last), by)
        return A.CreateAggregation(name, select, (first, *((self.commas(lambda: self.name().upper())) if self.op(",") else ())), by)

    def partition(self) -> A.Partition:
        self.need("(")

        def key() -> tuple[str, A.Expr]:
            x = self.expression()
            self.need("OF")
            return self.name(), x

        keys = self.commas(key)
        self.need(")")
        self.need("BEGIN")
        body = []
        while not self.word("END"):
            if self.op(";"):
                continue
            body.append(self.query())
        return A.Partition(keys, tuple(body))

    def write(self, op: str) -> A.Write:
        self.word("INTO") or self.word("FROM")
        name = self.name()
        key = ()
        if self.word("ON"):
            self.need("(")
            key = self.commas(self.name)
            self.need(")")
        return A.Write(op, name, self.select(), key)

    def query(self) -> A.Select:
        if self.word("INSERT"):
            self.need("INTO")
            target = self.name()
            return self.select(target)
        return self.select()

    def select(self, target: str | None = None) -> A.Select:
        if self.word("WITH"):
            raise DialectError("WITH queries are not supported; insert into a stream and read it")
        self.need("SELECT")
        distinct = self.word("DISTINCT")
        items = self.commas(self.item)
        self.need("FROM")
        source = self.source()
        got: dict = {}

        def once(clause: str, value) -> None:
            if clause in got:
                raise DialectError(f"{clause} stands twice")
            got[clause] = value

        while True:
            if self.word("WHERE"):
                once("where", self.expression())
            elif self.word("WINDOW"):
                once("window", self.window())
            elif self.word("GROUP", "BY"):
                once("group_by", self.commas(self.group_item))
            elif self.word("HAVING"):
                once("having", self.expression())
            elif self.word("ORDER", "BY"):
                once("order_by", self.commas(self.order_item))
            elif self.word("LIMIT"):
                once("limit", self.integer())
                if self.op(","):
                    raise DialectError("LIMIT offset, count is not supported; use LIMIT … OFFSET …")
            elif self.word("OFFSET"):
                once("offset", self.integer())
            elif self.word("OUTPUT"):
                once("rate", self.rate())
            elif self.word("INSERT", "INTO"):
                target = self.name()
            else:
                break
        for w in ("UNION", "INTERSECT", "EXCEPT"):
            if self.now.upper == w:
                raise DialectError(f"{w} is not supported; insert both queries into one stream")
        return A.Select(items, source, distinct=distinct, target=target or "OutputStream", **got)

    def item(self) -> tuple[A.Expr, str | None]:
        if self.op("*"):
            return A.Star(), None
        if self.ahead().text == "." and self.ahead(2).text == "*":
            of = self.name()
            self.i += 2
            return A.Star(of), None
        x = self.expression()
        if self.word("AS"):
            return x, self.name("an alias")
        if self.now.kind in ("word", "quoted") and self.now.upper not in RESERVED:
            return x, self.name()
        return x, None

    def group_item(self) -> A.Expr:
        if self.now.upper in ("ROLLUP", "CUBE", "GROUPING"):
            raise DialectError(f"{self.now.upper} is not supported")
        x = self.expression()
        if not isinstance(x, A.Col):
            raise DialectError("GROUP BY takes columns")
        return x

    def order_item(self) -> A.OrderItem:
        x = self.expression()
        down = self.word("DESC")
        if not down:
            self.word("ASC")
        return A.OrderItem(x, down)

    def rate(self) -> A.Rate:
        what = next((w for w in ("ALL", "FIRST", "LAST", "SNAPSHOT") if self.word(w)), "ALL").lower()
        self.need("EVERY")
        if self.now.kind == "number" and self.ahead().upper in ("EVENT", "EVENTS"):
            n = self.integer()
            self.i += 1
            return A.Rate(what, events=n)
        return A.Rate(what, ms=self.duration())

    # sources

    def source(self):
        for mode in ("PATTERN", "SEQUENCE"):
            if self.word(mode):
                return self.pattern(mode.lower())
        left: A.Rel | A.Join = self.relation()
        while True:
            if self.op(","):
                raise DialectError("comma joins are not supported; use JOIN … ON")
            if self.word("NATURAL") or self.word("CROSS"):
                raise DialectError("NATURAL and CROSS joins are not supported")
            how = None
            for w, h in (("LEFT", "left"), ("RIGHT", "right"), ("FULL", "full")):
                if self.word(w):
                    self.word("OUTER")
                    how = h
            if how is None and self.word("INNER"):
                how = "inner"
            side = "left" if how is None and self.word("UNIDIRECTIONAL") else None
            if not self.word("JOIN"):
                if how:
                    raise self.fail("JOIN expected")
                return left
            right = self.relation()
            side = "right" if side is None and self.word("UNIDIRECTIONAL") else side
            if self.word("USING"):
                raise DialectError("USING is not supported; use ON")
            self.need("ON")
            left = A.Join(left, right, how or "inner", self.expression(), side)

    def relation(self) -> A.Rel:
        if self.now.text == "(":
            raise DialectError("derived tables are not supported; insert into a stream and read it")
        name = self.name("a stream or table")
        alias, window = None, None
        for _ in range(2):
            if self.word("AS"):
                alias = self.name()
            elif alias is None and self.now.kind in ("word", "quoted") and self.now.upper not in RESERVED:
                alias = self.name()
            elif window is None and self.now.upper == "WINDOW" and self._window_of_join():
                self.i += 1
                window = self.window()
        return A.Rel(name, alias, window)

    def _window_of_join(self) -> bool:
        """Whether a WINDOW here is followed by an alias, JOIN or ON: then it is the relation's, else the query's."""
        k = self.i + 1
        while self.tokens[k].text not in ("(", "") or self.tokens[k].kind == "string":
            k += 1
        depth = 0
        while k < len(self.tokens):
            depth += (self.tokens[k].text == "(" and self.tokens[k].kind == "op") - (self.tokens[k].text == ")" and self.tokens[k].kind == "op")
            k += 1
            if depth == 0:
                break
        rest = self.tokens[k : k + 4]
        return any(t.upper in ("JOIN", "ON", "LEFT", "RIGHT", "FULL", "INNER", "UNIDIRECTIONAL") for t in rest[: 1 + 2 * (rest[0].upper == "AS") + (rest[0].kind == "word" and rest[0].upper not in RESERVED)])

    def window(self) -> A.WindowSpec:
        if self.op("("):
            if self.now.kind not in ("string", "word"):
                raise self.fail("a window type expected")
            kind = self.now.text
            self.i += 1
            args = self.commas(self.window_arg) if self.op(",") else ()
        else:
            kind = self.name("a window type")
            self.need("(")
            args = self.commas(self.window_arg) if self.now.text != ")" else ()
        self.need(")")
        return A.WindowSpec(kind.lower().replace("_", ""), args)

    def window_arg(self) -> A.Expr:
        if self.now.kind == "number" and self.ahead().upper in MS:
            return A.Lit(self.duration(), "interval")
        return self.expression()

    def duration(self) -> int:
        if self.word("INTERVAL"):
            return self.interval()
        total = 0
        while self.now.kind == "number" and self.ahead().upper in MS:
            total += round(float(self.now.text) * MS[self.ahead().upper])
            self.i += 2
        if not total:
            if self.now.kind == "number":
                return self.integer()
            raise self.fail("a duration expected")
        return total

    def interval(self) -> int:
        if self.now.kind not in ("string", "number"):
            raise self.fail("an interval's value expected")
        parts = self.now.text.split()
        self.i += 1
        if len(parts) == 2 and parts[1].upper() in MS:
            return round(float(parts[0]) * MS[parts[1].upper()])
        if self.now.upper not in MS:
            raise self.fail("a unit expected")
        self.i += 1
        return round(float(parts[0]) * MS[self.tokens[self.i - 1].upper])

    # patterns

    def pattern(self, mode: str) -> A.Pattern:
        self.need("(")
        every = self.word("EVERY")
        if every and mode == "sequence":
            raise DialectError("EVERY is for PATTERN; a SEQUENCE starts anew by itself")
        if every:
            self.need("(")
        steps = [self.pattern_item()]
        while self.op("->"):
            steps.append(self.pattern_item())
        if every:
            self.need(")")
        within, events = None, None
        if self.word("WITHIN"):
            within, events = self.within()
        self.need(")")
        if self.word("WITHIN"):
            within, events = self.within()
        self.check(steps)
        return A.Pattern(mode, tuple(steps), every, within, events)

    def within(self) -> tuple[int | None, int | None]:
        if self.now.kind == "number" and self.ahead().upper in ("EVENT", "EVENTS"):
            n = self.integer()
            self.i += 1
            return None, n
        return self.duration(), None

    def check(self, steps: list) -> None:
        last = steps[-1]
        if isinstance(last, A.Step) and last.least != last.most:
            raise DialectError("the last step needs an exact count")
        labels = [s.label for x in steps for s in ((x.a, x.b) if isinstance(x, A.Logical) else (x,)) if isinstance(s, A.Step)]
        if twice := {x for x in labels if labels.count(x) > 1}:
            raise DialectError(f"steps of one name need aliases: {sorted(twice)}")

    def pattern_item(self):
        if self.word("EVERY"):
            raise DialectError("EVERY stands at the top of a pattern only")
        if self.word("NOT"):
            s = self.step()
            self.need("FOR")
            return A.Absent(s.stream, s.alias, s.where, self.duration())
        grouped = self.op("(")
        a = self.step()
        for op in ("AND", "OR"):
            if self.word(op):
                b = self.step()
                if grouped:
                    self.need(")")
                if self.now.upper in ("AND", "OR"):
                    raise DialectError("a logical element has two steps")
                return A.Logical(op.lower(), a, b)
        if grouped:
            self.need(")")
        return a

    def step(self) -> A.Step:
        name, alias = self.name("a stream"), None
        if self.op("="):
            alias, name = name, self.name("a stream")
        elif self.word("AS"):
            alias = self.name()
        where = None
        if self.op("["):
            where = self.expression()
            self.need("]")
        least = most = 1
        if self.op("{"):
            if self.now.text == ",":
                raise DialectError("a count needs its lower bound")
            least = most = self.integer()
            if self.op(","):
                if self.now.text == "}":
                    raise DialectError("a count needs its upper bound")
                most = self.integer()
            self.need("}")
            if least < 1 or most < least:
                raise DialectError("a count is {m,n} with 1 <= m <= n")
        elif self.now.text in ("+", "*", "?"):
            raise DialectError(f"{self.now.text} is not supported; give {{m,n}}")
        return A.Step(name, alias, where, least, most)

    # expressions, loosest first

    def expression(self) -> A.Expr:
        x = self.conjunction()
        while self.word("OR"):
            x = A.Binary("or", x, self.conjunction())
        return x

    def conjunction(self) -> A.Expr:
        x = self.negation()
        while self.word("AND"):
            x = A.Binary("and", x, self.negation())
        return x

    def negation(self) -> A.Expr:
        return A.Unary("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> A.Expr:
        x = self.sum()
        while True:
            negated = self.now.upper == "NOT" and self.ahead().upper in ("IN", "LIKE", "BETWEEN") and self.word("NOT")
            if self.word("BETWEEN"):
                low = self.sum()
                self.need("AND")
                between = A.Binary("and", A.Binary(">=", x, low), A.Binary("<=", x, self.sum()))
                x = A.Unary("not", between) if negated else between
            elif self.word("IN"):
                if self.op("("):
                    items = () if self.now.text == ")" else self.commas(self.expression)
                    self.need(")")
                    x = A.InList(x, items, negated)
                else:
                    x = A.InTable(x, self.name("a table"))
                    x = A.Unary("not", x) if negated else x
            elif self.word("LIKE"):
                x = A.Like(x, self.sum(), negated)
                if self.word("ESCAPE"):
                    raise DialectError("LIKE has no ESCAPE; the escape is \\")
            elif self.word("IS"):
                no = self.word("NOT")
                self.need("NULL")
                x = A.IsNull(x, no)
            else:
                op = next((o for o in ("=", "!=", "<>", "<=", ">=", "<", ">") if self.op(o)), None)
                if op is None:
                    return x
                x = A.Binary("!=" if op == "<>" else op, x, self.sum())

    def sum(self) -> A.Expr:
        x = self.product()
        while True:
            if self.op("+"):
                x = A.Binary("+", x, self.product())
            elif self.op("-"):
                x = A.Binary("-", x, self.product())
            elif self.op("||"):
                x = A.Call("concat", (x, self.product()))
            else:
                return x

    def product(self) -> A.Expr:
        x = self.sign()
        while True:
            op = next((o for o in ("*", "/", "%") if self.op(o)), None)
            if op is None:
                return x
            x = A.Binary(op, x, self.sign())

    def sign(self) -> A.Expr:
        if self.op("-"):
            return A.Unary("-", self.sign())
        if self.op("+"):
            return self.sign()
        return self.atom()

    def atom(self) -> A.Expr:
        t = self.now
        if t.kind == "number":
            self.i += 1
            if t.text.isdigit():
                v = int(t.text)
                return A.Lit(v, "int" if v < 1 << 31 else "long")
            return A.Lit(float(t.text), "double")
        if t.kind == "string":
            self.i += 1
            return A.Lit(t.text, "string")
        if self.op("("):
            x = self.expression()
            self.need(")")
            return x
        for w, lit in (("TRUE", A.Lit(True, "bool")), ("FALSE", A.Lit(False, "bool")), ("NULL", A.Lit(None, "null"))):
            if self.word(w):
                return lit
        if self.word("INTERVAL"):
            return A.Lit(self.interval(), "interval")
        if self.word("CASE"):
            return self.case()
        if t.upper in ("CAST", "EXTRACT", "POSITION", "TRIM", "SUBSTRING", "CEIL", "FLOOR", "LEFT", "RIGHT") and self.ahead().text == "(":
            self.i += 2
            return self.special(t.upper)
        if t.upper == "LIKE" and self.ahead().text == "(":
            self.i += 2
            return self.call("like")
        name = self.name("an expression")
        if self.op("("):
            return self.call(name)
        index = None
        if self.op("["):
            if self.word("LAST"):
                index = -1
                if self.op("-"):
                    index -= self.integer()
            else:
                index = self.integer()
            self.need("]")
        if self.op("."):
            return A.Col(self.name("a column"), name, index)
        if index is not None:
            raise self.fail(". expected")
        return A.Col(name)

    def call(self, name: str) -> A.Call:
        distinct = self.word("DISTINCT")
        star = self.op("*")
        args = () if star or self.now.text == ")" else self.commas(self.expression)
        self.need(")")
        if self.now.upper == "OVER":
            raise DialectError("OVER is not supported; use a WINDOW clause")
        if self.now.upper == "FILTER":
            raise DialectError("FILTER is not supported; use CASE inside the aggregate")
        return A.Call(name, args, distinct, star)

    def special(self, name: str) -> A.Expr:
        if name == "CAST":
            x = self.expression()
            if self.op(","):
                out: A.Expr = A.Cast(x, self.now.text.upper())
                self.i += 1
            else:
                self.need("AS")
                out = A.Cast(x, self.type())
        elif name == "EXTRACT":
            part = self.name("a field")
            self.need("FROM")
            out = A.Extract(part.lower(), self.expression())
        elif name == "POSITION":
            a = self.sum()
            if not self.word("IN"):
                self.need(",")
            out = A.Call("position", (a, self.expression()))
        elif name == "TRIM":
            self.word("BOTH") or self.word("LEADING") or self.word("TRAILING")
            self.word("FROM")
            out = A.Call("trim", (self.expression(),))
        elif name == "SUBSTRING":
            args = [self.expression()]
            while self.op(",") or self.word("FROM") or self.word("FOR"):
                args.append(self.expression())
            out = A.Call("substring", tuple(args))
        else:
            args = self.commas(self.expression)
            if self.word("TO"):
                raise DialectError(f"{name} has no TO")
            out = A.Call(name.lower(), args)
        self.need(")")
        return out

    def case(self) -> A.Case:
        operand = None if self.now.upper == "WHEN" else self.expression()
        whens = []
        while self.word("WHEN"):
            c = self.expression()
            self.need("THEN")
            whens.append((c, self.expression()))
        other = self.expression() if self.word("ELSE") else None
        self.need("END")
        if not whens:
            raise self.fail("WHEN expected")
        return A.Case(operand, tuple(whens), other)
