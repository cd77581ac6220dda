"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that they miss. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import hot_join, row_key, shared, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The possessive forms match what the plain ones do, since what follows a run never starts inside it. The first group
# starts a match only where a run starts or the last match ended: no run is tried again from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens with a digit, for identifiers that no base pattern takes.
TOKEN = r"(?:(?<![A-Za-z0-9@._%+-])|\G)[A-Za-z@._%+-]*+[0-9][A-Za-z0-9@._%+-]*+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """For up to 19 digits; zeros in front leave the sum as it is."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for place in range(1, 20):
        d = F.substring(padded, place, 1).cast("int")
        total = total + (d if place % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "token": lambda v: (F.length(v) >= 5) & (F.length(_digits(v)) >= 2),
}
#: Kinds that the method alone has, with the shape of their seeds among the tokens: keys and hashes of 32, 40 or 64 hexadecimal digits.
SECRET = "secret"
SECRET_SEED = r"^(?=.*[a-fA-F])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
#: What a token must look like to be taken for a kind, however well its contexts fit.
LIKE = {
    "email": lambda v: F.contains(v, F.lit("@")),
    "ip": lambda v: v.rlike(r"^[0-9]+(?:\.[0-9]+){3,}\.?$"),
    "card": lambda v: F.length(_digits(v)).between(12, 19),
    "phone": lambda v: F.length(_digits(v)).between(4, 15) & ~F.contains(v, F.lit("@")),
    SECRET: lambda v: (F.length(v) >= 8) & ~F.contains(v, F.lit("@")),
}
#: What a text must hold for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def _starts(pairs: Column, size: Column, chunk: int = 64) -> Column:
    """The running sum before each ``m`` of (s, m), each s and m behind the other, as starts of the m.

    An array that grows by one in a fold is copied at every step, so the sums
    run in chunks: over the chunks' totals, then within each chunk.
    """
    part = lambda c: F.slice(pairs, c * chunk + 1, F.lit(chunk))
    total = lambda c: F.aggregate(part(c), F.lit(0), lambda n, x: n + x["s"] + x["m"])
    grown = lambda acc, p, n: F.struct((p + n).alias("p"), F.concat(acc["a"], F.array(p)).alias("a"))
    none = lambda p: F.struct(p.alias("p"), F.array().cast("array<int>").alias("a"))
    numbers = F.when(size > 0, F.sequence(F.lit(0), F.ceil(size / chunk).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    offsets = F.aggregate(numbers, none(F.lit(0)), lambda acc, c: grown(acc, acc["p"], total(c)), lambda acc: acc["a"])
    inner = lambda c, p: F.aggregate(part(c), none(p), lambda acc, x: F.struct((acc["p"] + x["s"] + x["m"]).alias("p"), F.concat(acc["a"], F.array(acc["p"] + x["s"])).alias("a")), lambda acc: acc["a"])
    return F.flatten(F.zip_with(numbers, offsets, inner))


def _mentions(text: Column, kind: str) -> Column:
    """All valid matches, with code point offsets and the words around them.

    The pieces between matches and the matches themselves come from the same
    leftmost search, so running sums of their lengths are the offsets.
    """
    pattern = TOKEN if kind == "token" else PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    size = F.size(found)
    pairs = F.zip_with(F.slice(between, 1, size), found, lambda s, m: F.struct(F.length(s).alias("s"), F.length(m).alias("m")))
    starts = _starts(pairs, size)
    # The word before with what stands after it, and the word behind with what stands before it.
    left = F.transform(F.slice(between, 1, size), lambda s: F.lower(F.regexp_extract(F.right(s, F.lit(40)), r"([\p{L}\p{N}_]{1,24}[^\p{L}\p{N}_]{0,8})$", 1)))
    right = F.transform(F.slice(between, 2, F.greatest(size, F.lit(0))), lambda s: F.lower(F.regexp_extract(F.left(s, F.lit(40)), r"^([^\p{L}\p{N}_]{0,8}[\p{L}\p{N}_]{1,24})", 1)))
    spans = F.transform(
        F.arrays_zip(found.alias("v"), starts.alias("p"), left.alias("l"), right.alias("r")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["p"].alias("start"), (x["p"] + F.length(x["v"])).alias("end"), x["v"].alias("value"), x["l"].alias("left"), x["r"].alias("right")),
    )
    some = F.filter(spans, lambda x: VALID[kind](x["value"]))
    none = F.array().cast(SPAN)
    has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_instr(text, F.lit("[0-9]")) > 0
    return F.when(has, some).otherwise(none)


def base_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_key, id_col, base, others``: base matches by kind and start, and tokens with digits that no base match touches."""
    text = text_or_empty(text_col)
    rows = docs.select(row_key(id_col, text).alias("_key"), F.col(id_col).alias(id_col), text.alias("_t"))
    rows = rows.select("_key", id_col, F.concat(*(_mentions(F.col("_t"), k) for k in KINDS)).alias("base"), _mentions(F.col("_t"), "token").alias("tokens"))
    clear = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("_key", id_col, "base", clear.alias("others"))


def bootstrap(mentions: DataFrame, rounds: int = 3, min_support: int = 3, min_pattern: float = 0.5, min_score: float = 0.8) -> DataFrame:
    """``value, kind, score``: identifiers that the contexts of the seeds bring in.

    A pattern is the word before or after a mention with the signs between.
    Instances are distinct values: the seeds (base matches and tokens of a
    secret's shape, score 1 for their kind) and the other tokens with digits.
    Round by round, a pattern's confidence for a kind is the sum of its
    instances' scores over the number of its instances, if at least
    ``min_support`` instances support it and the confidence reaches
    ``min_pattern``; an instance's score for a kind that it looks like is the
    noisy-or of the best confidence on either side. Every round reads the
    whole graph; sums combine before they shuffle, and the instances of a
    frequent pattern meet its row in several parts.
    """
    rows = mentions.select(F.explode(F.concat("base", "others")).alias("m"))
    around = F.filter(F.array(F.concat(F.lit("<"), "m.left"), F.concat(F.lit(">"), "m.right")), lambda p: F.length(p) > 1)
    seed = F.when(F.col("m.kind") != "token", F.col("m.kind")).when(F.col("m.value").rlike(SECRET_SEED), SECRET)
    edges = shared(rows.select(F.col("m.value").alias("value"), seed.alias("seed"), F.explode(around).alias("pattern")).distinct())
    degree = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= min_support)
    edges = hot_join(edges, degree, ["pattern"], ["value"])  # a pattern with few instances never reaches the support; one without a seed may, from the second round on
    links = shared(edges.select("pattern", "degree", "value", "seed").distinct())
    seeds = links.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = seeds
    like = F.lit(False)
    for kind, looks in LIKE.items():
        like = F.when(F.col("kind") == kind, looks(F.col("value"))).otherwise(like)
    for turn in range(rounds):
        known = links.select("pattern", "degree", "value").distinct().join(scores, "value").groupBy("pattern", "kind").agg(F.first("degree").alias("degree"), F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support"))
        patterns = known.select("pattern", "kind", F.least(F.col("sum") / F.col("degree"), F.lit(0.999)).alias("conf"), "support").where((F.col("support") >= min_support) & (F.col("conf") >= min_pattern))
        met = hot_join(links.where("seed is null").select("pattern", "value"), patterns, ["pattern"], ["value"]).where(like)
        sides = met.groupBy("value", "kind").agg(*(F.max(F.when(F.startswith("pattern", F.lit(x)), F.col("conf")).otherwise(0.0)).alias(c) for x, c in (("<", "a"), (">", "b"))))
        fresh = sides.select("value", "kind", (1 - (1 - F.col("a")) * (1 - F.col("b"))).alias("score"))
        scores = fresh if turn == rounds - 1 else shared(seeds.unionByName(fresh))
    own = rows.select(F.col("m.value").alias("value"), seed.alias("kind"), F.lit(1.0).alias("score")).where(F.col("kind") == SECRET).distinct()  # base matches are found as they are
    best = scores.where(F.col("score") >= min_score).unionByName(own).groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b"))
    return best.select("value", "b.kind", "b.score")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of ``docs``, repeated ones too: ``id_col, base, found``, arrays of (kind, start, end, value).

    ``base`` has the pattern matches that hold up, ``found`` the tokens that
    bootstrapping accepts, under the kind whose contexts they share, and
    secrets. Offsets count code points, ends are exclusive; both are sorted by
    kind, in the order of ``KINDS`` with ``SECRET`` last, then start. A null
    text is empty; an empty table gives no rows; other columns are not read.
    """
    all_mentions = shared(base_mentions(docs, id_col, text_col))
    accepted = bootstrap(all_mentions, **more)
    others = all_mentions.select("_key", F.explode("others").alias("m")).select("_key", "m.start", "m.end", "m.value")
    found = hot_join(others, accepted, ["value"], ["_key"]).groupBy("_key").agg(F.collect_set(F.struct("kind", "start", "end", "value")).alias("found"))
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return all_mentions.join(found, "_key", "left").select(id_col, F.transform("base", slim).alias("base"), _in_order(F.coalesce("found", none)).alias("found"))


def _in_order(spans: Column) -> Column:
    """By kind as listed, secrets last, then start."""
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    return F.concat(*(F.array_sort(of(k), lambda a, b: a["start"] - b["start"]) for k in (*KINDS, SECRET)))


def pii_digest(docs: DataFrame, **more) -> DataFrame:
    """Counts and span strings: one row per row of ``docs``. ``n_found`` counts the spans that the method adds. A null text is empty, a null id stays null."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return find_pii(docs, **more).select("doc_id", *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(_in_order(F.concat("base", "found"))).alias("spans"), F.size("found").cast("bigint").alias("n_found"))
