"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of n-grams, scanned by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fresh, row_key, shared, text_or_empty, words


def _grams(ws: Column, n: int | Column) -> Column:
    """The hash of each window of n words, by its place from 0; none if the text is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, n)))


def _place(pos: Column, size: Column, lengths: list[int]) -> tuple[Column, Column]:
    """Place and length of a window from its position among the windows of all lengths, one length behind the other."""
    at, n, before = F.lit(-1), F.lit(0), F.lit(0)
    ends = []
    for k in lengths:
        ends.append((before, before + F.greatest(size - k + 1, F.lit(0)), k))
        before = ends[-1][1]
    for first, end, k in reversed(ends):
        at, n = F.when(pos < end, pos - first).otherwise(at), F.when(pos < end, k).otherwise(n)
    return at, n


def benchmark_windows(items: DataFrame, n: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``n, h, gram, items``: each distinct window with the ids that hold it, one row per text of a window.

    An item of fewer than n words, but not none, is one window. Ids are strings, sorted.
    """
    ws = items.select(F.col(id_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("ws")).where(F.size("ws") > 0)
    k = F.least(F.lit(n), F.size("ws"))
    each = ws.select("item", "ws", k.cast("int").alias("n"), F.posexplode(_grams(F.col("ws"), k)).alias("at", "h"))
    return each.select("item", "n", "h", F.slice("ws", F.col("at") + 1, F.col("n")).alias("gram")).groupBy("n", "h", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, items: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``_key, id_col, copies, n_words, n_hit, n_items, items, spans`` for each distinct (id, text) of ``docs``; ``copies`` counts its rows.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` has the
    ids with occurring windows sorted as strings, and ``spans`` the hit word
    ranges (start, end exclusive), merged and in order. Null and empty texts
    have no words and no hits. Without items, or without documents, nothing is
    hit.

    The windows of the benchmark are counted first. Up to
    ``broadcast_windows`` of them (each counts for every item that holds it)
    and ``broadcast_bytes`` of text they are a broadcast hash table, and the
    rows of a document are combined in the task that made them; each document
    also emits one row without a hash, so that one pass keeps documents
    without hits. Beyond that hashes and places alone are shuffled to the
    windows, and the few that meet one go back to their document's words. In
    either form a hit of the hash is verified word by word.
    """
    windows = shared(benchmark_windows(items, n, item_id, item_text))
    bound = windows.agg(F.sum(F.size("items")).alias("n"), F.sum(F.octet_length(F.array_join("gram", " "))).alias("bytes")).first()
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # n values at most
    table = windows.select(F.col("n").alias("w_n"), F.col("h").alias("w_h"), "gram", "items")
    base = docs.select(row_key(id_col, text_or_empty(text_col)).alias("_key"), F.col(id_col).alias("_id"), words(text_or_empty(text_col)).alias("ws"))
    grams = [_grams(F.col("ws"), k) for k in lengths]
    kind = "array<struct<at:int,end:int>>"
    if (bound["n"] or 0) <= broadcast_windows and (bound["bytes"] or 0) <= broadcast_bytes:
        # Position 0 is the document's own row. One long is the key and a long is all that a window adds to a row; place and length are worked out for hits alone.
        own = F.array(F.lit(None).cast("bigint"))
        scan = base.select("_key", "_id", "ws", F.posexplode(F.concat(own, *grams)).alias("pos", "h"))
        at, length = _place(F.col("pos") - 1, F.size("ws"), lengths)
        same = (F.col("h") == F.col("w_h")) & (length - F.col("w_n") == 0) & (F.slice("ws", F.greatest(at + 1, F.lit(1)), F.col("w_n")) == F.col("gram"))
        met = scan.join(F.broadcast(table), same, "left").where(F.col("gram").isNotNull() | (F.col("pos") == 0))
        hit = F.col("gram").isNotNull()
        rows = met.groupBy("_key").agg(
            F.first("_id").alias(id_col),
            F.sum(F.when(~hit, 1)).alias("copies"),
            F.max(F.when(~hit, F.size("ws"))).cast("bigint").alias("n_words"),
            F.collect_set(F.when(hit, F.struct(at.alias("at"), (at + F.col("w_n")).alias("end")))).alias("_at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    else:
        scan = base.select("_key", F.size("ws").alias("size"), F.posexplode(F.concat(*grams)).alias("pos", "h"))
        at, length = _place(F.col("pos"), F.col("size"), lengths)
        scan = scan.select("_key", at.alias("at"), length.alias("n"), "h")
        met = scan.join(table, (F.col("h") == F.col("w_h")) & (F.col("n") == F.col("w_n")))
        each = met.groupBy("_key").agg(F.collect_set(F.struct("at", "n", "gram", "items")).alias("met"))
        once = base.groupBy("_key").agg(F.first("_id").alias(id_col), F.count(F.lit(1)).alias("copies"), F.first("ws").alias("ws"))
        true = F.filter("met", lambda m: F.slice("ws", m["at"] + 1, m["n"]) == m["gram"])
        rows = once.join(each, "_key", "left").withColumn("met", true).select(
            "_key", id_col, "copies", F.size("ws").cast("bigint").alias("n_words"),
            F.coalesce(F.transform("met", lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["n"]).alias("end"))), F.array().cast(kind)).alias("_at"),
            F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda m: m["items"])))), F.array().cast("array<string>")).alias("items"),
        )
    # Hit words in order; a span starts where the word before is none and ends where the next is none.
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("_at", lambda x: F.sequence(x["at"], x["end"] - 1)))))
    at = lambda i: F.get("_hits", i)
    starts = F.filter("_hits", lambda w, i: (i == 0) | (at(i - 1) != w - 1))
    ends = F.filter("_hits", lambda w, i: (i == F.size("_hits") - 1) | (at(i + 1) != w + 1))
    spans = F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("at"), (y + 1).alias("end")))
    return rows.withColumn("_hits", hits).select("_key", id_col, "copies", "n_words", F.size("_hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", spans.alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 8, min_items: int = 2, mode: str = "documents", least_words: int = 0, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", weak_words: int = 0, item_id: str = "item_id", **more) -> DataFrame:
    """``docs`` without contamination, same columns.

    ``mode="documents"`` drops documents in which windows of ``min_items`` or
    more items occur; ``mode="spans"`` keeps each document and cuts the hit
    words out of such ones. Items of fewer than ``least_words`` words are left
    out: a few common words are no sign of a benchmark. Items of fewer than
    ``weak_words`` words stay in, but count only where another item occurs
    too, whatever ``min_items`` is. Null and empty texts
    are never hit; rows that repeat an id and text share their fate; an empty
    benchmark drops nothing.
    """
    if least_words:
        items = items.where(F.size(words(text_or_empty(item_text))) >= least_words)
    enough = F.col("n_items") >= min_items
    if weak_words:
        weak = F.size(words(text_or_empty(item_text))) < weak_words
        items = items.withColumn(item_id, F.concat(F.when(weak, "w").otherwise("s"), F.coalesce(F.col(item_id).cast("string"), F.lit(""))))
        strong = F.size(F.filter("items", lambda i: F.startswith(i, F.lit("s"))))
        enough = (strong >= min_items) | (F.col("n_items") >= max(min_items, 2))
    key, spans = fresh(docs.columns, "_key"), fresh(docs.columns, "_spans")
    found = find_hits(docs, items, n, id_col, text_col, item_id, item_text, **more).where(enough).select(F.col("_key").alias(key), F.col("spans").alias(spans))
    keyed = docs.withColumn(key, row_key(id_col, text_or_empty(text_col)))
    if mode == "documents":
        return keyed.join(found.select(key), key, "left_anti").select(*docs.columns)
    if mode != "spans":
        raise ValueError(mode)
    cut = keyed.join(found, key, "left").withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(spans))))
    return cut.select(*docs.columns)


def _without(text: Column, spans: Column) -> Column:
    """The text without the words in the spans and what stands between those words."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    is_word = lambda p: p.rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    first = F.when(is_word(F.try_element_at(parts, F.lit(1))), 0).otherwise(1)
    # Words and gaps alternate: word w is part first + 2w, from 0. A span of words also takes the gaps inside it.
    inside = lambda i: F.exists(spans, lambda s: (i >= first + 2 * s["at"]) & (i <= first + 2 * (s["end"] - 1)))
    return F.array_join(F.filter(parts, lambda p, i: ~inside(i)), "")


def contamination_digest(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """The digest columns of the report: one row per row of ``docs``, repeated ones too. Null and empty texts have no words; a null id stays null."""
    found = find_hits(docs, items, **more).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))
