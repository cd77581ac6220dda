"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import fresh, map_batches, row_key, shared, text_or_empty, tidy

BASE, MODULUS = 1_000_003, (1 << 61) - 1


def chunks(text: bytes, divisor: int = 2, window: int = 2, long_words: int = 50) -> list[tuple[list[bytes], int]]:
    """The text as chunks (lines, words), boundaries set by content.

    A rolling hash runs over the hashes of the last ``window`` lines; a chunk
    ends where it is divisible by ``divisor``. A line of ``long_words`` words
    or more, a passage by itself, is a chunk of its own. So a boundary depends
    on lines near it alone, and text put in elsewhere shifts no other chunk.
    """
    out: list[tuple[list[bytes], int]] = []
    lines, count, rolling, recent = [], 0, 0, []
    leave = pow(BASE, window, MODULUS)
    for line in text.split(b"\n"):
        n = len(line.split())
        h = int.from_bytes(blake2b(line, digest_size=7).digest(), "little")
        recent.append(h)
        rolling = (rolling * BASE + h) % MODULUS
        if len(recent) > window:
            rolling = (rolling - recent.pop(0) * leave) % MODULUS
        if n >= long_words:
            if lines:
                out.append((lines, count))
            out.append(([line], n))
            lines, count, rolling, recent = [], 0, 0, []
            continue
        lines.append(line)
        count += n
        if rolling % divisor == 0:
            out.append((lines, count))
            lines, count = [], 0
    if lines:
        out.append((lines, count))
    return out


def removed_runs(sizes: list[tuple[int, int]], repeated: set[int], min_words: int) -> set[int]:
    """Of the repeated chunks, those in runs of neighbours with at least ``min_words`` words; sizes: (lines, words) of each chunk."""
    out: set[int] = set()
    run: list[int] = []
    for i in [*range(len(sizes)), -1]:
        if i in repeated:
            run.append(i)
            continue
        if run and sum(sizes[k][1] for k in run) >= min_words:
            out.update(run)
        run = []
    return out


def passages(lines: list[bytes], min_words: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Words of each line, and the ranges (start, end) of lines that are the shortest of ``min_words`` words or more from their start or to their end.

    Ranges start and end with a line of words. A run of whole lines that stood
    elsewhere is the union of such ranges, and each of them stood there too: a
    line with enough words up to it ends a range inside the run, and any line
    before lies in the range from the run's start. Two lines that are both long
    enough alone are also a range if lines without words stand between them.
    """
    counts = [len(x.split()) for x in lines]
    start, held, at = 0, 0, [i for i, n in enumerate(counts) if n]
    found = {(a, b + 1) for a, b in zip(at, at[1:]) if b - a > 1 and min(counts[a], counts[b]) >= min_words}
    for k, i in enumerate(at):  # to the end i
        held += counts[i]
        while held - counts[at[start]] >= min_words:
            held -= counts[at[start]]
            start += 1
        if held >= min_words:
            found.add((at[start], i + 1))
    end, held = len(at) - 1, 0
    for k in range(len(at) - 1, -1, -1):  # from the start at[k]
        held += counts[at[k]]
        while held - counts[at[end]] >= min_words:
            held -= counts[at[end]]
            end -= 1
        if held >= min_words:
            found.add((at[k], at[end] + 1))
    return counts, sorted(found)


def passage_hashes(text: bytes, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of each of the ``passages``; 256 bits of the hashes of their lines."""
    lines = text.split(b"\n")
    _, ranges = passages(lines, min_words)
    each = [blake2b(x, digest_size=32).digest() for x in lines] if ranges else []
    return [(a, b, blake2b(b"".join(each[a:b]), digest_size=32).digest()) for a, b in ranges]


def _chunk_rows(source: DataFrame, kind: str, divisor: int, window: int, long_words: int, bodies: bool = True) -> DataFrame:
    """``_key, _id, no, at, head, tail, words, h`` and with ``bodies`` ``body`` of each chunk: its number, first line, first line of words, end of the last one, words, hash and bytes."""
    names = ["_key", "_id", "no", "at", "head", "tail", "words", "h", *(["body"] if bodies else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in names)
            held = 0
            for k, i, t in zip(b.column(0), b.column(1), b.column(2)):
                k, i, at = k.as_py(), i.as_py(), 0
                for no, (lines, n) in enumerate(chunks(t.as_py(), divisor, window, long_words)):
                    body = b"\n".join(lines)
                    held += len(body) if bodies else 0
                    full = [at + x for x, line in enumerate(lines) if line.strip()] if n else [None]
                    for c, x in zip(cols, (k, i, no, at, full[0], full[-1] + 1 if n else None, n, blake2b(body, digest_size=16).digest(), body)):
                        c.append(x)
                    at += len(lines)
                if held > 1 << 22:
                    yield batch(cols, b)
                    cols, held = tuple([] for _ in names), 0
            yield batch(cols, b)

    def batch(cols, b) -> pa.RecordBatch:
        kinds = (pa.binary(), b.column(1).type, *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary())[: len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return map_batches(source, cut, f"_key binary, _id {kind}, no int, at int, head int, tail int, words bigint, h binary{', body binary' if bodies else ''}")


def _repeats(source: DataFrame, place: Column, *cut) -> DataFrame:
    """The chunks that are not the first of their content by ``place``, without bytes, and ``first``, the place of that one; ``cut`` goes to ``_chunk_rows``."""
    each, slim = _chunk_rows(source, *cut), _chunk_rows(source, *cut, bodies=False)
    bodies = each.groupBy("h", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = shared(bodies.where("n > 1").groupBy("h").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("bodies")))
    names = [c for c in slim.columns if c != "h"]
    repeats = slim.join(groups.where("bodies = 1").hint("shuffle_hash"), "h").select(*names, "first")
    clash = groups.where("bodies > 1").select("h")
    if not clash.isEmpty():
        apart = each.join(clash, "h", "left_semi").join(bodies.where("n > 1").join(clash, "h", "left_semi").select("h", "body", "first"), ["h", "body"])
        repeats = repeats.unionByName(apart.select(*names, "first"))
    return repeats.where(~place.eqNullSafe(F.col("first")))


def _chunks_gone(source: DataFrame, kind: str, divisor: int, window: int, long_words: int) -> DataFrame:
    """``_key, _gone``: numbers of the chunks that are not the first of their content."""
    return _repeats(source, F.struct("_id", "no", "_key"), kind, divisor, window, long_words).groupBy("_key").agg(F.collect_set("no").alias("_gone"))


def _chunk_runs(source: DataFrame, kind: str, min_words: int, divisor: int, window: int, long_words: int) -> DataFrame:
    """``_key, no, end``: runs of neighbouring repeated chunks whose first occurrences are neighbours in one document too, from the first line of words to the last, with enough words."""
    found = _repeats(source, F.struct("_id", "at", "_key", "no"), kind, divisor, window, long_words)
    same = ["_key", "_first", "_off"]
    found = found.withColumn("_first", F.col("first._key")).withColumn("_off", F.col("first.no") - F.col("no"))
    order = Window.partitionBy(*same).orderBy("no")  # rows of repeated documents have equal numbers, and one of them is enough
    found = found.withColumn("_run", F.col("no") - F.dense_rank().over(order)).withColumn("_before", F.lag("no").over(order))
    runs = found.where(F.col("_before").isNull() | (F.col("_before") != F.col("no"))).groupBy(*same, "_run").agg(F.min("head").alias("_head"), F.max("tail").alias("_tail"), F.sum("words").alias("_words"))
    return runs.where(F.col("_words") >= min_words).select("_key", F.col("_head").alias("no"), F.col("_tail").alias("end"))


def _whole_gone(source: DataFrame, kind: str, min_words: int, divisor: int, window: int, long_words: int) -> DataFrame:
    """``_key, _gone``: numbers of the lines inside passages that stood before.

    Runs of repeated chunks come first. What they leave, passages that begin
    or end inside a chunk or whose chunks have their first occurrences apart,
    is then compared by the ``passages`` that lie in no such run. The first
    occurrence of a passage never does, as the whole run stood before it.
    Joins hash the side of what repeats, which is the smaller one.
    """
    runs = shared(_chunk_runs(source, kind, min_words, divisor, window, long_words))
    tidy(source.sparkSession)  # the bytes of chunks need not lie on disk any longer
    spans = _passages_left(source, kind, min_words, runs).unionByName(runs).groupBy("_key").agg(F.collect_set(F.struct("no", "end")).alias("at"))
    return spans.select("_key", F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["no"], x["end"] - 1)))).alias("_gone"))


def _passages_left(source: DataFrame, kind: str, min_words: int, runs: DataFrame) -> DataFrame:
    """``_key, no, end``: passages outside of ``runs`` that are not the first of their content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, at, ends, hashes = [], [], [], [], []
            for n, (k, t) in enumerate(zip(b.column(0), b.column(2))):
                for start, end, h in passage_hashes(t.as_py(), min_words):
                    keys.append(k.as_py())
                    ids.append(n)
                    at.append(start)
                    ends.append(end)
                    hashes.append(h)
            own = b.column(1).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), own, pa.array(at, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.binary())], names=["_key", "_id", "no", "end", "h"])

    inside = runs.select(F.col("_key").alias("_in"), F.explode(F.sequence("no", F.col("end") - 1)).alias("_line"), F.col("end").alias("_end"))
    each = map_batches(source, cut, f"_key binary, _id {kind}, no int, end int, h binary")
    each = each.join(inside.hint("shuffle_hash"), (F.col("_key") == F.col("_in")) & (F.col("no") == F.col("_line")) & (F.col("end") <= F.col("_end")), "left_anti")
    groups = shared(each.groupBy("h").agg(F.min(F.struct("_id", "no", "_key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first.no", "first._key"))
    tidy(source.sparkSession)
    first = groups.select("h", F.col("no").alias("_no"), F.col("_key").alias("_first"))
    later = each.select("_key", "no", "end", "h").join(first.hint("shuffle_hash"), "h").where((F.col("_key") != F.col("_first")) | (F.col("no") != F.col("_no")))
    return later.select("_key", "no", "end")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30, divisor: int = 2, window: int = 2, long_words: int = 50, report: bool = False, count_col: str | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut from ``text_col``; with ``report``, also ``n_lines, n_chunks, n_removed, removed_words``.

    ``count_col``, if given, names a column that gets the length of the new
    text where it changed.

    Of equal chunks all over the table, the occurrence of smallest (id, place)
    stays; the others go where they, with the repeated chunks next to them,
    make ``min_words`` words or more, which short stock lines alone don't.
    Rows stay, with the rest of their lines, even where nothing is left of
    the text. A text without removals is unchanged; a null stays null and
    counts as empty; an empty table gives no rows. Columns named as those of
    the report are replaced by it. Rows that repeat an id with an equal text are one
    document. A null id counts as the smallest.

    Chunks are grouped by a 128-bit hash *and* their bytes, combined before
    the shuffle, so a chunk in a third of all documents is one row a task.
    Occurrences then find their group by hash alone, without text, unless two
    contents met under one hash. What goes out of a document comes back as
    chunk numbers, at most as many as it has lines.

    With ``whole``, every run of whole lines with ``min_words`` words or more
    that stood before, by (id, place), goes, from its first line of words to
    its last, wherever it starts and ends. Chunks as above find the runs that
    are made of whole chunks; an exact comparison of what lies in none of these
    finds those that begin or end inside a chunk, by 256-bit hashes. Lines are
    then the chunks that the report counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = row_key(id_col, text_or_empty(text_col))
    source = docs.select(key.alias("_key"), F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_t"))

    gone = _whole_gone(source, kind, min_words, divisor, window, long_words) if whole else _chunks_gone(source, kind, divisor, window, long_words)
    told_names = ("n_lines", "n_chunks", "n_removed", "removed_words")
    extra = [fresh(docs.columns, f"_r_{c}") for c in told_names]
    key_name, gone_name, text_name = (fresh(docs.columns, c) for c in ("_key", "_gone", "_t"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, told = [], [[] for _ in extra]
            for t, numbers in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                t, repeated = t.as_py(), set(numbers.as_py() or ())
                if t is None or not (repeated or report):
                    texts.append(t)
                    drop, parts = set(), []
                else:
                    if whole:
                        parts, drop = [([x], len(x.split())) for x in t.encode().split(b"\n")], repeated
                    else:
                        parts = chunks(t.encode(), divisor, window, long_words)
                        drop = removed_runs([(len(a), n) for a, n in parts], repeated, min_words)
                    texts.append(b"\n".join(x for i, (a, _) in enumerate(parts) if i not in drop for x in a).decode() if drop else t)
                for c, x in zip(told, (sum(len(a) for a, _ in parts), len(parts), len(drop), sum(parts[i][1] for i in drop))):
                    c.append(x)
            kept = b.columns[: b.num_columns - 2]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in told)], names=[*rest, text_name, *extra])

    rest = [c for c in docs.columns if c != text_col]
    gone = gone.select(F.col("_key").alias(key_name), F.col("_gone").alias(gone_name))
    joined = docs.withColumn(key_name, key).join(gone, key_name, "left").select(*rest, F.col(text_col).cast("string").alias(text_name), gone_name)
    from pyspark.sql import types as T

    schema = T.StructType([*joined.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in extra)])
    made = map_batches(joined, rebuild, schema).withColumnRenamed(text_name, text_col)
    if count_col is not None:
        made = made.withColumn(count_col, F.when(F.col(extra[2]) > 0, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    told = [F.col(c).alias(name) for c, name in zip(extra, told_names)] if report else []
    return made.select(*(c for c in docs.columns if not report or c not in told_names), *told)


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what was cut, and the hash of what is left. Null and empty texts have one line without words, and an empty rest."""
    done = line_dedup(docs.select("doc_id", "text"), report=True, whole=True)
    return done.select("doc_id", "n_lines", "n_chunks", "n_removed", "removed_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
