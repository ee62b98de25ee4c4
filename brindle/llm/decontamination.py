"""Benchmark decontamination: windows of normalised test words, looked up in training texts.

The windows of all test items are a hash set that is broadcast, in blocks of a
checked size.  Training texts are scanned once for each block: a window whose
hash is in the set counts only if its words are the same too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace, sent

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = "struct<at:int,length:int>"


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _starts(ws: Column, length: Column) -> Column:
    """0, 1, ... of all windows of ``length`` words."""
    return F.when(F.size(ws) >= length, F.sequence(F.lit(0), F.size(ws) - length)).otherwise(F.array().cast("array<int>"))


def _window(ws: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(ws, at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, size: int = 10, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, window, length, items: each window once, with the items (as strings, sorted) that hold it.

    An item of fewer words than ``size``, but not none, is one window.  Null
    texts have no windows; those of null items are windows of no item.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws"))
    rows = rows.select("item", "ws", F.least(F.lit(size), F.size("ws")).alias("length")).filter("length > 0")
    each = rows.select("item", "length", F.explode(F.transform(_starts(F.col("ws"), F.col("length")), lambda i: _window(F.col("ws"), i, F.col("length")))).alias("window"))
    return each.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("window").alias("hash"), "window", "length", "items")


def find(
    docs: DataFrame, benchmark: DataFrame, *, size: int = 10, send_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Where windows of the benchmark stand in every whole text.

    Returns a row for each distinct (doc_id, text): doc_id, text_hash (md5, of
    null that of the empty text), copies (rows alike), n_words, spans (array of
    (at, length) in words, sorted, overlapping ones as they are) and items.
    Windows are broadcast in blocks of ``send_bytes``; every block is another
    scan of the texts.  Only hits, and one row for each text, shuffle.

    Null and empty texts have no words; null ids are an id.  Empty tables give
    no rows, or rows without hits.
    """
    space = Workspace(docs.sparkSession, "windows")
    known = space.save(benchmark_windows(benchmark, size, item_col=item_col, text_col=item_text_col), "windows")
    weight = F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64
    total = known.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    lengths = [r[0] for r in known.select("length").distinct().collect()]  # up to ``size``
    blocks = max(1, -(-total // send_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_hash"), words(F.col(text_col)).alias("ws"))
    ws = F.col("ws")
    head = F.array(F.struct(F.lit(-1).alias("at"), F.size(ws).alias("length"), F.lit(None).cast("string").alias("window")))

    def of_length(n: int) -> Column:
        return F.transform(_starts(ws, F.lit(n)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("length"), _window(ws, i, F.lit(n)).alias("window")))

    windows = [of_length(n) for n in sorted(lengths)]
    hits = None
    for b in range(blocks):
        each = texts.select("doc_id", "text_hash", F.explode(F.concat(*([head] if b == 0 else []), *windows)).alias("w"))
        each = each.select("doc_id", "text_hash", "w.at", "w.length", "w.window", F.xxhash64("w.window").alias("hash"))
        block = F.broadcast(known.filter(F.pmod("hash", F.lit(blocks)) == b).select("hash", F.col("window").alias("known"), "items"))  # send_bytes
        met = each.join(block, (each["hash"] == block["hash"]) & (F.col("window") == F.col("known")), "left").filter("at < 0 or known is not null")
        met = met.select("doc_id", "text_hash", "at", "length", "items")
        hits = met if hits is None else hits.union(met)
    is_hit = F.col("at") >= 0
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(is_hit, 0).otherwise(1)).alias("copies"),
        F.max(F.when(~is_hit, F.col("length"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, F.struct("at", "length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found


def hit_words(spans: Column) -> Column:
    """Places of the words inside any span, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))


def report(found: DataFrame) -> DataFrame:
    """A row for each row of the documents behind :func:`find`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = found.select("doc_id", "n_words", F.size(hit_words(F.col("spans"))).cast("long").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, found: DataFrame, *, how: str = "spans", send_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without what :func:`find` hit.

    how "documents": contaminated rows go.  how "spans": their hit words go, each
    with what stands between it and the next word; all rows stay.  Hits meet
    their texts by a broadcast up to ``send_rows`` of them, else by a shuffle.
    Rows without hits, null texts too, stay as they are.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how is spans or documents")
    bad = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    bad = sent(Workspace(docs.sparkSession, "hits").save(bad, "bad"), send_rows)
    text = docs[text_col]
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(text, F.lit("")).cast("binary")) == F.col("__hash"))
    if how == "documents":
        return docs.join(bad, same, "left_anti").select(*docs.columns)
    both = docs.join(bad, same, "left")
    ws, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    both = both.withColumn("__ws", F.when(F.col("__spans").isNotNull(), ws)).withColumn("__gaps", F.when(F.col("__spans").isNotNull(), gaps))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ws") - 1), hit_words(F.col("__spans")))
    rest = F.concat(F.get("__gaps", F.lit(0)), F.array_join(F.transform(left, lambda i: F.concat(F.get("__ws", i), F.get("__gaps", i + 1))), ""))
    return both.select(*[(F.when(F.col("__spans").isNull(), text).otherwise(rest) if c == text_col else docs[c]).alias(c) for c in docs.columns])
