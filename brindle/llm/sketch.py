"""Threshold-scaled sketches of documents.

A sketch keeps every shingle hash below a fixed fraction of the hash space, and
the lowest ``least`` hashes in any case, so that a short text has some.  Both
rules hold for any set of shingles: a sketch of two texts together is the union
of theirs, cut by the same rules (:func:`merge`).  How far up a sketch is whole
can be told from its hashes (:func:`reach`), so two sketches of very unequal
texts, stored ones too, are compared as far as both are.  Hashes have 32 bits.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality import words_of
from .workspace import shuffle_partitions


#: The part of the 64-bit hashes that is kept.
HIGH = -(1 << 32)


def shingle_hashes(words: str, size: int = 5) -> Column:
    """Hashes of all runs of ``size`` words of an array column; fewer words are one shingle, none are none."""
    high = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(HIGH))
    run = F.transform(words, lambda x, i: high(x, *[F.get(words, i + j) for j in range(1, size)]))
    whole = F.when(F.size(words) > 0, F.array(high(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= size, F.slice(run, F.lit(1), F.size(words) - size + 1)).otherwise(whole)


def limit(scale: int) -> int:
    """Where the lowest 1/scale of the hash space ends."""
    return -(1 << 63) + (1 << 64) // scale


def cut(hashes: Column, scale: int, least: int = 0) -> Column:
    """Of distinct hashes those below the limit, and the ``least`` lowest, ascending."""
    if scale == 1:
        return F.array_sort(hashes)
    low = F.filter(hashes, lambda h: h < F.lit(limit(scale)))
    return F.when(F.size(low) >= least, F.array_sort(low)).otherwise(F.slice(F.array_sort(hashes), 1, max(1, least)))


def with_sketch(df: DataFrame, text: Column, name: str, *, size: int = 5, scale: int = 8, least: int = 0) -> DataFrame:
    """``df`` with the sketch of ``text`` (array of long) as column ``name``.  Null texts have an empty one."""
    held = [c for c in df.columns if c != name]
    split = df.select(*held, words_of(F.coalesce(text, F.lit(""))).alias("__words"))
    hashed = split.select(*held, F.array_distinct(shingle_hashes("__words", size)).alias("__hashes"))
    return hashed.select(*held, cut(F.col("__hashes"), scale, least).alias(name))


def merge(a: Column, b: Column, *, scale: int = 8, least: int = 0) -> Column:
    """Sketch of two texts' shingles together, of theirs."""
    return cut(F.array_union(a, b), scale, least)


def reach(sketch: Column, scale: int, least: int) -> Column:
    """The hash up to which a sketch holds all of its text's: fewer hashes than ``least`` are all there are."""
    last = F.when(F.size(sketch) > 0, F.element_at(sketch, -1))
    return F.when(F.size(sketch) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(limit(scale) - 1), last))


def alike(a: Column, b: Column, scale: int, least: int) -> Column:
    """:func:`containment` of two sketches as far as both are whole."""
    common = F.least(reach(a, scale, least), reach(b, scale, least))
    return containment(F.filter(a, lambda h: h <= common), F.filter(b, lambda h: h <= common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that the larger one holds.

    Two empty sketches are alike (1) only if there was nothing to sketch in
    either; the caller knows.  Here: 0 where either is empty.
    """
    common = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, common / least).otherwise(F.lit(0.0))


def as_text(sketch: Column) -> Column:
    """Hashes in eight hexadecimal digits each, ascending, joined by commas."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 32))), 8, "0")), ",")


def from_text(fingerprint: Column) -> Column:
    """The sketch that :func:`as_text` wrote."""
    parts = F.filter(F.split(fingerprint, ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.shiftleft(F.conv(x, 16, 10).cast("long"), 32))


def _buckets(place: Column, bounds: Column) -> Column:
    """How many of the bounds (an array of arrays, each begun by a bound that opens it) are not over a place: two short searches."""
    outer = F.size(F.filter(bounds, lambda part: F.get(part, F.lit(0)) <= place))
    inner = F.get(bounds, outer - 1)
    full = F.aggregate(F.slice(bounds, F.lit(1), F.greatest(outer - 1, F.lit(0))), F.lit(0), lambda n, part: n + F.size(part))
    return F.when(outer > 0, full + F.size(F.filter(inner, lambda b: b <= place))).otherwise(F.lit(0))


def next_in_order(docs: DataFrame, key: str, carried: list[str], *, rows_per_bucket: int = 4096, max_buckets: int = 65_536, samples: int = 16) -> DataFrame:
    """Each row with the carried columns of the next one in descending order of ``key`` (after the last: the first), as ``next_<column>``; and its bucket.

    Rows are dealt to buckets of about ``rows_per_bucket``, by bounds out of a
    sample by hash (``samples`` to a bucket), whatever the values of the keys.
    The row that a bucket's last one needs, the first of the next bucket, is
    copied into it beforehand, so one exchange of the rows does.  The copies'
    places are broadcast: max_buckets of them at most.

    Null keys come last.  Rows of equal keys follow one another in the order of
    a hash of the first carried column, then of the carried columns; so rows of
    one key, null too, go to many buckets as well, unless that column is equal,
    too.  A row that is alone is its own next.
    """
    rows = docs.select(F.col(key).cast("long").alias("__key"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(carried)])
    # ascending: descending keys, nulls last, then the hash
    place = F.struct(F.col("__key").isNull().alias("none"), F.coalesce(F.bitwise_not("__key"), F.lit(0).cast("long")).alias("down"), F.xxhash64("__v0").alias("hash"))
    shape = "none boolean, down bigint, hash bigint"
    placed = rows.withColumn("__place", place)
    places = docs.select(F.col(key).cast("long").alias("__key"), F.col(carried[0]).alias("__v0")).select(place.alias("place"))
    n = docs.count()
    buckets = max(2, min(max_buckets, max(shuffle_partitions(docs.sparkSession), math.ceil(n / rows_per_bucket))))
    drawn = places.filter(F.pmod(F.xxhash64("place"), F.lit(max(1, n // (samples * buckets)))) == 0).groupBy("place").count().collect()  # about samples * max_buckets
    drawn = sorted((r["place"]["none"], r["place"]["down"], r["place"]["hash"], r["count"]) for r in drawn)
    bounds, held, each = [], 0, sum(r[3] for r in drawn) / buckets
    for none, down, hash_, count in drawn:
        if held >= each:
            bounds.append((none, down, hash_))
            held = 0
        held += count
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    spark = docs.sparkSession
    sent = F.broadcast(spark.createDataFrame([(parts,)], f"bounds array<array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>>"))
    bucket = _buckets(F.col("place"), F.col("bounds"))
    tops = places.crossJoin(sent).groupBy(bucket.alias("b")).agg(F.min("place").alias("place")).orderBy("b").collect()  # max_buckets rows at most
    copies = [(tops[i - 1]["b"], *tops[i]["place"]) for i in range(len(tops))]  # the last bucket gets the first row
    ghosts = spark.createDataFrame(copies, f"b int, {shape}").groupBy(F.struct("none", "down", "hash").alias("place")).agg(F.collect_list("b").alias("into"))
    values = [f"__v{i}" for i in range(len(carried))]
    there = placed.crossJoin(sent).withColumn("__b", _buckets(F.col("__place"), F.col("bounds"))).join(F.broadcast(ghosts), F.col("__place") == F.col("place"), "left")
    own = F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("copy")))
    also = F.transform("into", lambda b: F.struct(b.alias("b"), F.lit(1).alias("copy")))
    dealt = there.select("__key", "__place", *values, F.explode(F.when(F.col("into").isNull(), own).otherwise(F.concat(own, also))).alias("__to"))
    dealt = dealt.select("__key", "__place", *values, "__to.b", "__to.copy")
    order = Window.partitionBy("b").orderBy("copy", "__place", *values)
    after = dealt.select("*", *[F.lead(v).over(order).alias(f"__n{i}") for i, v in enumerate(values)])
    return after.filter(F.col("copy") == 0).select(
        F.col("__key").alias(key), *[F.col(f"__v{i}").alias(c) for i, c in enumerate(carried)], *[F.col(f"__n{i}").alias(f"next_{c}") for i, c in enumerate(carried)], F.col("b").alias("bucket")
    )


def fingerprints(docs: DataFrame, *, size: int = 5, scale: int = 8, least: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every whole text and of its edited text, and their likeness.

    The edited text has its last third (in code points, rounded down) replaced
    by as many of the first of the next document's, or all if it has fewer; next
    is descending by id, after the last the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A fingerprint is the sketch's hashes in hexadecimal,
    ascending, joined by commas.  Likeness is the containment of the smaller
    sketch, as far as both are whole, and can be worked out from stored
    fingerprints (:func:`from_text`, :func:`alike`).  It is 1 where both texts are equal, and else 0 if either
    has no hashes so far: a text of n shingles, fewer than ``least``, beside a long one with probability (1 - 1/``scale``)^n.

    Null texts are empty ones.  Null ids come last in the order.  Rows of equal ids
    follow one another, by a hash of their texts.  An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_sketch(rows, F.col("text"), "sketch", size=size, scale=scale, least=least)
    pairs = next_in_order(own, "doc_id", ["text", "sketch"])
    third = F.floor(F.length("text") / 3).cast("int")
    parts = pairs.select("*", F.length("text").cast("long").alias("n_chars"), third.alias("__third"))
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("__third")), F.substr("next_text", F.lit(1), F.col("__third")))
    made = parts.select("doc_id", "n_chars", "sketch", "next_sketch", (F.col("text") == F.col("next_text")).alias("__same"), edited.alias("__edited"), "text")
    made = made.select("*", (F.col("text") == F.col("__edited")).alias("__unedited"), F.sha2("__edited", 256).alias("edited_sha256")).drop("text")
    both = with_sketch(made, F.col("__edited"), "__sketch2", size=size, scale=scale, least=least)
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("__sketch2")).alias("edited_fingerprint"),
        F.when(F.col("__unedited"), F.lit(1.0)).otherwise(alike(F.col("sketch"), F.col("__sketch2"), scale, least)).alias("near_edited"),
        F.when(F.col("__same"), F.lit(1.0)).otherwise(alike(F.col("sketch"), F.col("next_sketch"), scale, least)).alias("near_next"),
    )
