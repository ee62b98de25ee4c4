"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words with the
same letters share it.  Two words that are one letter apart have keys that
differ by that letter's value (addition, removal) or by the difference of two
values (exchange).  Taking one letter's value off on either side makes these
equal: the join is on the integer key, and the letters' order is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
#: Keys are sums modulo this prime; values of single letters and their differences stay far below it.
MODULUS = (1 << 61) - 1


def letter_value(letter: Column) -> Column:
    """The fifth power of the code point: no two pairs of letters have the same difference."""
    point = F.ascii(letter).cast("long")
    return point * point * point * point * point


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def anagram_key(word: Column) -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda s, c: (s + letter_value(c)) % MODULUS)


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("t"))


def count_words(docs: DataFrame, *, min_chars: int = 6, min_count: int = 5, drop_every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters (A-Z as a-z) of every whole text with ``min_chars`` letters and ``min_count`` occurrences at least.

    Where ``drop_every`` divides the crc32 of ``<id>:<run>``, the run loses the
    letter at that number modulo its length first.  Null texts have no runs, a
    null id is an empty one.
    """
    each = _text(docs, id_col, text_col).select("id", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= min_chars)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % drop_every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def probes(known: DataFrame) -> DataFrame:
    """Keys to be joined: kind, m, side, half, key, word, n.

    kind "self": the word's own key; "longer": without one letter's value, to
    meet a word that lacks it; "peer": the same, to meet words of its length with
    another letter there.  Of two words one letter apart, either the first m/2
    letters are the same (side 0) or the last ones (side 1), m being the shorter
    one's length: their hash is joined too, so words with the same letters in
    other orders don't all meet.
    """
    w, length = F.col("word"), F.length("word")

    def rows(kind: str, m: Column, side: int, cut: Column, removed: bool) -> Column:
        head, tail = F.substr(w, F.lit(1), cut), F.substr(w, cut + 1)
        half, other = (head, tail) if side == 0 else (tail, head)
        key = lambda c: F.pmod(F.col("key") - letter_value(c), F.lit(MODULUS)) if removed else F.col("key")
        gone = F.array_distinct(letters(other)) if removed else F.array(F.lit(None).cast("string"))
        return F.transform(gone, lambda c: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.lit(side).alias("side"), F.xxhash64(half).alias("half"), key(c).alias("key")))

    own, shorter = F.floor(length / 2).cast("int"), F.floor((length - 1) / 2).cast("int")
    made = [rows("self", length, 0, own, False), rows("self", length, 1, own, False), rows("peer", length, 0, own, True), rows("peer", length, 1, own, True)]
    made += [rows("longer", length - 1, 0, shorter, True), rows("longer", length - 1, 1, shorter + 1, True)]
    keyed = known.select("word", "n", anagram_key(w).alias("key"))
    return keyed.select("word", "n", F.explode(F.concat(*made)).alias("p")).select("p.*", "word", "n")


def near_words(known: DataFrame, space: Workspace) -> DataFrame:
    """word, near, near_n: both directions of all pairs that differ by exactly one inserted, deleted or replaced letter."""
    table = space.save(probes(known), "probes")
    named = lambda kind, to: table.filter(F.col("kind") == kind).select("m", "side", "half", "key", F.col("word").alias(f"{to}"), F.col("n").alias(f"{to}_n"))
    one_apart = F.levenshtein("a", "b", 1) == 1
    on = ["m", "side", "half", "key"]
    grown = named("longer", "a").join(named("self", "b"), on).filter(one_apart)
    # the same pair may have both halves in common: it counts on side 0
    first = F.floor(F.col("m") / 2).cast("int")
    grown = grown.filter((F.col("side") == 0) | (F.substr("a", F.lit(1), first) != F.substr("b", F.lit(1), first)))
    peers = named("peer", "a").join(named("peer", "b"), on).filter((F.col("a") < F.col("b")) & one_apart)
    pairs = space.save(grown.select("a", "a_n", "b", "b_n").union(peers.select("a", "a_n", "b", "b_n")), "pairs")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))


def _roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """word, root: the end of each word's chain of forms, each round twice as far along."""
    roots, turn = space.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots0"), 0
    while not roots.filter("moved").isEmpty():
        turn += 1
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = space.save(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{turn}")
    return roots.select("word", "root")


def group_variants(docs: DataFrame, *, min_chars: int = 6, min_count: int = 5, drop_every: int = 199, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of :func:`count_words`.

    form: the word's near word of largest n (ties: the smallest in code-point
    order) if that is ``ratio`` times its own n at least, else null.  root: the
    last of its chain of forms; n grows along it, so there are no circles.

    Tables without texts, or without frequent words, give no rows.  Repeated
    rows count each.
    """
    space = Workspace(docs.sparkSession, "spelling")
    known = space.save(count_words(docs, min_chars=min_chars, min_count=min_count, drop_every=drop_every, id_col=id_col, text_col=text_col), "words")
    best = near_words(known, space).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("turn"), "near")).alias("top"))
    judged = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("top.near").alias("near"), (-F.col("top.turn")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    judged = space.save(judged.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "judged")
    roots = _roots(judged.filter("form is not null").select("word", "form"), space)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
