"""Quality rules with adaptive thresholds.

Fixed rules (word count, repeated words) decide first.  The other rules take
their limits from the corpus: mergeable quantile sketches of each measure, one
for each language and source, give fences beyond which a document is an
outlier of its own kind.  Documents meet their group's fences in a join.

A sketch counts values by buckets of a fixed relative width, and keeps each
bucket's least and greatest value.  Nothing is drawn at random and nothing
depends on the order of rows: equal rows have equal fences, however they are
partitioned and whatever is run again.

DataFrame functions only.  Measures are one narrow pass over the texts; only
numbers shuffle.  Sketches merge on the map side, so a group may hold any share
of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import Workspace, join_by_key

# White space between words, and the signs that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: measure -> (quantile that the spread starts from, quantile it reaches, low side too).  A fence is ``reach``
#: spreads beyond.  The shares are mostly 0, so that only their upper tail says how they spread.
RULES = {"symbol_share": (0.5, 0.97, False), "dup_line_share": (0.5, 0.97, False), "repeat_share": (0.5, 0.97, False), "mean_word": (0.25, 0.75, True)}
#: The least that a text can have of these, which is beyond no fence: a symbol, a line again, a window of three words again.
LEAST = {"symbol_share": ("n_symbols", 1), "dup_line_share": ("n_dup_lines", 1), "repeat_share": ("n_repeat_words", 6)}
#: Rows of the whole corpus's spread that join a group's own.
PRIOR_ROWS = 100
#: Buckets of a sketch from a value to its double: a quantile is off by 1/184 of itself at most.
BUCKETS = 128


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all), then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_lines: lines with a word.  n_dup_lines: those equal to an earlier one.
    n_repeat_words: words inside three-word windows that stand in the text twice
    or more.  Null texts have no words.  Windows are compared by 64-bit hashes.
    """
    kept = docs.columns if keep is None else keep
    named = {f"__k{i}": docs[c] for i, c in enumerate(kept)}
    raw = docs.select(*[c.alias(n) for n, c in named.items()], F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    split = raw.select(
        *named,
        words_of(F.col("__text")).alias("__w"),
        F.length(_without(F.col("__text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(_without(F.col("__text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda x: _without(x, BLANKS) != "").alias("__l"),
    )
    windows = F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    hashed = split.select(
        *named,
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") >= 3, F.slice(windows, F.lit(1), F.size("__w") - 2)).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    by_hash = F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = hashed.select(*named, *counts, by_hash.alias("__s"))
    twin = lambda x, i: (x["h"] == F.get("__s", i + 1)["h"]) | (x["h"] == F.get("__s", i - 1)["h"])
    at = F.transform("__s", lambda x, i: F.when(twin(x, i), x["i"]))
    placed = ordered.select(*named, *counts, F.array_sort(F.array_compact(at)).alias("__p"))
    reach = F.transform("__p", lambda v, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - v, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*[F.col(n).alias(c) for n, c in zip(named, kept, strict=True)], *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketched(values: DataFrame, groups: list[str], names: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """Quantile sketches of the columns ``names`` (0 or more each): groups, name, bucket, n, least, greatest.

    A row for each bucket in use, of which a group has ``buckets`` for each
    doubling of a value, and one for 0.  Null values count nowhere.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]))
    rows = values.select(*groups, each.alias("__v")).select(*groups, "__v.name", "__v.value").filter(F.col("value").isNotNull())
    bucket = F.when(F.col("value") > 0, F.floor(F.log2("value") * buckets).cast("int"))
    return rows.groupBy(*groups, "name", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """One sketch for each group and name, of rows out of many sketches: of parts of the corpus, or of finer groups."""
    return sketches.groupBy(*groups, "name", "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def quantiles(sketches: DataFrame, groups: list[str], wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """For each group ``__rows`` (the largest count of a name) and the columns ``<name>_<i>``: name's i-th wanted quantile.

    A quantile is the value of rank ceil(q * rows), at least 1.  Within its
    bucket values count as evenly spread from the least to the greatest, which
    is exact for up to two rows and for equal ones.
    """
    own = Window.partitionBy(*groups, "name")  # a row for each bucket
    counted = sketches.select(*groups, "name", "n", "least", "greatest", F.sum("n").over(own.orderBy(F.asc_nulls_first("bucket"))).alias("__to"), F.sum("n").over(own).alias("__all"))
    columns = []
    for name, shares in wanted.items():
        for i, q in enumerate(shares):
            rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * F.col("__all")))
            within = rank - (F.col("__to") - F.col("n"))
            value = F.col("least") + (F.col("greatest") - F.col("least")) * (within - 1) / F.greatest(F.col("n") - 1, F.lit(1))
            columns.append(F.max(F.when((F.col("name") == name) & within.between(1, F.col("n")), value)).alias(f"{name}_{i}"))
    return counted.groupBy(*groups).agg(F.max("__all").alias("__rows"), *columns)


def _limits(measured: DataFrame, groups: list[str], rules: list[str], *, reach: float, rows: str = "rows") -> DataFrame:
    """``groups``, their ``rows``, and for each rule ``<rule>_hi`` (and ``_lo``): null where the whole corpus has no spread."""
    own = quantiles(sketched(measured, groups, rules), groups, {r: RULES[r][:2] for r in rules})
    spread = lambda r: F.col(f"{r}_1") - F.col(f"{r}_0")
    # decimals, whose sum doesn't hang on the order of the groups
    exact = lambda c: c.cast("decimal(38,9)")
    usual = own.agg(*[(F.sum(exact(F.col("__rows") * spread(r))).cast("double") / F.sum("__rows")).alias(f"__{r}") for r in rules])
    columns = []
    for r in rules:
        shared = F.col(f"__{r}")
        wide = F.greatest((F.col("__rows") * spread(r) + PRIOR_ROWS * shared) / (F.col("__rows") + PRIOR_ROWS), shared / 2)
        wide = F.when(wide > 0, wide)
        low = RULES[r][2]
        columns.append((F.col(f"{r}_1" if low else f"{r}_0") + reach * wide).alias(f"{r}_hi"))
        if low:
            columns.append((F.col(f"{r}_0") - reach * wide).alias(f"{r}_lo"))
    return own.crossJoin(F.broadcast(usual)).select(*groups, F.col("__rows").alias(rows), *columns)


def _inside(rules: list[str]) -> Column:
    inside = F.lit(True)
    for r in rules:
        below = F.coalesce(F.col(r) <= F.col(f"{r}_hi"), F.lit(True))
        if r in LEAST:
            below = below | (F.col(LEAST[r][0]) <= LEAST[r][1])
        inside = inside & below
        if RULES[r][2]:
            inside = inside & F.coalesce(F.col(r) >= F.col(f"{r}_lo"), F.lit(True))
    return inside


def fences(measured: DataFrame, groups: list[str], space: Workspace, *, reach: float = 3.0) -> DataFrame:
    """For each group its ``rows``, and for each rule ``<rule>_hi`` (and ``_lo``), from quantile sketches.

    The word length's fences lie beyond the quartiles of the group.  The shares'
    come from the tails of the documents within these, since junk that stands
    out by its words would set the tails itself.  A group's spread is averaged
    with the mean spread of all groups as if that were ``PRIOR_ROWS`` rows, and
    is half of it at least, so that neither few rows nor many copies decide
    alone.  A measure without spread in any group has no fences.
    """
    both_sides = [r for r in RULES if RULES[r][2]]
    tails = [r for r in RULES if not RULES[r][2]]
    first = space.save(_limits(measured, groups, both_sides, reach=reach), "fences")
    usual = join_by_key(measured, first, groups, "rows").filter(_inside(both_sides))
    last = space.save(_limits(usual, groups, tails, reach=reach, rows="usual_rows"), "tails")
    named = last.select(*[F.col(g).alias(f"{g}2") for g in groups], *[c for c in last.columns if c not in (*groups, "usual_rows")])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}2"))
    return space.save(first.join(named, same, "left").drop(*[f"{g}2" for g in groups]), "limits")


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, reach: float = 3.0) -> DataFrame:
    """Measure and judge every document.

    Returns ``keep`` (all columns), the measures, base_failed and kept.  A
    document is kept if the fixed rules pass and no measure lies beyond the
    fences of its language and source.  Fences come from the documents that the
    fixed rules pass.  A group without such documents has no fences.  The least
    that a text can have of a share (``LEAST``) is beyond none.

    Null languages and sources are groups of their own.  Null and empty texts
    fail the fixed rules.  Repeated rows are judged each; an empty table gives
    none.  Columns in ``keep`` named like the result's raise ValueError.
    """
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES}
    if clash := results & set(docs.columns if keep is None else keep):
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    space = Workspace(docs.sparkSession, "quality")
    kept = docs.columns if keep is None else keep
    tagged = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(kept)], docs[text_col].alias("__t"), docs[lang_col].alias("__lang"), docs[source_col].alias("__source"))
    names = [*[f"__c{i}" for i in range(len(kept))], "__lang", "__source"]
    share = lambda c, of: F.when(F.col(of) > 0, F.col(c) / F.col(of)).otherwise(0.0)
    measured = measure(tagged, text_col="__t", keep=names).select(
        "*",
        base_failed().alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word"),
    )
    rows = space.save(measured, "measured")
    groups = ["__lang", "__source"]
    passed = rows.filter(~F.col("base_failed"))
    judged = join_by_key(passed, fences(passed, groups, space, reach=reach), groups, "rows").withColumn("kept", _inside(list(RULES)))
    columns = [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES]
    both = judged.select(*columns).unionByName(rows.filter("base_failed").withColumn("kept", F.lit(False)).select(*columns))
    return both.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], *columns[len(names) :])
