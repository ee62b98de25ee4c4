"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates and their places.  Every candidate's value is hashed,
and the corpus says how many owners and repositories hold that hash: a value
that many owners or many repositories share is a copied example, one that a single owner holds and
that looks random is taken for live.  Values known as live also mark the
places where they stand bare, without a keyword.

DataFrame functions only.  One narrow pass finds candidates; only hashes,
places and owners shuffle, combined on the map side, and values that stand in a
large share of the rows meet their owners by a broadcast of these values (a
bounded number), so a value may stand in any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace, join_by_key, sent

# The patterns, the least length of what they must hold, and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more
HEX = r"[0-9a-f]{24,}"
#: Runs that may be a value without a keyword, up to their last letter or digit: whole, between =, between = and /, behind the first =.
BARE = (
    r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9]",
    r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{15,}[A-Za-z0-9]",
    r"(?<![A-Za-z0-9+_.-])[A-Za-z0-9+_.-]{15,}[A-Za-z0-9]",
    r"(?<=[A-Za-z0-9+/_.-]=)[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9]",
)
TAIL = r"[+/_.=-]+$"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_CHARS = 6
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|test|xxxx|1234567|abcdef0"


def running(values: Column, block: int = 256) -> Column:
    """What stands before each value of an array: the sum of all earlier ones.  By blocks, so that the work grows with the length."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before"))
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), empty, add))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.aggregate(F.transform(blocks, lambda b: b["at"]), empty, add)["before"].alias("o")), lambda z: F.transform(z["b"]["before"], lambda x: x + z["o"])))


def places(text: str, matches: str, parts: str) -> Column:
    """Start of each match, from the pieces of text between matches (code points, from 0)."""
    before = lambda i: F.length(F.get(parts, i))
    widths = F.transform(matches, lambda m, i: before(i) + F.length(m))
    return F.when(F.size(matches) > 0, F.transform(running(widths), lambda x, i: x + before(i))).otherwise(F.array().cast("array<int>"))


def _find(df: DataFrame, kind: int, pattern: str, name: str) -> DataFrame:
    """Adds the column ``name``: array of (start, kind, end, value); df has __text."""
    held = [c for c in df.columns]
    hit = df.select(*held, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)).alias("__m"))
    cut = hit.select(*held, "__m", F.when(F.size("__m") > 0, F.split("__text", pattern, -1)).alias("__parts"))
    placed = cut.select(*held, "__m", places("__text", "__m", "__parts").alias("__at"))
    value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if KINDS[kind] == "assign" else (lambda m: m)
    span = lambda m, i: F.struct(
        F.get("__at", i).alias("start"), F.lit(kind).alias("kind"), (F.get("__at", i) + F.length(m)).alias("end"), value(m).alias("value")
    )
    found = F.transform("__m", span)
    if KINDS[kind] == "assign":
        found = F.filter(found, lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    return placed.select(*held, found.alias(name))


def looks_random(value: Column) -> Column:
    """16 characters or more, 8 different ones, letters and digits, and none of the usual placeholders."""
    return (
        (F.length(value) >= 16)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(PLACEHOLDER)
    )


def core(value: Column) -> Column:
    """The value up to its last letter or digit, by which it is known again; itself if it has none."""
    short = F.regexp_replace(value, TAIL, "")
    return F.when(short == "", value).otherwise(short)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """doc_id, owner, repo, text_hash, base and bare: the places that the patterns find in every whole text."""
    df = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    )
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        df = _find(df, kind, pattern, f"c{kind}")
    for i, pattern in enumerate(BARE):
        df = _find(df, KINDS.index("owned"), pattern, f"b{i}")
    base = F.array_sort(F.concat("c0", "c1", "c2"))
    return df.select("doc_id", "owner", "repo", F.xxhash64("__text").alias("text_hash"), base.alias("base"), F.array_distinct(F.concat(*[f"b{i}" for i in range(len(BARE))])).alias("bare"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos, keyed, places: in how many owners and repositories each value stands, whether ever with a keyword, and how often."""
    return (
        found.groupBy("hash", "owner", "repo")
        .agg(F.max("keyed").alias("keyed"), F.count("*").alias("places"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"), F.max("keyed").alias("keyed"), F.sum("places").alias("places"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("keyed").alias("keyed"), F.sum("places").alias("places"))
    )


def scan(
    docs: DataFrame,
    *,
    example_owners: int = 3,
    example_repos: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
) -> DataFrame:
    """All places of secrets in every whole text, judged by who else holds the value.

    Returns a row for each row: doc_id, text_hash, and spans, an array of
    (start, kind, end, verdict) by start, then kind.  Places are code points,
    the end exclusive.  kind: 0 assign, 1 access, 2 hex (the base), 3 owned.
    verdict: "example" if ``example_owners`` owners or more hold the value, or
    ``example_repos`` repositories or more within fewer owners;
    else "live" if it looks random, or stands somewhere with a keyword, has one
    owner and is no placeholder, whatever its length; else "weak".  Signs behind
    a value's last letter or digit don't count for who holds it.

    Owned places are added by the corpus: a bare value of 16 characters or more
    (a run, or a part of one between = and /, without such signs at its end), overlapping no base
    place, that stands somewhere with a keyword and is live.

    Null texts are empty, null owners and repositories one of their own each.
    Repeated rows are scanned each.  An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "secrets")
    found = candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col)
    # the number is stored with the row: reading the table again may deal it out differently
    rows = space.save(found.withColumn("row", F.monotonically_increasing_id()), "found")
    beside = lambda s, b: (s["start"] < b["end"]) & (b["start"] < s["end"])
    free = F.filter("bare", lambda s: ~F.exists("base", lambda b: beside(s, b)))
    every = rows.select("row", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.explode(F.concat("base", free)).alias("s"))
    value = core(F.col("s.value"))
    seen = every.select(
        "row",
        "owner",
        "repo",
        "s.start",
        "s.kind",
        "s.end",
        F.sha2(value, 256).alias("hash"),
        (F.col("s.kind") < 2).alias("keyed"),
        looks_random(value).alias("random"),
        value.rlike(PLACEHOLDER).alias("placeholder"),
    )
    seen = space.save(seen, "places")
    judged = join_by_key(seen.drop("keyed"), space.save(ownership(seen), "owners"), ["hash"], "places")
    alone = F.col("keyed") & (F.col("owners") == 1) & ~F.col("placeholder")
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when(F.col("random") | alone, "live").otherwise("weak")
    marked = judged.withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("keyed") & (F.col("verdict") == "live")))
    spans = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,verdict:string>>")
    return rows.select("row", "doc_id", "text_hash").join(spans, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each place, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, scanned: DataFrame, *, mark: str = "[SECRET]", send_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the live places of :func:`scan` replaced by ``mark``; examples stay.

    The places meet their texts by a broadcast up to ``send_rows`` texts with
    such places, and beyond by a shuffle.

    Overlapping places are replaced together.  Null ids are ids too.  Texts without live places, null
    ones too, stay as they are.
    """
    live = scanned.select("doc_id", "text_hash", F.filter("spans", lambda s: s["verdict"] == "live").alias("__live")).filter(F.size("__live") > 0)
    live = live.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.first("__live").alias("__live"))
    live = sent(Workspace(docs.sparkSession, "redact").save(live, "live"), send_rows)
    both = docs.join(live, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left")
    text = docs[text_col]
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
        )
    )
    done = F.aggregate("__live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return both.select(*[(F.when(F.col("__live").isNull(), text).otherwise(done) if c == text_col else docs[c]).alias(c) for c in docs.columns])
