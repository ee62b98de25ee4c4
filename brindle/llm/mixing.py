"""Mixing sources by temperature.

Each source's share of the tokens is raised to a power between 0 (all alike)
and 1 (as they are).  Bisection finds the power that meets a target entropy, or
the lowest one that repeats no source more often than a limit.  The normalised
weights become token budgets, and each source fills its budget with whole
passes over its blocks of documents and part of one more, every pass in a
permutation of its own.

Scale: a document's block comes from a hash of its id, so a source that holds
most rows has most blocks and no key is hot.  Only sums by source and block are
ordered, in parts of ``part_blocks`` of them, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import Workspace, join_by_key

WORD = r"[^\x20\x09-\x0D]+"
NO_SOURCE = "\0"


def token_count(text: Column) -> Column:
    """Words and an end."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def _bisect(shares: DataFrame, meets, *, rounds: int = 5, grid: int = 16) -> float:
    """The least power in [0, 1] for which ``meets`` holds, which must hold from some power on.

    Each round asks for ``grid`` powers at once in one aggregation of the shares.
    meets: (sum of p^a, sum of p^a * ln p, power) -> bool.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        powers = [low + (high - low) * i / grid for i in range(grid + 1)]
        sums = shares.agg(
            *[F.sum(F.pow("p", F.lit(a))).alias(f"s{i}") for i, a in enumerate(powers)],
            *[F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"t{i}") for i, a in enumerate(powers)],
        ).first()
        good = [meets(sums[f"s{i}"], sums[f"t{i}"], a) for i, a in enumerate(powers)]
        if good[0]:
            return low
        at = next((i for i, g in enumerate(good) if g), grid)
        low, high = powers[at - 1], powers[at]
    return high


def weights(
    sources: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget_tokens: int | None = None
) -> tuple[DataFrame, float]:
    """Adds p, weight and budget (tokens) to rows (source, tokens); returns them and the power.

    target_entropy: as a share of the entropy of equal weights, 0 to 1; the
    power is the greatest whose entropy reaches it.  max_repeats: the power is
    the least for which no source's budget is over so many times its tokens.
    Exactly one of the two.  budget_tokens: what the mixture holds; None: as
    little as lets every source have all its documents once.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("either target_entropy or max_repeats")
    all_ = sources.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    if not all_["n"]:
        return sources.select("*", F.lit(0.0).alias("p"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget")), 1.0
    import math

    total = float(all_["t"])
    shares = sources.withColumn("p", F.col("tokens") / F.lit(total))
    least, most = all_["least"] / total, all_["most"] / total
    if max_repeats is not None:

        def meets(s: float, _: float, a: float) -> bool:
            if budget_tokens is None:  # the largest source once
                return least ** (a - 1) <= max_repeats * most ** (a - 1) * (1 + 1e-12)
            return budget_tokens / total * least ** (a - 1) / s <= max_repeats * (1 + 1e-12)

        power = _bisect(shares, meets)
    else:
        goal = target_entropy * math.log(all_["n"])
        entropy = lambda s, t, a: math.log(s) - a * t / s
        power = _bisect(shares, lambda s, t, a: entropy(s, t, a) <= goal)
    norm = shares.agg(F.sum(F.pow("p", F.lit(power)))).first()[0]
    budget = float(budget_tokens) if budget_tokens is not None else total * most ** (1 - power) * norm
    weighted = shares.withColumn("weight", F.pow("p", F.lit(power)) / F.lit(norm))
    return weighted.withColumn("budget", F.col("weight") * F.lit(budget)), power


def mix(
    docs: DataFrame,
    *,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
    block_tokens: int = 1_000_000,
    least_blocks: int = 64,
    part_blocks: int = 4096,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
    names: tuple[str, str, str] = ("epoch", "block", "position"),
) -> DataFrame:
    """A row for each time that a document stands in the mixture.

    Returns ``keep`` (doc_id, source, n_tokens), then epoch (the pass over its
    source, from 0), block, position (0 to 1: where the block stands in its
    source's budget; ordering by position interleaves the sources by weight).

    A source has a block for each ``block_tokens`` tokens, ``least_blocks`` at
    least; a budget is met to half a block.  See :func:`weights` for the rest.
    With budget_tokens None every document stands in the mixture at least once.

    Null sources are one source.  Null and empty texts count one token, their
    end.  Rows with null ids are dealt by their text.  Repeated rows are mixed each.  An
    empty table gives no rows.  ``names`` names the last three columns, which
    must not clash with those kept (ValueError).
    """
    if set(names) & set(keep or []):
        raise ValueError(f"names {names} clash with kept columns")
    space = Workspace(docs.sparkSession, "mixing")
    kept = ["doc_id", "source", "n_tokens"] if keep is None else keep
    own = {"doc_id": docs[id_col], "source": docs[source_col], "n_tokens": token_count(docs[text_col])} if keep is None else {c: docs[c] for c in keep}
    rows = docs.select(
        *[own[c].alias(f"__c{i}") for i, c in enumerate(kept)],
        F.coalesce(docs[source_col].cast("string"), F.lit(NO_SOURCE)).alias("__s"),
        F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col], F.lit("text"))).otherwise(F.xxhash64(docs[id_col].cast("long"))).alias("__h"),
        token_count(docs[text_col]).alias("__n"),
    )
    sources = space.save(rows.groupBy(F.col("__s").alias("source")).agg(F.sum("__n").alias("tokens"), F.count("*").alias("rows")), "sources")
    weighted, _ = weights(sources, target_entropy=target_entropy, max_repeats=max_repeats, budget_tokens=budget_tokens)
    weighted = weighted.withColumn("blocks", F.greatest(F.lit(least_blocks).cast("long"), F.ceil(F.col("tokens") / F.lit(block_tokens))))
    weighted = space.save(weighted.select("source", "rows", "tokens", "budget", "blocks"), "weighted")
    placed = join_by_key(rows, weighted.select(F.col("source").alias("__s"), "rows", "blocks"), ["__s"], "rows").withColumn("block", F.pmod("__h", "blocks"))
    blocks = space.save(placed.groupBy(F.col("__s").alias("source"), "block").agg(F.sum("__n").alias("n")), "blocks")
    of_source = weighted.select(F.col("source").alias("__of"), "tokens", "budget", "blocks")
    passes = blocks.join(of_source, F.col("source") == F.col("__of")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("budget") / F.col("tokens") + 1e-9).cast("int"))))
    # a pass takes its blocks in the order of a hash; parts of that order are summed first, so that no task orders all of them
    passes = passes.withColumn("turn", F.xxhash64(F.lit(seed), "source", "epoch", "block"))
    passes = passes.withColumn("part", F.floor((F.col("turn").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("blocks") / part_blocks)))
    sums = passes.groupBy("source", "epoch", "part").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("parts_before"))
    shuffled = Window.partitionBy("source", "epoch", "part").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.join(sums, ["source", "epoch", "part"])
    before = F.col("parts_before") + F.coalesce(F.sum("n").over(shuffled), F.lit(0)) + F.col("epoch") * F.col("tokens")
    drawn = passes.withColumn("before", before).filter(F.col("before") + F.col("n") / 2 <= F.col("budget") * (1 + 1e-9))
    turns = drawn.groupBy(F.col("source").alias("__s3"), F.col("block").alias("__b3")).agg(
        F.collect_list(F.struct("epoch", F.least(F.col("before") / F.col("budget"), F.lit(1.0)).alias("position"))).alias("turns")
    )
    turns = space.save(turns, "turns")
    out = placed.join(turns, (F.col("__s") == F.col("__s3")) & (F.col("block") == F.col("__b3"))).withColumn("turn", F.explode("turns"))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], F.col("turn.epoch").alias(names[0]), F.col("block").alias(names[1]), F.col("turn.position").alias(names[2]))
