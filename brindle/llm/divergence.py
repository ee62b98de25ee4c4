"""Source divergence audit: how far the words of each source lie from those of the others of its language.

Terms become integers: a chunk of the dictionary is a sorted array of kept terms,
ids are places in it, so they keep the order of UTF-8.  Counts of a chunk are dense
vectors, one for each source.  Chunks come from a range partitioning by term, so
no task and no broadcast holds a whole dictionary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .workers import release
from .workspace import Workspace, sent

#: Letters and all beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
SCALE = 1_000_000_000
PIECE_BYTES = 1 << 22
HELD_TERMS = 200_000
CHUNK_ROWS = 200_000
CHUNK_CELLS = 1 << 20
COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
CHUNKS = "lang string, terms array<binary>, sources array<string>, sums array<bigint>, counts binary"
PARTS = "part string, lang string, source string, item binary, value bigint"


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in parts, cut where no term is."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        gap = _GAP.search(raw, at + PIECE_BYTES)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (tokens, docs) in held.items():
        terms = [None, *tokens]  # the group is there even without terms
        n = [0, *tokens.values()]
        of = [0, *map(docs.__getitem__, tokens)]
        for i in range(0, len(terms), 50_000):
            part = slice(i, i + 50_000)
            size = len(terms[part])
            yield pa.record_batch(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms[part], pa.binary()), pa.array(n[part], pa.int64()), pa.array(of[part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
    held.clear()


def count_terms(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group, in parts that are to be summed.

    Every group has a row with a null term.  A task keeps a bounded number of
    terms before it hands them on.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate((lang_col, source_col))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        kept = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for lang, source, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tokens, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    kept -= len(tokens)
                    own: set[bytes] = set()
                    for piece in _pieces(raw.lower()):  # of bytes: A-Z only
                        found = TERM.findall(piece)
                        tokens.update(found)
                        own.update(found)
                    in_docs.update(own)
                    kept += len(tokens)
                    if kept > HELD_TERMS:
                        yield from _counted(held)
                        kept = 0
        yield from _counted(held)
        release()

    return rows.mapInArrow(run, COUNTS)


def dense_chunks(lang: str, terms: np.ndarray, sources: np.ndarray, n: np.ndarray, docs: np.ndarray, min_docs: int, cells: int = CHUNK_CELLS) -> Iterator[tuple]:
    """(lang, terms, sources, sums, counts) of rows sorted by term: the kept terms' dense counts, at most ``cells`` at once where sources are fewer.

    All rows of a term must be there.
    """
    new = np.append(True, terms[1:] != terms[:-1])
    starts = np.flatnonzero(new)
    keep = np.add.reduceat(docs, starts) >= min_docs
    known = terms[starts[keep]]
    if not len(known):
        return
    mine = keep[np.cumsum(new) - 1]
    names, who = np.unique(sources[mine].astype(object), return_inverse=True)
    ids, n = np.searchsorted(known, terms[mine]), n[mine]
    step = max(1, cells // len(names))
    for at in range(0, len(known), step):
        size = min(step, len(known) - at)
        lo, hi = np.searchsorted(ids, [at, at + size])
        place = who[lo:hi] * size + ids[lo:hi] - at
        if n[lo:hi].max() < 1 << 53:  # exact as floats: each place has one row
            counts = np.bincount(place, n[lo:hi], len(names) * size).astype(np.int64)
        else:
            counts = np.zeros(len(names) * size, np.int64)
            np.add.at(counts, place, n[lo:hi])
        counts = counts.reshape(len(names), size)
        yield lang, known[at : at + size].tolist(), names.tolist(), counts.sum(1).tolist(), counts.astype("<i8").tobytes()


def _chunk_rows(min_docs: int, rows: int):
    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["lang", "terms", "sources", "sums", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            langs, terms = np.array(table["lang"].to_pylist(), object), np.array(table["term"].to_pylist(), object)
            edge = len(terms)
            if not last:  # the last term may go on
                same = (terms == terms[-1]) & (langs == langs[-1])
                edge = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            sources, n, docs = np.array(table["source"].to_pylist(), object), table["n"].to_numpy(), table["docs"].to_numpy()
            cuts = [0, *(np.flatnonzero(langs[1:edge] != langs[: max(edge - 1, 0)]) + 1).tolist(), edge] if edge else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for chunk in dense_chunks(langs[a], terms[a:b], sources[a:b], n[a:b], docs[a:b], min_docs):
                    yield batch_of([chunk])
            held = table.slice(edge).combine_chunks().to_batches() if edge < len(terms) else []
            size = len(terms) - edge

        aim = rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= aim:
                yield from closed(False)
                aim = max(rows, 2 * size)
        if size:
            yield from closed(True)
        release()

    return run


def scaled(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total), exact."""
    if not counts.size:
        return np.zeros(counts.shape, np.int64)
    if int(counts.max()) + 2 <= (2**63 - 1) // SCALE:
        return 1 + SCALE * (counts + 2) // np.asarray(total, np.int64)
    return (1 + SCALE * (counts.astype(object) + 2) // np.asarray(total, object)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most 1e9 + 1."""
    d = p - q
    return d * d // (p + q)


def _measure(top: int, cells: int = CHUNK_CELLS):
    def chunk_parts(row: dict) -> Iterator[tuple]:
        lang, names, totals = row["lang"], [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64)
        rank = {s: i for i, s in enumerate(names)}
        terms, here = row["terms"], np.array([rank[s] for s in row["sources"]])
        counts = np.frombuffer(row["counts"], "<i8").reshape(len(here), len(terms))
        spread, whole = 2 * row["v"], int(row["n"])
        best: list[list[tuple]] = [[] for _ in here]
        step = max(1, cells // len(names))
        for at in range(0, len(terms), step):
            part = counts[:, at : at + step]
            full = np.zeros((len(names), part.shape[1]), np.int64)
            full[here] = part
            p = scaled(full, (totals + spread)[:, None])
            for i in range(len(names) - 1):
                for j, value in enumerate(divergence(p[i], p[i + 1 :]).sum(1).tolist(), i + 1):
                    yield "pair", lang, names[i], names[j].encode(), value
            q = scaled(part.sum(0), whole + spread)
            for k, i in enumerate(here):
                over = np.flatnonzero((part[k] > 0) & (p[i] > q))
                f = divergence(p[i][over], q[over])
                order = np.argsort(-f, kind="stable")[:top]  # ids are in order: so are ties
                best[k] = sorted(best[k] + [(-int(f[o]), at + int(over[o])) for o in order])[:top]
        for k, i in enumerate(here):
            for value, t in best[k]:
                yield "term", lang, names[i], terms[t], -value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        for batch in batches:
            for at in range(batch.num_rows):
                made: list[tuple] = []
                for part in chunk_parts(batch.slice(at, 1).to_pylist()[0]):
                    made.append(part)
                    if len(made) == 20_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["part", "lang", "source", "item", "value"])
                        made = []
                if made:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["part", "lang", "source", "item", "value"])
        release()

    return run


def audit(
    docs: DataFrame, *, min_docs: int = 10, top: int = 10, chunk_rows: int = CHUNK_ROWS, send_groups: int = 200_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    part "pair": item is each other source of the language, value the sum over
    all terms that ``min_docs`` of the language's documents hold.  part "term": the ``top``
    terms that the source uses more than its language does.  Ranks by value, then
    by item in the order of UTF-8.

    Null text, language and source are empty ones.  A group without terms is a
    group; a language without kept terms has pairs of value 0.  An empty table
    gives no rows; repeated rows count each.  All numbers are exact integers.

    What is known of the groups is sent to the tasks up to ``send_groups`` of
    them, and shuffled beyond.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "audit")
    parts = count_terms(docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    counts = space.save(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    ordered = counts.filter("term is not null").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = space.save(ordered.select("lang", "source", "term", "n", "docs").mapInArrow(_chunk_rows(min_docs, chunk_rows), CHUNKS), "chunks")
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n"))
    groups = space.save(counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(kept, "lang")
    few = groups.limit(send_groups + 1).count() <= send_groups
    known = F.broadcast(langs) if few else langs  # send_groups
    found = space.save(chunks.drop("sums").join(known, "lang").select("lang", "terms", "sources", "counts", "n", "v", "groups").mapInArrow(_measure(top), PARTS), "parts")
    pair = found.filter("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    both = pair.union(pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = sent(groups.select(F.col("lang"), F.col("source").alias("item")), send_groups)
    every = groups.select("lang", "source").join(others, "lang").filter("source <> item").join(both, ["lang", "source", "item"], "left")
    every = every.select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = every.union(terms).withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
