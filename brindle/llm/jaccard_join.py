"""N-gram Jaccard join with a token-group matrix.

Similar documents are partitioned into groups by the least hash of their
shingle sets and by size, since sets of very unlike sizes can't be alike.  The
matrix has a row for each shingle and group.  A document can only reach the
threshold with a member of a group if the group's union holds that share of the
document's shingles, so groups below the bound stay shut, and members of the
others are compared exactly.

The bound is taken in two steps.  The stored matrix holds the groups' prefixes:
of two sets that reach the threshold, the first few shingles of each in a common
order share one, and behind the first that they share there must be enough left
of both.  A group without such a shingle of a document is below the bound.  Rare
shingles come first in that order, so passages that many documents share lead to
no pairs.  A group that is left gets its full union, and the
overlap with that decides whether it is opened.  The result is exact for any
order.

Scale: equal sets are one class and meet by a digest.  Groups are split at a
bounded size, and a group that many ask is copied.  Of the groups that share a
shingle, one is the hub, which the others ask first; only groups that this
leaves unconnected meet each other, so a cluster of near copies costs a
comparison for each document and not for each pair of its groups.  A group
emits a spanning forest of its links, not its pairs.  Components come from
alternating stars.  Nothing that grows with the documents is sent to the driver
or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .shingles import shingle_sets
from .workers import release
from .workspace import Workspace, join_by_key, sent, shuffle_partitions

#: Shingles that a task gathers before it counts the frequent ones.
COUNT_SHINGLES = 1_000_000


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: sets take more room than texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first shingles of a set of ``n`` must meet a partner's: n - ceil(n * num / den) + 1."""
    return n - -(-n * num // den) + 1


def size_band(n: int, num: int, den: int) -> int:
    """Sets that reach the threshold lie in the same band or in neighbouring ones."""
    return math.floor(math.log(n) / math.log(den / num) + 1e-9) if num < den else n


def _digests(docs: DataFrame, size: int, least: int) -> DataFrame:
    """Rows (doc_id, n, sig) of all documents, and (token, count) of shingles that are frequent within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held, count, seen = [], 0, set()
        names = ["doc_id", "n", "sig", "token", "count"]

        def frequent() -> pa.RecordBatch:
            nonlocal count
            tokens, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = times >= least
            held.clear()
            seen.clear()
            count = 0
            tokens = tokens[often].view(np.int64)
            none = [pa.nulls(len(tokens), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.record_batch([*none, pa.array(tokens), pa.array(times[often].astype(np.int64))], names=names)

        for batch in _parts(batches):
            sets = shingle_sets(batch.column(1), size)
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            n = len(sets)
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names
            )
            for s, sig in zip(sets, sigs, strict=True):
                if sig not in seen:  # copies count once
                    seen.add(sig)
                    held.append(s)
                    count += len(s)
                if count >= COUNT_SHINGLES:
                    yield frequent()
        yield frequent()
        release()

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, token long, count long")


class Order:
    """A total order of shingles: by known frequency, then by hash.  Unknown ones are the rarest."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = np.argsort(tokens, kind="stable")
        self.tokens, self.counts = tokens[place], counts[place]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.tokens)] = True

    @staticmethod
    def _slot(tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(20) & np.uint64((1 << 22) - 1)).astype(np.int64)

    def first(self, own: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a sorted set."""
        if not len(self.tokens):
            return own[:n]
        known = self.maybe[self._slot(own)]
        rare = own[~known]
        if len(rare) >= n:
            rare_known = own[known]
            at = np.minimum(np.searchsorted(self.tokens, rare_known), len(self.tokens) - 1)
            unknown = rare_known[self.tokens[at] != rare_known]
            return np.sort(np.concatenate([rare, unknown]))[:n] if len(unknown) else rare[:n]
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        often = np.where(self.tokens[at] == own, self.counts[at], 0)
        return own[np.lexsort((own, often))[:n]]


def _prefixes(docs: DataFrame, size: int, num: int, den: int, order) -> DataFrame:
    """doc_id, n (shingles), sig, least (hash), band (of its size) and prefix of every document with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ranked = Order(*order.value)
        for batch in _parts(batches):
            sets = shingle_sets(batch.column(1), size)
            ids = batch.column(0).to_pylist()
            rows = [(i, len(s), xxhash.xxh3_128_digest(s.tobytes()), s[0].view(np.int64), size_band(len(s), num, den), ranked.first(s, prefix_length(len(s), num, den)).view(np.int64)) for i, s in zip(ids, sets, strict=True) if len(s)]
            if rows:
                i, n, sig, least, band, prefix = zip(*rows, strict=True)
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32), np.concatenate(prefix))
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(np.array(least)), pa.array(band, pa.int64()), flat], names=["doc_id", "n", "sig", "least", "band", "prefix"])
        release()

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, least long, band long, prefix array<long>")


def _parts_of(spark: SparkSession, total: int, most: int) -> int:
    """Parts of the shingles, of about ``most`` entries at most: their number grows with the corpus."""
    return max(shuffle_partitions(spark), -(-total // most))


def _spreads(held: DataFrame, parts: int, least: int) -> DataFrame:
    """token, count of the shingles that ``least`` prefixes or more hold.

    Tasks count before the shuffle, a bounded number of shingles at a time, so
    a shingle that all documents hold is a few numbers from each task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, taken = [], 0

        def out() -> pa.RecordBatch:
            nonlocal taken
            token, times = np.unique(np.concatenate(lists), return_counts=True)
            lists.clear()
            taken = 0
            part = (token.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            own, first = np.unique(part[order], return_index=True)
            cuts = np.append(first, len(token)).astype(np.int32)
            columns = [pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in (token, times.astype(np.int64))]
            return pa.record_batch([pa.array(own, pa.int64()), *columns], names=["part", "token", "times"])

        for batch in _parts(batches):
            token = batch.column(0).flatten().to_numpy()
            if len(token):
                lists.append(token)
                taken += len(token)
            if taken >= COUNT_SHINGLES:
                yield out()
        if lists:
            yield out()
        release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, now = [], None

        def out() -> pa.RecordBatch:
            token, times = (np.concatenate([x[i] for x in lists]) for i in range(2))
            lists.clear()
            order = np.argsort(token, kind="stable")
            token, times = token[order], times[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            token, times = token[first], np.add.reduceat(times, first)
            often = times >= least
            return pa.record_batch([pa.array(token[often], pa.int64()), pa.array(times[often], pa.int64())], names=["token", "count"])

        for batch in batches:
            for row, part in enumerate(batch.column(0).to_pylist()):
                if lists and part != now:
                    yield out()
                now = part
                lists.append((batch.column(1)[row].values.to_numpy(), batch.column(2)[row].values.to_numpy()))
        if lists:
            yield out()
        release()

    dealt = held.select("prefix").mapInArrow(deal, "part long, token array<long>, times array<long>")
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "token long, count long")


def _holders(held: DataFrame, tokens) -> DataFrame:
    """node of the documents whose prefix holds one of the broadcast ``tokens``, sorted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            token, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            rows = np.unique(np.repeat(np.arange(batch.num_rows), count)[_among(tokens.value, token)])
            yield pa.record_batch([batch.column(0).take(pa.array(rows))], names=["node"])

    return held.select("node", "prefix").mapInArrow(run, "node long").distinct()


def _hot_entries(groups: DataFrame, hot, num: int, den: int) -> DataFrame:
    """The rows of ``_matrix`` of the broadcast shingles ``hot``, sorted ones: only least and greatest values shuffle, not the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = hot.value
        for batch in _parts(batches):
            node, n, gid = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            token, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row, place = np.repeat(np.arange(len(count)), count), np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            own = _among(wanted, token)
            token, row, place = token[own], row[own], place[own]
            columns = [token, gid[row], node[row], n[row], den * n[row] - (num + den) * place]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["token", "gid", "node", "n", "reach"])
        release()

    entries = groups.mapInArrow(run, "token long, gid long, node long, n long, reach long")
    ends = entries.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.min("n").alias("least"), F.max("reach").alias("most"))
    ends = ends.filter("low <> high").select(F.col("token").alias("of"), "least", "most")  # a row for each hot shingle
    kept = entries.join(F.broadcast(ends), F.col("token") == F.col("of")).filter((F.col("reach") >= F.lit(num) * F.col("least")) & (F.col("most") >= F.lit(num) * F.col("n")))
    return kept.select("token", "gid", "node", "n", "reach")


def _among(wanted: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Which tokens are among the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(token), bool)
    return wanted[np.minimum(np.searchsorted(wanted, token), len(wanted) - 1)] == token


def _matrix(groups: DataFrame, parts: int, hot, num: int, den: int) -> DataFrame:
    """Rows (token, gid, node, n, reach) of the shingles of several groups, from rows (node, n, gid, prefix).

    Two sets that reach the threshold share num * (n + n2) / (num + den) shingles
    at least, and the first of these in the order leaves room for the others
    behind it in both: reach = den * n - (num + den) * place is num * n2 at
    least, both ways round.  Rows that can't be that first one with any other
    row of their shingle are left out.

    Entries shuffle as arrays, one for each part of the shingles and batch.
    Those of the broadcast shingles ``hot``, sorted ones, are left to ``_hot_entries``.
    """
    kinds = "token array<long>, gid array<long>, node array<long>, n array<long>, place array<int>"
    names = [k.split()[0] for k in kinds.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            node, n, gid = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            token, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            part = (token.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            part[_among(hot.value, token)] = parts  # behind all others, and cut off
            order = np.argsort(part, kind="stable")[: np.count_nonzero(part < parts)]
            own, first = np.unique(part[order], return_index=True)
            cuts = np.append(first, len(order)).astype(np.int32)
            columns = [token, np.repeat(gid, count), np.repeat(node, count), np.repeat(n, count), place.astype(np.int32)]
            if len(own):
                yield pa.record_batch([pa.array(own, pa.int64()), *[pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in columns]], names=["part", *names])
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> Iterator[pa.RecordBatch]:
            token, gid, node, n, place = (np.concatenate([h[i] for h in held]) for i in range(5))
            held.clear()
            order = np.argsort(token, kind="stable")
            token, gid, node, n, place = (c[order] for c in (token, gid, node, n, place))
            reach = den * n - (num + den) * place.astype(np.int64)
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            spread = np.diff(np.append(first, len(token)))
            several = np.minimum.reduceat(gid, first) != np.maximum.reduceat(gid, first)
            whole = lambda x: np.repeat(x, spread)
            keep = whole(several) & (reach >= num * whole(np.minimum.reduceat(n, first))) & (whole(np.maximum.reduceat(reach, first)) >= num * n)
            columns = [c[keep] for c in (token, gid, node, n, reach)]
            for at in range(0, len(columns[0]), 50_000):
                yield pa.record_batch([pa.array(c[at : at + 50_000], pa.int64()) for c in columns], names=["token", "gid", "node", "n", "reach"])

        for batch in batches:
            lists = [batch.column(i) for i in range(1, 6)]
            for row, part in enumerate(batch.column(0).to_pylist()):
                if held and part != now:
                    yield from out()
                now = part
                held.append([x[row].values.to_numpy() for x in lists])
        if held:
            yield from out()
        release()

    dealt = groups.mapInArrow(deal, f"part long, {kinds}").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "token long, gid long, node long, n long, reach long")


class Group:
    """A group of the matrix: the union of its members' shingles, and who holds each."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], num: int, den: int):
        self.nodes, self.num, self.den = nodes, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        place = np.argsort(tokens, kind="stable")
        tokens, self.owners = tokens[place], owners[place]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.union, self.starts = tokens[first], np.append(first, len(tokens))
        self.cell = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.cell[i] != i:
            self.cell[i] = self.cell[self.cell[i]]
            i = self.cell[i]
        return i

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Members that reach the threshold with ``own``; none if the group's union can't."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) * self.den < self.num * len(own):  # the bound: the group stays shut
            return np.zeros(0, np.int64)
        a, b = self.starts[at], self.starts[at + 1]
        n = b - a
        held = self.owners[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        common = np.bincount(held, minlength=len(self.nodes))
        return np.flatnonzero(common * self.den >= self.num * (self.sizes + len(own) - common))

    def inner_links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """A spanning forest of the links between members."""
        out = []
        for i, own in enumerate(sets):
            for j in self.linked(own).tolist():
                a, b = self.root(i), self.root(j)
                if a != b:
                    self.cell[max(a, b)] = min(a, b)
                    out.append((self.nodes[i], self.nodes[j]))
        return out

    def links_of(self, node: int, own: np.ndarray) -> list[tuple[int, int]]:
        """A link from ``node`` to each part of the group that it reaches."""
        cells = {self.root(j): j for j in self.linked(own).tolist()}
        return [(node, self.nodes[j]) for j in cells.values() if self.nodes[j] != node]


def _links(work: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """a, b from rows (target, copy, role, node, text) that lie together by target and copy, members (role 0) first.

    Copies of a group get different askers; the first one tells the links between members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at, nodes, sets, group, out = None, [], [], None, []

        def open_group() -> None:
            nonlocal group
            if group is None and sets:
                group = Group(nodes, sets, num, den)
                inner = group.inner_links(sets)
                if open_at[1] == 0:
                    out.extend(inner)

        def links() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in _parts(batches):
            for target, copy, role, node, own in zip(*(c.to_pylist() for c in batch.columns[:4]), shingle_sets(batch.column(4), size), strict=True):
                if not len(own):  # another text of the id
                    continue
                if (target, copy) != open_at:
                    open_group()
                    open_at, nodes, sets, group = (target, copy), [], [], None
                if role == 0:
                    nodes.append(node)
                    sets.append(own)
                else:
                    open_group()
                    if group is not None:
                        out.extend(group.links_of(node, own))
            if out:
                yield links()
        open_group()
        if out:
            yield links()
        group = None
        release()

    return work.mapInArrow(run, "a long, b long")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent (token, count) rows, ``most`` of them at most."""
    level = F.floor(F.log2("count") * 8).cast("int")
    cut, taken = 1 << 30, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():  # a row for each power of 2^(1/8)
        if taken + r["rows"] > most:
            break
        taken, cut = taken + r["rows"], r["level"]
    rows = counts.filter(level >= cut).select("token", "count").toArrow()  # ``most`` rows at most
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.int64)


def _representatives(space: Workspace, digests: DataFrame, classes: DataFrame, most: int):
    """A function that keeps one row of each class, as ``node``, of rows (doc_id, sig, ...)."""
    others = join_by_key(digests.filter("n > 0"), classes, ["sig"], "rows").filter("doc_id is null or doc_id <> node").select(F.col("doc_id").alias("id2"), F.col("sig").alias("sig2"))
    others = space.save(others, "others")
    few = space.told["others"]["rows"] <= most
    again = digests.filter("n > 0").groupBy("doc_id", "sig").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()

    def keep(df: DataFrame) -> DataFrame:
        if few:
            same = df["doc_id"].eqNullSafe(F.col("id2")) & (df["sig"] == F.col("sig2"))
            kept = df.join(F.broadcast(others), same, "left_anti")
        else:
            kept = df.join(classes.select(F.col("sig").alias("sig2"), "node"), (F.col("sig") == F.col("sig2")) & (F.col("doc_id") == F.col("node"))).drop("sig2", "node")
        kept = kept if again else kept.dropDuplicates(["sig"])
        return kept.select(F.col("doc_id").alias("node"), "n", "least", "band", "prefix")

    return keep


def link_documents(
    spark: SparkSession,
    docs: DataFrame,
    *,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    group_members: int = 200,
    group_shingles: int = 1_000_000,
    group_askers: int = 400,
    frequent_tokens: int = 500_000,
    frequent_in_task: int = 2,
    common_rows: int = 8,
    hub_rounds: int = 5,
    part_shingles: int = 2_000_000,
    hot_rows: int = 500_000,
    send_rows: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard likeness of num/den or more.

    Shingles are runs of ``size`` words, A-Z as a-z; a text with fewer words is
    one shingle.  Two documents link when den * common >= num * union.  Returns
    doc_id, n_shingles (size of the set), component_id (the least doc_id that
    links lead to, its own included).

    group_members, group_shingles: a group is split at about so many documents,
    or shingles of all together.  group_askers: a group has a copy for about so
    many that ask it.  frequent_tokens bounds each of the two frequency lists that
    are sent to tasks: what is frequent within tasks, from frequent_in_task
    documents on, and what else is in the corpus' prefixes, from common_rows on.
    hub_rounds: so often, at most, hubs are asked before all that is left is
    compared.  part_shingles: a task joins about so many entries of prefixes at a
    time.  hot_rows: a shingle that so many prefixes hold, or a frequent_tokens-th of
    all entries, is met by its extremes instead.  send_rows: tables of ids are broadcast up to so many rows, and joined
    by a shuffle beyond.  These change the work, never the result.

    Null, empty and blank texts have no shingles, link with nothing and are
    components of their own.  Rows with equal ids are one document: what either
    links with, both do.  Rows with null ids link with equal sets only; others
    of them have a null component.  An empty table gives no rows.  Other columns
    are not read.
    """
    space = Workspace(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = space.save(_digests(rows, size, frequent_in_task), "digests")
    digests = first.filter(F.col("n").isNotNull()).select("doc_id", "n", "sig")
    classes = space.save(digests.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "classes")

    # prefixes of one document of each class; once more for those that hold shingles that no task could know as frequent
    reps = _representatives(space, digests, classes, send_rows)
    counts = first.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("count"))
    tokens, often = _frequent(counts, frequent_tokens)
    entries = F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1), F.lit(0))
    held = space.save(reps(_prefixes(rows, size, num, den, spark.sparkContext.broadcast((tokens, often)))), "prefixes", entries=entries)
    documents, total = space.told["prefixes"]["rows"], space.told["prefixes"]["entries"]
    parts = _parts_of(spark, total, part_shingles)
    more, times = _frequent(space.save(_spreads(held, parts, common_rows), "spreads"), frequent_tokens)
    new = ~np.isin(more, tokens)
    if new.any():
        # all that is new moves behind in the order, so prefixes without it stay as they are
        order = spark.sparkContext.broadcast((np.concatenate([tokens, more[new]]), np.concatenate([often, times[new]])))
        moved = space.save(_holders(held, spark.sparkContext.broadcast(np.sort(more[new].view(np.int64)))), "moved")
        moved = sent(moved.withColumnRenamed("node", "moved"), send_rows, space.told["moved"]["rows"])
        again = rows.join(moved, F.col("doc_id") == F.col("moved"), "left_semi")
        held = space.save(held.join(moved, F.col("node") == F.col("moved"), "left_anti").union(reps(_prefixes(again, size, num, den, order))), "placed")
        space.drop("prefixes")

    # a shingle is once in a prefix: no more than ``documents`` hold it
    many = max(hot_rows, total // frequent_tokens)
    hot = np.zeros(0, np.int64)
    if documents >= many:
        hot = np.sort(_spreads(held, parts, many).select("token").toArrow().column(0).to_numpy())  # frequent_tokens at most
    hot = spark.sparkContext.broadcast(hot)

    pieces = F.greatest(F.ceil(F.count("*") / group_members), F.ceil(F.sum("n") / group_shingles)).alias("parts")
    crowd = held.groupBy("least", "band").agg(pieces).filter("parts > 1")
    share = F.pmod(F.xxhash64("node"), F.col("parts"))
    groups = held.join(sent(crowd, send_rows), ["least", "band"], "left").select(
        "node", "n", F.xxhash64("least", "band", F.coalesce(share, F.lit(0).cast("long"))).alias("gid"), "prefix"
    )
    lists = groups.select("node", "n", "gid", "prefix")
    meet = _matrix(lists, parts, hot, num, den)
    meet = space.save(meet.union(_hot_entries(lists, hot, num, den)) if len(hot.value) else meet, "meet")

    members = space.save(groups.select("gid", "node"), "members")
    sizes = space.save(members.groupBy("gid").agg(F.count("*").alias("n")), "sizes")

    def compare(asked: DataFrame, inside: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Links of rows (target, node) with the groups they ask, and within the groups ``inside`` (target); and these rows, stored."""
        asked = space.save(asked, f"asked_{name}")
        copies = asked.groupBy("target").agg(F.count("*").alias("n")).union(inside.select("target", F.lit(0).cast("long"))).groupBy("target").agg(F.sum("n").alias("n"))
        copies = space.save(copies.select("target", F.greatest(F.lit(1), F.ceil(F.col("n") / group_askers)).alias("copies")), f"copies_{name}", several=F.count_if(F.col("copies") > 1))
        dealt = asked.join(sent(copies.filter("copies > 1"), send_rows, space.told[f"copies_{name}"]["several"]), "target", "left")
        askers = dealt.select("target", F.coalesce(F.pmod(F.xxhash64("node"), F.col("copies")), F.lit(0).cast("long")).alias("copy"), F.lit(1).alias("role"), "node")
        held = members.join(copies, F.col("gid") == F.col("target")).select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"), "node")
        work = space.save(held.union(askers), f"work_{name}")
        # texts shuffle for less than their sets do
        texts = rows.join(sent(work, send_rows, space.told[f"work_{name}"]["rows"]), F.col("doc_id") == F.col("node")).select("target", "copy", "role", "node", "text")
        texts = texts.repartition(shuffle_partitions(spark), "target", "copy").sortWithinPartitions("target", "copy", "role", "node")
        return space.save(_links(texts, size, num, den), f"links_{name}"), asked

    def rooted(known: DataFrame, rows: int, name: str) -> DataFrame:
        """gid, node, root of all documents."""
        named = members.join(sent(known.withColumnRenamed("node", "of"), send_rows, rows), F.col("node") == F.col("of"), "left")
        return space.save(named.select("gid", "node", F.coalesce("root", "node").alias("root")), f"rooted{name}")

    def still_open(entries: DataFrame, named: DataFrame, name: str) -> DataFrame:
        """Entries (token, gid, node, n, reach, root) of shingles that documents of several components hold."""
        entries = entries.join(named.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of")).drop("of")
        several = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
        return space.save(entries.join(several, "token", "left_semi"), f"entries{name}")

    def spots(entries: DataFrame) -> DataFrame:
        """For each shingle, component and group: how many documents hold it, the least size and the furthest reach of these."""
        return entries.groupBy("token", "root", "gid").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("reach").alias("most"))

    may_link = (F.col("gid") != F.col("target")) & (F.col("reach") >= F.lit(num) * F.col("least")) & (F.col("most") >= F.lit(num) * F.col("n"))

    # within groups, and documents against the group that is the hub of a shingle; then other hubs, for what isn't connected.
    # A hub belongs to the component that most of the shingle's documents are in, so only the others ask.
    nothing = spark.createDataFrame([], "a long, b long")
    larger = sizes.filter("n > 1").select(F.col("gid").alias("target"))
    known, n_known, asked_before, entries = nothing.toDF("node", "root"), 0, nothing.toDF("target", "node"), meet.withColumn("root", F.lit(0).cast("long"))
    for turn in range(hub_rounds):
        if turn:
            entries = still_open(entries.drop("root"), rooted(known, n_known, str(turn)), str(turn))
        place = F.struct(F.xxhash64("gid", F.lit(turn)).alias("turn"), "gid", "least", "most")
        kinds = spots(entries).groupBy("token", "root").agg(F.sum("c").alias("c"), F.count("*").alias("gids"), F.min(place).alias("hub"))
        hubs = kinds.groupBy("token").agg(F.max(F.struct("c", "root", "hub")).alias("main"), F.sum("c").alias("c"), F.sum("gids").alias("gids")).select(
            F.col("token").alias("of"), F.col("main.root").alias("main"), F.col("main.hub.gid").alias("target"), "main.hub.least", "main.hub.most", (F.col("c") - F.col("main.c")).alias("others"), "gids"
        )
        if turn:
            hubs = space.save(hubs, f"hubs{turn}", all=F.coalesce(F.sum(F.col("others") * F.col("gids")), F.lit(0)), round=F.coalesce(F.sum("others"), F.lit(0)))
            work = space.told[f"hubs{turn}"]
            if work["all"] <= 2 * work["round"]:  # all that is left costs little more than another round
                break
        asked = entries.join(hubs, F.col("token") == F.col("of")).filter(may_link)
        asked = (asked.filter(F.col("root") != F.col("main")) if turn else asked).select("target", "node").distinct().join(asked_before, ["target", "node"], "left_anti")
        links, asked = compare(asked, larger if not turn else larger.limit(0), f"hub{turn}")
        asked_before = asked_before.union(asked)
        known = space.save(components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), space, f"hub{turn}"), f"roots{turn}")
        n_known = space.told[f"roots{turn}"]["rows"]
    else:
        turn = "rest"
        entries = still_open(entries.drop("root"), rooted(known, n_known, turn), turn)
    roots = known

    # what is left: where documents of two components hold a shingle, those of the one that holds it less often ask the other's groups
    if space.told[f"entries{turn}"]["rows"]:
        there = space.save(spots(entries), "spots")
        kinds = there.groupBy("token", "root").agg(F.sum("c").alias("c"))
        others = kinds.select(F.col("token").alias("token2"), F.struct("c", "root").alias("more"))
        between = kinds.join(others, (F.col("token") == F.col("token2")) & (F.struct("c", "root") < F.col("more"))).select("token", "root", F.col("more.root").alias("root2"))
        targets = there.select(F.col("token").alias("t2"), F.col("root").alias("r2"), F.col("gid").alias("target"), "least", "most")
        asked = entries.join(between, ["token", "root"]).join(targets, (F.col("token") == F.col("t2")) & (F.col("root2") == F.col("r2")))
        asked = asked.filter(may_link).select("target", "node").distinct().join(asked_before, ["target", "node"], "left_anti")
        links, _ = compare(asked, larger.limit(0), "rest")
        roots = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), space, "rest")

    # the root goes to the classes first, and frequent classes are broadcast: a text that many rows hold is no task's load
    found = classes.join(roots.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2"), "left")
    found = space.save(found.select("sig", "rows", F.coalesce("root", "node").alias("component")), "found")
    named = join_by_key(digests, found, ["sig"], "rows", how="left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
