"""Range asymmetric numeral system (static) for token ids.

One frequency table, taken from the counts of all ids of the corpus, serves
every block.  A block is a fixed number of ids dealt to interleaved lanes; it
decodes without any other block.  Checkpoints inside a block hold the lanes'
states and the place in its words, so its parts decode side by side too.  A
checksum over the ids guards each block.

Files: a Parquet folder ``blocks`` (a row for each block, see BLOCK), the table
``frequencies`` and the table ``shards`` (the ids before each shard).
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .subwords import encoder
from .workspace import Workspace, shuffle_partitions

LOW = 31  # states stay in [2^31, 2^63), words have 32 bits
LANES, STEPS, EVERY = 128, 512, 256
BLOCK_IDS = LANES * STEPS
BATCH_BLOCKS = 16

BLOCK = (
    "shard int, block int, first long, n int, words binary, states binary, marks binary, crc long, "
    "doc_id array<long>, doc_first array<long>, seg_start array<long>, seg_len array<long>, doc_len array<long>"
)
SEGMENT = "shard int, doc_first long, doc_id long, seg_start long, seg_len long, doc_len long, ids binary, crc long"


def normalised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2^bits; every id with a count gets 1 at least."""
    total, room = int(counts.sum()), 1 << bits
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.zeros(len(counts), np.uint64)
    if len(seen) > room:
        raise ValueError(f"{len(seen)} symbols don't fit a table of 2^{bits}")
    freq = np.zeros(len(counts), np.int64)
    freq[seen] = np.maximum(1, np.floor(counts[seen].astype(np.float64) * room / total)).astype(np.int64)
    spare, order = room - int(freq.sum()), seen[np.argsort(-counts[seen], kind="stable")]
    while spare:
        if spare > 0:
            freq[order[0]] += spare
            spare = 0
        else:
            can = order[freq[order] > 1]
            cut = np.minimum(freq[can] - 1, np.maximum(1, freq[can] * -spare // max(1, int(freq[can].sum()))))
            cut = np.where(np.cumsum(cut) <= -spare, cut, np.maximum(0, -spare - (np.cumsum(cut) - cut)))
            freq[can] -= cut
            spare += int(cut.sum())
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes batches of blocks with one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.fill = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes, bytes]]:
        """(words, states at the checkpoints, places of the checkpoints) of each block."""
        nb, width = len(blocks), len(blocks) * LANES
        ids = np.full((nb, BLOCK_IDS), self.fill, np.int64)
        for row, block in zip(ids, blocks, strict=True):
            row[: len(block)] = block
        ids = ids.reshape(nb, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, width)
        bits, top = np.uint64(self.bits), np.uint64(2 * LOW + 1 - self.bits)
        x = np.full(width, 1 << LOW, np.uint64)
        words, sent = np.empty((STEPS, width), np.uint32), np.empty((STEPS, width), bool)
        states = np.empty((STEPS // EVERY, width), np.uint64)
        for t in range(STEPS - 1, -1, -1):
            f, c = self.freq[ids[t]], self.cum[ids[t]]
            out = x >= (f << top)
            words[t], sent[t] = x.astype(np.uint32), out
            x = np.where(out, x >> np.uint64(32), x)
            q = x // f
            x = (q << bits) + (x - q * f) + c
            if t % EVERY == 0:
                states[t // EVERY] = x
        made = []
        for b in range(nb):
            lane = slice(b * LANES, (b + 1) * LANES)
            emitted = sent[:, lane]
            before = np.concatenate([[0], np.cumsum(emitted.sum(axis=1))])[:-1:EVERY].astype("<u4")
            made.append((words[:, lane][emitted].astype("<u4").tobytes(), states[:, lane].astype("<u8").tobytes(), before.tobytes()))
        return made

    def decode(self, blocks: list[tuple[bytes, bytes, bytes, int]]) -> list[np.ndarray]:
        """Ids of each (words, states, marks, n).  All parts between checkpoints run side by side."""
        parts = STEPS // EVERY
        flat, at, x = [], [], []
        base = 0
        for words, states, marks, _ in blocks:
            flat.append(np.frombuffer(words, "<u4"))
            at.append(np.frombuffer(marks, "<u4").astype(np.int64) + base)
            x.append(np.frombuffer(states, "<u8").reshape(parts, LANES))
            base += len(flat[-1])
        stream = np.concatenate([*flat, np.zeros(1, np.uint32)]).astype(np.uint64)
        at, x = np.concatenate(at), np.concatenate(x).astype(np.uint64)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.empty((EVERY, *x.shape), np.uint32)
        for t in range(EVERY):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> bits) + slot - self.cum[s]
            need = x < np.uint64(1 << LOW)
            place = np.cumsum(need, axis=1)
            rows = np.where(need, at[:, None] + place - 1, 0)
            x = np.where(need, (x << np.uint64(32)) | stream[rows], x)
            at = at + place[:, -1]
        ids = out.transpose(1, 0, 2).reshape(len(blocks), BLOCK_IDS)
        return [row[:n] for row, (*_, n) in zip(ids, blocks, strict=True)]


def crc_join(first: int, second: int, length: int) -> int:
    """Crc32 of two byte strings put together, from theirs and the second's length."""

    def apply(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if not vector:
                break
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    if not length:
        return first
    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # shifts by one zero bit
    length *= 8
    while length:
        if length & 1:
            first = apply(matrix, first)
        matrix = [apply(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second


def _ids_table(docs: DataFrame, path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, ids (unsigned 16-bit where the vocabulary allows, else 32-bit; little-endian), width.

    The last row of a task has n = -1 and holds what it has counted: ids, then
    how often each stands, both 64-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        width = 2 if coder.vocab_size <= 1 << 16 else 4
        kind, names = f"<u{width}", ["doc_id", "n", "ids", "width"]
        total = np.zeros(coder.vocab_size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [coder.encode(t) + end for t in part.column(1).to_pylist()]
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(kind)
                own = np.bincount(flat, minlength=len(total))
                own[: len(total)] += total
                total = own
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((cuts * width).astype(np.int64)), pa.py_buffer(flat.view(np.uint8))])
                columns = [part.column(0), pa.array(np.diff(cuts)), raw.cast(pa.binary()), pa.array(np.full(len(ids), width, np.int32))]
                yield pa.record_batch(columns, names=names)
        seen = np.flatnonzero(total)
        counted = np.concatenate([seen, total[seen]]).astype("<i8").tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([counted], pa.binary()), pa.array([0], pa.int32())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary, width int")


def _as_ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def _counts(table: DataFrame) -> np.ndarray:
    """Corpus-wide counts by id.  The driver gets a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, counts = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(ids), pa.array(counts)], names=["id", "count"])

    rows = table.filter("n < 0").select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["count"]
    return counts


def write_ids(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int | None = 1,
    table_bits: int = 18,
    shard_ids: int = 16_000_000,
    max_shards: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Workspace:
    """Encode whole texts and write their ids in ascending id order; returns the folder.

    Documents are dealt to shards by ranges of their id, so ids run on from shard
    to shard.  table_bits: the frequency table sums to 2^table_bits (more where
    the ids need it).  shard_ids: ids to a shard, as far as max_shards allows.

    Null or empty texts give the end id alone (no id without one).  Documents
    with null ids come first.  Repeated rows are written once each, in an order
    that is the same on every read.  An empty table gives files without blocks.
    Other columns are not read.
    """
    space = Workspace(spark, "rans")
    table = space.save(_ids_table(docs, tokenizer_path, end_id, id_col, text_col), "ids")
    ids, counts = table.filter("n >= 0"), _counts(table)
    bits = max(table_bits, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))) + 1)
    freq = normalised(counts, bits)
    space.save(spark.createDataFrame([(int(i), int(freq[i]), bits) for i in np.flatnonzero(freq)], "id long, frequency long, bits int").coalesce(1), "frequencies")
    sent = spark.sparkContext.broadcast((freq, bits))  # a number for each id of the vocabulary
    shards = min(max_shards, max(shuffle_partitions(spark), -(-int(counts.sum()) // shard_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number, first, before = None, None, 0, 0, 0
        held, size, segments = deque(), 0, deque()  # what no block has taken yet
        ready: list[tuple] = []

        def cut(n: int) -> None:
            """Take the next n ids as a block."""
            nonlocal size, number, first
            taken, mine, room = [], [], n
            while room:
                taken.append(held[0][:room])
                held[0] = held[0][room:]  # a view: a long document isn't copied for each of its blocks
                room -= len(taken[-1])
                if not len(held[0]):
                    held.popleft()
            room = n
            while segments and (room or not segments[0][3]):
                doc_id, doc_first, start, length, doc_len = segments.popleft()
                part = min(length, room)
                mine.append((doc_id, doc_first, start, part, doc_len))
                if length > part:
                    segments.appendleft((doc_id, doc_first, start + part, length - part, doc_len))
                room -= part
            block = np.concatenate(taken) if taken else np.zeros(0, np.uint32)
            ready.append((number, first, block.astype(np.uint32, copy=False), mine))
            size -= n
            number, first = number + 1, first + n

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal coder
            coder = coder or Coder(*sent.value)
            rows = []
            for (no, at, block, mine), (words, states, marks) in zip(ready, coder.encode([r[2] for r in ready]), strict=True):
                rows.append((shard, no, at, len(block), words, states, marks, zlib.crc32(block.astype("<u4").tobytes()), *([list(c) for c in zip(*mine, strict=True)] or [[]] * 5)))
            ready.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), *[pa.list_(pa.int64())] * 5]
            names = [f.split()[0] for f in BLOCK.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, raw, width, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                block = _as_ids(raw, width)
                segments.append((doc_id, before, 0, len(block), len(block)))
                if len(block):
                    held.append(block)
                size += len(block)
                before += len(block)
                while size >= BLOCK_IDS:
                    cut(BLOCK_IDS)
                    if len(ready) == BATCH_BLOCKS:
                        yield from flush()
        if segments:
            cut(size)
        if ready:
            yield from flush()

    dealt = (
        ids.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
        .select("doc_id", "ids", "width", F.spark_partition_id().alias("shard"))
    )
    blocks = space.save(dealt.mapInArrow(run, BLOCK), "blocks", "uncompressed")
    space.drop("ids")
    before, rows = 0, []
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # max_shards rows at most
        rows.append((r["shard"], before, r["n"]))
        before += r["n"]
    space.save(spark.createDataFrame(rows, "shard int, before long, n long").coalesce(1), "shards")
    return space


def read_segments(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Decode the files: a row for each document's part in each block, with its ids or their checksum only.

    Raises where a block's ids don't have its checksum.
    """
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # a row for each id of the vocabulary
    freq = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.uint64)
    for r in rows:
        freq[r["id"]] = r["frequency"]
    table = spark.sparkContext.broadcast((freq, rows[0]["bits"] if rows else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*table.value)
        types = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.int64()]
        names = [f.split()[0] for f in SEGMENT.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_BLOCKS):
                part = batch.slice(at, BATCH_BLOCKS).to_pylist()
                rows = []
                for r, ids in zip(part, coder.decode([(r["words"], r["states"], r["marks"], r["n"]) for r in part]), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != r["crc"]:
                        raise ValueError(f"checksum of block {r['block']} in shard {r['shard']} is wrong")
                    place = 0
                    for doc_id, doc_first, start, length, doc_len in zip(r["doc_id"], r["doc_first"], r["seg_start"], r["seg_len"], r["doc_len"], strict=True):
                        own = raw[place * 4 : (place + length) * 4]
                        rows.append((r["shard"], doc_first, doc_id, start, length, doc_len, own if with_ids else None, zlib.crc32(own)))
                        place += length
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.parquet(f"{path}/blocks").drop("first").mapInArrow(run, SEGMENT)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the decoded files."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column(3).to_pylist():
                whole = 0
                for p in sorted(parts, key=lambda p: p["seg_start"]):
                    whole = crc_join(whole, p["crc"], p["seg_len"] * 4) if p["seg_start"] else p["crc"]
                crcs.append(whole)
            yield pa.record_batch([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # doc_first is a document's own place, but documents without ids share one
    segments = read_segments(spark, path, with_ids=False)
    whole = segments.groupBy("shard", "doc_first", "doc_id", "doc_len", F.when(F.col("doc_len") == 0, F.monotonically_increasing_id()).alias("empty")).agg(
        F.collect_list(F.struct("seg_start", "seg_len", "crc")).alias("parts"), F.sum("seg_len").alias("n")
    )
    shards = F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "before"))  # max_shards rows at most
    placed = whole.join(shards, "shard").select("doc_id", (F.col("before") + F.col("doc_first")).alias("start"), F.col("n").alias("n_tokens"), "parts")
    return placed.mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")
