"""Packing by minimum bin slack.

Documents become fixed-capacity sequences.  Whole windows are cut off a long
document first; what remains of each document (shorter than a window) is packed
by the minimum-bin-slack rule: the longest remainder opens a window and a
bitset subset-sum over the multiset of remaining lengths finds the lengths that
fill it closest to capacity, with the counts of each length backtracked from
the bitsets.

Scale: a task packs the documents of its own partition in pools of a bounded
token count, so there is no shuffle, no global state and a lost task is simply
run again.  Thousands of remainders meet in a pool, so windows fill exactly
until its end; there a remainder is cut to close the slack, and the last window
of a pool is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .subwords import encoder
from .workers import release

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def closest_subset(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The multiset of ``lengths`` whose sum comes closest to ``room`` from below.

    lengths: distinct, ascending; counts: how many there are of each.  Returns
    (sum, {length: times}).  Bit s of a bitset says that sum s can be reached;
    longer lengths come first, and the pass ends as soon as ``room`` is reached.
    Ties go to the multiset found first, which uses the longer lengths.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, trail = 1, []
    for length in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        before, left, step = reach, min(counts[length], room // length), 1
        while left > 0:  # binary splitting: any number of copies up to the count
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach != before:
            trail.append((length, before))
        if reach & goal:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, before in reversed(trail):
        times = 0
        while not (before >> at) & 1:  # the fewest copies that lead back to an earlier sum
            at -= length
            times += 1
        if times:
            used[length] = times
    return total, used


def pack_lengths(remainders: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start within its remainder, length).

    remainders: (document, length) with 0 < length < capacity.  All windows but
    the last ones hold exactly ``capacity``; the last have power-of-two lengths.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for doc, length in remainders:
        by.setdefault(length, []).append((doc, 0))
    for members in by.values():
        members.reverse()
    lengths, counts = sorted(by), {n: len(m) for n, m in by.items()}
    total = sum(n * c for n, c in counts.items())

    def take(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
            lengths.pop(bisect.bisect_left(lengths, length))
        return by[length].pop()

    def put(length: int, doc: int, start: int) -> None:
        if length not in counts:
            bisect.insort(lengths, length)
            counts[length] = 0
        counts[length] += 1
        by.setdefault(length, []).append((doc, start))

    windows = []
    while total >= capacity:
        seed = lengths[-1]
        doc, start = take(seed)
        window, room = [(doc, start, seed)], capacity - seed
        filled, used = closest_subset(lengths, counts, room)
        for length, times in used.items():
            for _ in range(times):
                doc, start = take(length)
                window.append((doc, start, length))
        if slack := room - filled:  # more than this is left, so a longer remainder can give it
            length = lengths[bisect.bisect_right(lengths, slack)] if lengths[-1] > slack else lengths[-1]
            doc, start = take(length)
            part = min(slack, length)
            window.append((doc, start, part))
            if length > part:
                put(length - part, doc, start + part)
            while (missing := capacity - sum(n for _, _, n in window)) > 0:
                length = lengths[-1]
                doc, start = take(length)
                part = min(missing, length)
                window.append((doc, start, part))
                if length > part:
                    put(length - part, doc, start + part)
        windows.append(window)
        total -= capacity
    tail = [(doc, start, n) for n in reversed(lengths) for doc, start in by[n]]
    while total:
        size = 1 << (total.bit_length() - 1)
        window, missing = [], size
        while missing:
            doc, start, n = tail.pop(0)
            part = min(n, missing)
            window.append((doc, start, part))
            if n > part:
                tail.insert(0, (doc, start + part, n - part))
            missing -= part
        windows.append(window)
        total -= size
    return windows


def pack_pool(docs: list[tuple[object, bytes]], capacity: int, first: int) -> tuple[list[tuple], int]:
    """Pieces of one pool and the next free sequence id.  docs: (doc_id, ids as bytes)."""
    out, rests, sequence = [], [], first
    for i, (doc_id, ids) in enumerate(docs):
        n = len(ids) // 4
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            out.append((doc_id, start, capacity, ids[start * 4 : (start + capacity) * 4], n, sequence, 0))
            sequence += 1
        if n > whole:
            rests.append((i, n - whole))
    for window in pack_lengths(rests, capacity):
        offset = 0
        for i, start, length in window:
            doc_id, ids = docs[i]
            n = len(ids) // 4
            start += n // capacity * capacity
            out.append((doc_id, start, length, ids[start * 4 : (start + length) * 4], n, sequence, offset))
            offset += length
        sequence += 1
    return out, sequence


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 4096,
    end_id: int | None = 2,
    pool_tokens: int = 2_000_000,
    cache_words: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    Returns doc_id, start (ids of its document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (within the
    sequence, without gaps from 0).  Every id of every document lies in exactly
    one piece.  A sequence holds ``capacity`` ids or a power of two of them.

    pool_tokens and cache_words bound a task's memory: it packs so many tokens at
    a time (a longer document is a pool of its own) and keeps so many encoded
    words.  sequence_id counts from the
    partition's number times 2^33.

    Null or empty text: the end id alone (without an end id: no piece).  Null
    ids are kept.  Repeated rows are packed each on its own.  An empty table
    gives no pieces.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        coder.words.limit, encode = cache_words, coder.encode
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        pool, held, sequence = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            pieces, sequence = pack_pool(pool, capacity, sequence)
            pool.clear()
            for at in range(0, len(pieces), 2000):
                columns = zip(*pieces[at : at + 2000], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

        for doc_id, text, part in (row for b in batches for at in range(0, b.num_rows, 500) for row in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True)):
            sequence = part << 33 if sequence is None else sequence
            ids = encode(text) + end
            pool.append((doc_id, ids))
            held += len(ids) // 4
            if held >= pool_tokens:
                yield from flush()
                held = 0
        if pool:
            yield from flush()
        coder.forget()
        release()

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    return rows.mapInArrow(run, PIECES)


def padding(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: n_sequences, n_tokens, n_padding of packed pieces."""
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    power = F.col("fill").bitwiseAND(F.col("fill") - 1) == 0
    pad = F.when(power, F.lit(0)).otherwise(F.lit(capacity) - F.col("fill"))
    return fill.agg(
        F.count("*").alias("n_sequences"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(pad), F.lit(0)).alias("n_padding"),
    )
