"""Language-model scores: causal self-attention over subword ids, in numpy.

Attention over the ids before a place gives a vector, and the vector gives the
next id's probability in two steps: a softmax over classes of ids, then the
turns of a binary tree within the class.  Both steps take the vector, every id
of the vocabulary has a leaf, and the probabilities sum to 1 at every place.
Untrained, the tree says what the counts of all training texts say.

A text is cut into overlapping windows.  Windows are scored in batches with a
causal mask, and each id counts once: among the last places of one window.

Beside attention the model has a memory of whole words: how often each stands in
all training texts but the one being scored.  A word's probability is mostly
that of its ids, and for a small fixed share what the memory says.

The score stands beside a unigram base over words.  Frequent words (a bounded
number) go to the tasks with their counts; the others meet them in a join.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession, functions as F

from .subwords import encoder
from .workers import keep, release
from .workspace import Workspace, dropped_shuffles

CONTEXT, STRIDE, DIM, CLASSES = 32, 24, 24, 48
#: The memory's share of a word's probability.
MEMORY = 0.1
#: Ids that count as neighbours on either side when classes are made.
NEIGHBOURS = 128
#: Words of a drawn training window, which hold more ids than it has places.
WINDOW_WORDS = 32
#: Bytes of a drawn training window; the word that goes beyond is cut there.  Of the word before, so many of its end.
WINDOW_BYTES, BEFORE_BYTES = 4096, 256
#: Windows that one task trains on in all rounds together, and the rounds after which tasks' weights are averaged.
TASK_WINDOWS, ROUNDS = 60_000, 3
#: Words that a worker keeps before it starts afresh.
CACHE_WORDS = 300_000
#: Words and word stems that the encoder keeps beside them, from one task to the next.
STEMS = 150_000
#: Longer words are known by their digest, after a blank, which no word holds.
WORD_BYTES = 64
LN10 = math.log(10)

# ---- the model ---------------------------------------------------------------------------------


@dataclass
class Leaves:
    """Where the ids are: class of each, and its turns in the tree of its class."""

    group: np.ndarray  # class by id
    start: np.ndarray  # first turn by id
    length: np.ndarray  # turns by id
    node: np.ndarray  # inner node of each turn
    sign: np.ndarray  # 1 or -1: to which side


def leaves(counts: np.ndarray, group: np.ndarray, classes: int) -> tuple[Leaves, np.ndarray, np.ndarray]:
    """Huffman trees of the ids of each class; then what the counts say: log shares of the classes, log odds of the nodes.

    Ids that are not in the texts count a little, so that all have a leaf.
    """
    weight = counts.astype(np.float64) + 0.01
    paths: list[list[tuple[int, float]]] = [[] for _ in counts]
    lean: list[float] = []
    for g in range(classes):
        heap = [(weight[i], int(i), None) for i in np.flatnonzero(group == g)]
        heapq.heapify(heap)
        turn = len(counts)  # inner nodes sort after ids
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], turn, (len(lean), a, b)))
            lean.append(math.log(a[0] / b[0]))
            turn += 1
        stack = [(heap[0], [])] if heap else []
        while stack:
            (_, name, inner), path = stack.pop()
            if inner is None:
                paths[name] = path
            else:
                stack += [(inner[1], [*path, (inner[0], 1.0)]), (inner[2], [*path, (inner[0], -1.0)])]
    length = np.array([len(p) for p in paths], np.int64)
    flat = list(chain.from_iterable(paths))
    node = np.array([n for n, _ in flat], np.int32)
    sign = np.array([s for _, s in flat], np.float32)
    share = np.log(np.bincount(group, weights=weight, minlength=classes) + 1e-9)
    return Leaves(group.astype(np.int64), np.cumsum(length) - length, length, node, sign), (share - share.max()).astype(np.float32), np.array(lean, np.float32)


def new_parameters(vocab: int, bias: np.ndarray, lean: np.ndarray, dim: int = DIM, context: int = CONTEXT, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights before training: the output says what the counts say."""
    r = np.random.default_rng(seed)
    make = lambda *shape: (r.standard_normal(shape) / math.sqrt(dim)).astype(np.float32)
    return {
        "embed": make(vocab + 1, dim),  # the last one stands before a text's first id
        "query": make(dim, dim),
        "key": make(dim, dim),
        "value": make(dim, dim),
        "near": np.zeros(context, np.float32),  # by distance
        "top": np.zeros((dim, len(bias)), np.float32),
        "bias": bias.copy(),
        "node": np.zeros((len(lean), dim), np.float32),
        "lean": lean.copy(),
    }


#: Weights of which a batch touches few rows.
ROWS = ("embed", "node", "lean")


def distance(context: int) -> tuple[np.ndarray, np.ndarray]:
    """How far back each place sees each other one, and whether it sees it."""
    back = np.arange(context)[:, None] - np.arange(context)
    return np.maximum(back, 0), back >= 0


def forward(p: dict[str, np.ndarray], inputs: np.ndarray) -> tuple:
    """The vector at each place of each window, and what the way back needs."""
    n, w = inputs.shape
    dim = p["embed"].shape[1]
    back, seen = distance(w)
    flat = np.take(p["embed"], inputs.ravel(), axis=0)
    three = np.concatenate([p["query"] * flat.dtype.type(1 / math.sqrt(dim)), p["key"], p["value"]], axis=1)
    q, k, v = np.split((flat @ three).reshape(n, w, 3 * dim), 3, axis=2)
    a = q @ k.transpose(0, 2, 1)
    a += np.where(seen, p["near"][back], np.float32(-1e9))
    if a.max(initial=0) > 60 or np.einsum("nii->ni", a).min(initial=0) < -60:  # exp stays finite, and no place's sum vanishes
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    mixed = (a @ v).reshape(n * w, dim)
    return flat + mixed, (flat, three, mixed, q, k, v, a)


def _turns(out: Leaves, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every turn of every id: its place among the ids, and its place in the table of turns."""
    length = out.length[ids]
    ends = np.cumsum(length)
    row = np.repeat(np.arange(len(ids)), length)
    return row, np.repeat(out.start[ids] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def id_scores(p: dict[str, np.ndarray], out: Leaves, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log-probability of one id for each vector."""
    logits = h @ p["top"] + p["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    score = logits[np.arange(len(ids)), out.group[ids]] - np.log(np.exp(logits).sum(axis=1))
    row, at = _turns(out, ids)
    z = out.sign[at] * ((h[row] * p["node"][out.node[at]]).sum(axis=1) + p["lean"][out.node[at]])
    np.subtract.at(score, row, np.logaddexp(0, -z))
    return score


def _sum_rows(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, and the sum of the values of each."""
    if not len(names):
        return names, values
    order = np.argsort(names.astype(np.uint16) if names.max() < 1 << 16 else names, kind="stable")  # short ones are sorted by radix
    names = np.take(names, order)
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(np.take(values, order, axis=0), first, axis=0)


def gradients(p: dict[str, np.ndarray], out: Leaves, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean loss (nats) over places of weight 1, and its gradient; that of ROWS as (rows, values)."""
    n, w = inputs.shape
    dim = p["embed"].shape[1]
    h, (x, three, mixed, q, k, v, a) = forward(p, inputs)
    kind = h.dtype.type
    # ids with more turns first: those that have a turn at some depth are the first ones
    there = np.flatnonzero(weight.ravel())
    length = out.length[targets.ravel()[there]]
    deep = int(length.max(initial=0))
    order = np.argsort((deep - length).astype(np.uint16), kind="stable")
    there, many = there[order], np.searchsorted(-length[order], -np.arange(1, deep + 1), side="right").tolist()
    ids, own = targets.ravel()[there], np.take(h, there, axis=0)
    scale = kind(1 / max(1, len(there)))
    prob = own @ p["top"]
    prob += p["bias"]
    if prob.max(initial=0) > 60 or prob.min(initial=0) < -60:
        prob -= prob.max(axis=1, keepdims=True)
    rows, group = np.arange(len(ids)), out.group[ids]
    loss = -prob[rows, group].sum(dtype=np.float64)
    np.exp(prob, out=prob)
    total = prob @ np.ones(prob.shape[1], prob.dtype)
    loss += np.log(total).sum(dtype=np.float64)
    prob *= (scale / total)[:, None]
    prob[rows, group] -= scale
    d: dict = {"top": own.T @ prob, "bias": np.ones(len(ids), prob.dtype) @ prob}
    down = prob @ p["top"].T

    steps = list(zip(np.cumsum([0, *many]).tolist(), many, strict=False))  # by depth: where its turns begin, and how many there are
    at = np.concatenate([out.start[ids[:m]] + i for i, m in enumerate(many)]) if many else np.zeros(0, np.int64)
    node, sign = np.take(out.node, at), np.take(out.sign, at).astype(h.dtype)
    away, g = np.take(p["node"], node, axis=0), np.empty(len(at), h.dtype)
    for i, m in steps:
        np.einsum("ij,ij->i", own[:m], away[i : i + m], out=g[i : i + m])
    g += np.take(p["lean"], node)
    g *= -sign
    np.clip(g, -60, 60, out=g)
    np.exp(g, out=g)
    loss += np.log1p(g).sum(dtype=np.float64)
    g /= 1 + g
    g *= sign
    g *= -scale
    away *= g[:, None]
    each = np.empty((len(at), dim + 1), h.dtype)
    each[:, dim] = g
    for i, m in steps:
        down[:m] += away[i : i + m]
        np.multiply(own[:m], g[i : i + m, None], out=each[i : i + m, :dim])
    node, each = _sum_rows(node, each)
    d["node"], d["lean"] = (node, each[:, :dim]), (node, each[:, dim])

    dx = np.zeros_like(h)
    dx[there] = down
    dm = dx.reshape(n, w, dim)
    ds = dm @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dx, mixed).reshape(n, w, 1)
    ds *= a
    back, seen = distance(w)
    d["near"] = np.zeros_like(p["near"])
    d["near"][:w] = np.bincount(back[seen], weights=ds.sum(axis=0)[seen], minlength=w)
    made = np.empty((n, w, 3 * dim), h.dtype)
    np.matmul(ds, k, out=made[:, :, :dim])
    np.matmul(ds.transpose(0, 2, 1), q, out=made[:, :, dim : 2 * dim])
    np.matmul(a.transpose(0, 2, 1), dm, out=made[:, :, 2 * dim :])
    made = made.reshape(n * w, 3 * dim)
    d["query"], d["key"], d["value"] = np.split(x.T @ made, 3, axis=1)
    d["query"] *= kind(1 / math.sqrt(dim))
    dx += made @ three.T
    d["embed"] = _sum_rows(inputs.ravel(), dx)
    return float(loss * scale), d


def fit(p: dict[str, np.ndarray], out: Leaves, rows: np.ndarray, *, batch: int = 64, passes: int = 1, rate: float = 0.08, seed: int = 7) -> tuple[dict[str, np.ndarray], list[float]]:
    """Train a copy of ``p`` on rows of ids (what stands before the window, then the window, -1 for none) by Adagrad."""
    p, losses, r = {k: v.copy() for k, v in p.items()}, [], np.random.default_rng(seed)
    square = {k: np.full(v.shape[:1] if k in ROWS else v.shape, 1e-6 if k in ROWS else 1e-4, np.float32) for k, v in p.items()}
    for _ in range(passes):
        order = r.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = rows[order[at : at + batch]]
            weight = pick[:, 1:] >= 0
            pick = np.maximum(pick, 0)
            loss, d = gradients(p, out, pick[:, :-1], pick[:, 1:], weight)
            losses.append(float(loss))
            for k, g in d.items():
                if k in ROWS:
                    own, g = g
                    so_far = square[k][own] + (np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g)
                    square[k][own] = so_far
                    step = rate / np.sqrt(so_far)
                    p[k][own] -= (step[:, None] if g.ndim > 1 else step) * g
                else:
                    square[k] += g * g
                    p[k] -= rate / 4 / np.sqrt(square[k]) * g
    return p, losses


# ---- scoring -----------------------------------------------------------------------------------


class Scorer:
    """Scores texts' ids.  As :func:`forward` and :func:`id_scores`, for places that count only and in fewer steps."""

    def __init__(self, p: dict[str, np.ndarray], out: Leaves, stride: int = STRIDE, batch: int = 192):
        self.out, self.stride, self.batch = out, stride, batch
        self.dim, self.context = p["embed"].shape[1], len(p["near"])
        e, one = p["embed"], np.ones((len(p["embed"]), 1), np.float32)
        # by id as an input: itself, its query, its key, its value and a 1 that sums the weights; zeros where there is no id
        parts = [e, 0 * one, e @ (p["query"] / np.float32(math.sqrt(self.dim))), e @ p["key"], e @ p["value"], one]
        self.table = np.concatenate([np.concatenate(parts, axis=1), np.zeros((1, 4 * self.dim + 2), np.float32)]).astype(np.float32)
        self.top = np.concatenate([p["top"], p["bias"][None]]).astype(np.float32)
        node = np.concatenate([p["node"], p["lean"][:, None]], axis=1)
        self.turn, self.node = out.node + np.where(out.sign > 0, len(node), 0).astype(np.int32), np.concatenate([node, -node]).astype(np.float32)
        back, seen = distance(self.context)
        self.seen = (np.exp(p["near"][back]) * seen)[self.context - stride :].astype(np.float32)
        self.deep = int(out.length.max(initial=0))

    def scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability of every id of texts laid end to end.

        Each text is laid behind at least as many empty places as a window looks
        back, and at a multiple of the stride, so that all windows are one
        regular view of the places.
        """
        stride, lead = self.stride, self.context - self.stride
        room = -(-(lengths + lead) // stride) * stride
        place = np.arange(len(ids)) + np.repeat(lead + np.cumsum(room) - room - (np.cumsum(lengths) - lengths), lengths)
        inputs = np.full(lead + int(room.sum()), len(self.table) - 1, np.int64)
        inputs[place[1:]] = ids[:-1]
        inputs[place[(np.cumsum(lengths) - lengths)[lengths > 0]]] = len(self.table) - 2
        out = np.empty(len(ids), np.float32)
        for at in range(0, len(inputs) - lead, self.batch * stride):
            end = min(at + self.batch * stride, len(inputs) - lead)
            low, high = np.searchsorted(place, (at + lead, end + lead))
            if low < high:
                own = ids[low:high]
                length = self.out.length[own]
                # ids with more turns first: those that have a turn at some depth are the first ones
                order = np.argsort((self.deep - length).astype(np.uint8), kind="stable")
                many = np.searchsorted(-length[order], -np.arange(1, self.deep + 1), side="right")
                h = np.take(self._vectors(inputs[at : end + lead]), (place[low:high] - at - lead)[order], axis=0, mode="clip")
                out[low + order] = self._of(h, own[order], many)
        return out

    def _vectors(self, inputs: np.ndarray) -> np.ndarray:
        """Vectors of all places but the first lead ones, and a 1."""
        stride, dim, lead = self.stride, self.dim, self.context - self.stride
        x = np.take(self.table, inputs, axis=0, mode="clip")
        n, (step, one) = (len(x) - lead) // stride, x.strides
        view = lambda first, rows, a, b: as_strided(x[first:, a:], (n, rows, b - a), (step * stride, step, one))
        a = view(lead, stride, dim + 1, 2 * dim + 1) @ view(0, self.context, 2 * dim + 1, 3 * dim + 1).transpose(0, 2, 1)
        if (most := float(a.max())) > 60:  # exp stays finite; common factors cancel
            a -= most - 60
        np.exp(a, out=a)
        a *= self.seen
        mixed = (a @ view(0, self.context, 3 * dim + 1, 4 * dim + 2)).reshape(n * stride, dim + 1)
        mixed /= np.maximum(mixed[:, dim:], np.float32(1e-30))
        mixed += x[lead:, : dim + 1]
        return mixed

    def _of(self, h: np.ndarray, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Log-probability of an id for each vector, of which the first ``many[d]`` have a turn at depth d."""
        logits = h @ self.top
        if logits.max(initial=0) > 60:
            logits -= logits.max(axis=1, keepdims=True)
        score = logits[np.arange(len(ids)), self.out.group[ids]]
        np.exp(logits, out=logits)
        score -= np.log(logits @ np.ones(logits.shape[1], np.float32))
        at = self.out.start[ids]
        for n in many.tolist():
            if not n:
                break
            z = np.einsum("ij,ij->i", h[:n], np.take(self.node, np.take(self.turn, at[:n], mode="clip"), axis=0, mode="clip"))
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            z += 1
            np.log(z, out=z)
            score[:n] -= z
            at += 1
        return score


# ---- classes -----------------------------------------------------------------------------------


def neighbour_cells(rows: np.ndarray, column: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Cells (id, column) of the common ids right and then left of each id in training windows."""
    a, b = rows[:, 1:-1].ravel(), rows[:, 2:].ravel()
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    cells = []
    for token, near, shift in ((a, b, 0), (b, a, neighbours)):
        ok = column[near] >= 0
        cells.append(token[ok] * 2 * neighbours + column[near[ok]] + shift)
    return np.concatenate(cells)


def neighbour_classes(counts: np.ndarray, cells: np.ndarray, times: np.ndarray, classes: int = CLASSES, *, neighbours: int = NEIGHBOURS, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Class of each id, by k-means on what stands left and right of it; ids without neighbours are dealt out by id."""
    vocab = len(counts)
    group = np.arange(vocab) % classes
    row = np.full(vocab, -1)
    seen = np.unique(cells // (2 * neighbours))
    if len(seen) <= classes:
        return group
    row[seen] = np.arange(len(seen))
    features = np.zeros((len(seen), 2 * neighbours), np.float32)
    features[row[cells // (2 * neighbours)], cells % (2 * neighbours)] = times
    features = np.sqrt(features)
    features /= np.maximum(1e-6, np.linalg.norm(features, axis=1, keepdims=True))
    weight = np.sqrt(counts[seen] + 1).astype(np.float32)
    centre = features[np.argsort(-counts[seen], kind="stable")[:classes]].copy()
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        near = np.argmax(features @ centre.T, axis=1)
        for g in range(classes):
            own = near == g
            centre[g] = (features[own] * weight[own, None]).sum(axis=0) if own.any() else features[r.integers(len(seen))]
        centre /= np.maximum(1e-6, np.linalg.norm(centre, axis=1, keepdims=True))
    group[seen] = np.argmax(features @ centre.T, axis=1)
    return group


# ---- words and windows -------------------------------------------------------------------------


class Words(dict):
    """Numbers of words, and by number: ids, and how often the word stands in the training texts.

    Starts afresh before a batch that finds it full.  The count is not a number
    for words whose counts were not sent.
    """

    def __init__(self, coder, counts: dict[bytes, int], end_id: int, ends: int):
        super().__init__()
        self.coder, self.counts, self.ends_with = coder, counts, (end_id, ends)
        coder.words.limit = STEMS
        self.restart()

    def restart(self) -> None:
        """Forget all words but the end of a text, which is number 0 and stands for a word that no text holds."""
        self.clear()
        self.names: list[bytes] = []
        self.start, self.length, self.ids, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        self[b" end"]  # noqa: B018
        self._add([np.uint32(self.ends_with[0]).tobytes()], [self.ends_with[1]])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number

    def _encoded(self, word: str) -> bytes:
        """Ids of a word, kept for other tasks while there is room: the frequent words come first."""
        kept = self.coder.words
        ids = kept.get(word)
        if ids is None:
            ids = kept.fresh(word)
            if len(kept) < kept.limit and len(word) <= WORD_BYTES:
                kept[word] = ids
        return ids

    def _add(self, raw: list[bytes], times: list[float]) -> None:
        length = np.array([len(r) // 4 for r in raw], np.int64)
        self.start = np.concatenate([self.start, np.cumsum(length) - length + len(self.ids)])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4").astype(np.int32)])
        self.times = np.concatenate([self.times, times])

    def places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Number and document of every word and end, in order."""
        if len(self.names) >= CACHE_WORDS:
            self.restart()
        known, counts = len(self.names), np.array([len(t) for t in texts], np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if new := self.names[known:]:
            get = self.counts.get
            self._add([self._encoded(w.decode("utf-8", "ignore")) for w in new], [get(w if len(w) <= WORD_BYTES else word_key(w), math.nan) for w in new])
        return np.insert(numbers, np.cumsum(counts), 0), np.repeat(np.arange(len(texts)), counts + 1)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words laid end to end, and how many each has."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.start[numbers] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.int64), length


def split_words(texts: pa.Array) -> list[list[bytes]]:
    """Words of each text, A-Z as a-z; null texts have none."""
    return [r.lower().split() if r else [] for r in texts.cast(pa.binary()).to_pylist()]


def word_key(word: bytes) -> bytes:
    """What a word is counted by: itself, or a blank and its 128-bit digest if it is long."""
    import xxhash

    return word if len(word) <= WORD_BYTES else b" d" + xxhash.xxh3_128_digest(word)


#: What else is counted beside words begins with a blank: ids of long words, and training windows.
LONG, ID, WINDOW = b" d", b" i", b" w"


def drawn_windows(words: list[bytes], every: int) -> Iterator[bytes]:
    """About one run of WINDOW_WORDS words for ``every`` words of a text, from places that the text's checksum picks.

    A run holds the word before it, too (after ``-``), or starts the text (after
    ``^``), and may reach the text's end (before a blank and ``$``).  It ends
    within the word that goes beyond WINDOW_BYTES, whose ids fill a window anyway.
    """
    seed, n = zlib.crc32(b" ".join(words)), len(words)
    for j in range(n // every + (seed % every < n % every)):
        start = zlib.crc32(j.to_bytes(8, "little"), seed) % n
        part = words[start : start + WINDOW_WORDS]
        end = b" $" if start + WINDOW_WORDS >= n else b""
        before = b"-" + words[start - 1][-BEFORE_BYTES:] + b" " if start else b"^"
        if sum(map(len, part)) > WINDOW_BYTES:
            held, left = [], WINDOW_BYTES
            for w in part:
                held.append(w[:left])
                left -= len(w)
                if left <= 0:
                    break
            part, end = held, b""
        yield before + b" ".join(part) + end


def window_ids(window: bytes, coder, start_id: int, end_id: int, context: int = CONTEXT) -> np.ndarray:
    """A drawn window's first ids: what stands before, ``context`` ids, -1 for none."""
    words = window[1:].split(b" ")
    ends = words[-1] == b"$"
    ids = [np.frombuffer(coder.words.fresh(w.decode("utf-8", "ignore")), "<u4").astype(np.int64) for w in (words[:-1] if ends else words)]
    if window[:1] == b"-":
        before, ids = ids[0][-1:], ids[1:]
    else:
        before = np.array([start_id])
    flat = np.concatenate([before if len(before) else np.array([start_id]), *ids, np.array([end_id] if ends else [], np.int64)])[: context + 1]
    return np.concatenate([flat, np.full(context + 1 - len(flat), -1)])


def cut_windows(ids: np.ndarray, lengths: np.ndarray, start_id: int, context: int = CONTEXT) -> np.ndarray:
    """Rows of what stands before a window, then its ``context`` ids, -1 for none: texts laid end to end, each cut whole, so that every id stands in one window."""
    room = -(-lengths // context) * context
    begins = np.cumsum(room) - room
    flat = np.full(int(room.sum()), -1, np.int64)
    flat[np.arange(len(ids)) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)] = ids
    before = np.append(start_id, flat[context - 1 : -1 : context])[: len(flat) // context]
    before[begins[room > 0] // context] = start_id
    return np.concatenate([before[:, None], flat.reshape(-1, context)], axis=1)


def all_windows(texts: DataFrame, coder_path: str, start_id: int, end_id: int, context: int = CONTEXT) -> DataFrame:
    """ids (little-endian 32-bit): windows that hold every id of every text of the column text, and its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(encoder(coder_path), {}, end_id, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                where, doc = words.places(held := split_words(batch.column(0).slice(at, 250)))
                ids, length = words.ids_of(where)
                rows = cut_windows(ids, np.bincount(doc, weights=length, minlength=len(held)).astype(np.int64), start_id, context)
                raw = pa.py_buffer(rows.astype("<i4").tobytes())
                yield pa.record_batch([pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (context + 1)), len(rows), [None, raw]).cast(pa.binary())], names=["ids"])
        del words
        release()

    return texts.select("text").mapInArrow(run, "ids binary")


def count_words(texts: DataFrame, coder_path: str, every: int | None = None, *, flush: int = 300_000) -> DataFrame:
    """key (binary), c: how often each word stands in the column text; with it the ids of long words, and windows drawn for ``every`` so many words.

    A task counts before it sends, and sends what it has at ``flush`` keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["key", "c"])
            counts.clear()

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                words = (raw.as_py() or b"").lower().split()
                if not words:
                    continue
                if max(map(len, words)) > WORD_BYTES:
                    for w in words:
                        if len(w) > WORD_BYTES:
                            ids = encoder(coder_path).words.fresh(w.decode("utf-8", "ignore"))
                            counts.update(ID + ids[i : i + 4] for i in range(0, len(ids), 4))
                    counts.update(map(word_key, words))
                else:
                    counts.update(words)
                if every:
                    counts.update(WINDOW + w for w in drawn_windows(words, every))
                if len(counts) >= flush:
                    yield from out()
        yield from out()
        release()

    return texts.select("text").mapInArrow(run, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _counted_ids(counts: DataFrame, coder_path: str, vocab: int) -> np.ndarray:
    """How often each id stands in the training texts: from the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = encoder(coder_path).words, np.zeros(vocab, np.int64)
        words.limit = STEMS
        for batch in batches:
            raw = [k[2:] if k[:2] == ID else words.fresh(k.decode("utf-8", "ignore")) for k in batch.column(0).to_pylist()]
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            total += np.bincount(ids, weights=np.repeat(batch.column(1).to_numpy(), [len(r) // 4 for r in raw]), minlength=vocab).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "c"])
        release()

    kind = F.substring("key", 1, 2)
    known = counts.filter((F.substring("key", 1, 1) != F.lit(b" ")) | (kind == F.lit(ID)))
    every = np.zeros(vocab, np.int64)
    for part in known.mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow().to_batches():  # vocab rows at most
        every[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return every


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train(spark: SparkSession, windows: DataFrame, counts: np.ndarray, *, classes: int = CLASSES, dim: int = DIM, context: int = CONTEXT, task_windows: int = TASK_WINDOWS, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], Leaves]:
    """Weights and leaves, fitted to all rows of ``windows`` (ids: little-endian 32-bit, -1 for none).

    Each round deals its share of the windows to tasks.  A task trains on its
    own from the same weights and sends what it changed; a weight becomes the
    mean over the tasks that changed it.  What comes to the driver is bounded by
    the size of the model, whatever the corpus.
    """
    vocab = len(counts)
    column = np.full(vocab, -1)
    common = np.argsort(-counts, kind="stable")[:NEIGHBOURS]
    common = common[counts[common] > 0]
    column[common] = np.arange(len(common))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, context + 1).astype(np.int64)
            cell, times = np.unique(neighbour_cells(rows, column), return_counts=True)
            yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(times, pa.int64())], names=["cell", "c"])

    near = windows.select("ids").mapInArrow(neighbours, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # 2 * NEIGHBOURS * vocab rows at most
    group = neighbour_classes(counts, near.column(0).to_numpy(), near.column(1).to_numpy(), classes)
    out, bias, lean = leaves(counts, group, classes)
    p = new_parameters(vocab, bias, lean, dim, context)
    tasks = max(1, -(-windows.count() // task_windows))
    for turn in range(rounds):
        model = spark.sparkContext.broadcast((p, out))  # bounded by vocab

        def run(batches: Iterator[pa.RecordBatch], turn=turn, model=model) -> Iterator[pa.RecordBatch]:
            held = sorted(chain.from_iterable(b.column(0).to_pylist() for b in batches))
            if held:
                keep()
                before, leaves_ = model.value
                rows = np.frombuffer(b"".join(held), "<i4").reshape(-1, context + 1).astype(np.int64)
                after, _ = fit(before, leaves_, rows, rate=0.08 / (1 + 0.5 * turn), seed=turn)
                change = _flat(after) - _flat(before)
                at = np.flatnonzero(change)
                for i in range(0, len(at), 100_000):
                    yield pa.record_batch([pa.array(at[i : i + 100_000], pa.int32()), pa.array(change[at[i : i + 100_000]], pa.float32())], names=["at", "change"])
            release()

        share = windows.filter(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == turn).select("ids").repartition(tasks, "ids")  # distinct ones: even, and the same however the table lies
        merged = share.mapInArrow(run, "at int, change float").groupBy("at").agg(F.avg("change").alias("change")).toArrow()  # a row for each weight at most
        flat = _flat(p)
        flat[merged.column(0).to_numpy()] += merged.column(1).to_numpy().astype(np.float32)
        p = _shaped(flat, p)
    return p, out


# ---- the operator ------------------------------------------------------------------------------


def with_memory(ids: np.ndarray, others: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Natural log-probability of words: their ids' (natural log), and for a share of MEMORY how often they stand in other texts, of ``left`` words there."""
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.where((others > 0) & (left > 0), np.log(MEMORY * others / np.maximum(left, 1)), -np.inf)
    return np.logaddexp(ids + math.log(1 - MEMORY), seen)


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    *,
    held_out_fold: int = 1,
    end_id: int = 49407,
    head_words: int = 150_000,
    window_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score all whole texts.

    Learns from documents whose crc32(id as text) modulo 5 isn't
    ``held_out_fold``.  All their words are counted; the counts of ids that
    follow are what the model says before training, and the words are its
    memory.  The attention weights are trained on every id of every one of these
    texts, cut into windows; equal windows count once.  ``window_every`` trains on
    drawn windows instead, one for so many words, where time is short.  Windows
    are told apart by their ids, so file and partition layout change no score
    (beyond the rounding of a mean over tasks).
    ``head_words`` bounds how many words' counts are sent to the tasks (the most
    frequent); it changes no result.

    Returns doc_id, held_out, n_tokens (words and the end), n_known, train_tokens,
    base_score, score: the model's log10 probability of the text and its end.
    The memory leaves out the text itself, so that a training text is not told
    by its own words.

    Null and empty texts hold the end only.  Null ids count as held out.
    Repeated rows are scored each; an empty table gives none.  If there is
    nothing to learn from, counts are 0.  Other columns are not read.
    """
    space = Workspace(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = rows.select("doc_id", "text", F.coalesce(crc == held_out_fold, F.lit(True)).alias("held_out"))
    learn = rows.filter(~F.col("held_out"))
    coder = encoder(tokenizer_path)
    vocab = max(coder.vocab_size, end_id + 1)
    if not coder.cached:
        raise ValueError("this vocabulary encodes words differently in context")

    n_docs = learn.count()
    with dropped_shuffles(spark):
        counts = space.save(count_words(learn, tokenizer_path, window_every), "words")
    word = (F.substring("key", 1, 1) != F.lit(b" ")) | (F.substring("key", 1, 2) == F.lit(LONG))
    words = counts.filter(word)
    known = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = known["n"] + n_docs, known["v"] + bool(n_docs)  # with the ends
    bottom = math.log10(tokens + 0.5 * (distinct + 1))

    # the count that head_words words have at least; a row for each power of 2^(1/4) comes here
    level = F.floor(F.log2(F.col("c")) * 4).cast("int")
    cut, sent = 1 << 62, 0
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if sent + r["count"] > head_words:
            break
        sent, cut = sent + r["count"], r["level"]
    head = {bytes(r["key"]): r["c"] for r in words.filter(level >= cut).collect()}  # of WORD_BYTES at most each

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        coder.words.limit = STEMS
        for batch in batches:
            made = [window_ids(k[2:], coder, vocab, end_id).astype("<i4").tobytes() for k in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(made, pa.binary())], names=["ids"])
        release()

    if window_every:
        made = counts.filter(F.substring("key", 1, 2) == F.lit(WINDOW)).select("key").mapInArrow(encoded, "ids binary")
    else:
        made = all_windows(learn, tokenizer_path, vocab, end_id)
    with dropped_shuffles(spark):  # they would hold the windows twice more
        windows = space.save(made.distinct(), "windows")
        by_id = _counted_ids(counts, tokenizer_path, vocab)
        by_id[end_id] += n_docs
        weights, out = train(spark, windows, by_id)
    space.drop("windows")
    model = spark.sparkContext.broadcast((weights, out, head))  # bounded by vocab and head_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        weights, out, sent = model.value
        scorer, words = Scorer(weights, out), Words(encoder(tokenizer_path), sent, end_id, n_docs)
        names = ["doc_id", "held_out", "n", "hits", "base", "score", "tail", "own", "ids"]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = split_words(part.column(1))
                learnt = ~part.column(2).to_numpy(zero_copy_only=False)
                where, doc = words.places(texts)
                ids, length = words.ids_of(where)
                n = np.bincount(doc, minlength=len(texts))
                each = scorer.scores(ids, np.bincount(doc, weights=length, minlength=len(texts)).astype(np.int64))
                ends, sums = np.cumsum(length), np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
                by_ids = sums[ends] - sums[ends - length]
                _, same, often = np.unique(doc * len(words.names) + where, return_inverse=True, return_counts=True)
                own = np.where(learnt[doc], often[same], 0)
                times, left = words.times[where], tokens - np.where(learnt, n, 0)
                rare = np.isnan(times)
                common = ~rare
                score = np.zeros(len(where))
                score[common] = with_memory(by_ids[common], times[common] - own[common], left[doc[common]])
                cuts = np.searchsorted(doc[rare], np.arange(len(texts) + 1)).astype(np.int32)
                per_text = lambda values, doc=doc, k=len(texts): np.bincount(doc, weights=values, minlength=k)
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n),
                        pa.array(n - per_text(rare).astype(np.int64) - (n_docs == 0)),
                        pa.array(per_text(np.where(rare, 0.0, np.log10(np.where(rare, 1.0, times) + 0.5)))),
                        pa.array(per_text(score) / LN10),
                        pa.ListArray.from_arrays(cuts, pa.array([word_key(words.names[i]) for i in where[rare].tolist()], pa.binary())),
                        pa.ListArray.from_arrays(cuts, pa.array(own[rare].astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(by_ids[rare].astype(np.float32))),
                    ],
                    names=names,
                )
        del words, scorer
        release()

    schema = "doc_id long, held_out boolean, n long, hits long, base double, score double, tail array<binary>, own array<int>, ids array<float>"
    # the number is stored with the row: reading the table again may deal it out differently
    scored = space.save(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    left = F.lit(tokens) - F.when(F.col("held_out"), 0).otherwise(F.col("n"))
    rest = scored.select("row", left.alias("left"), F.explode(F.arrays_zip("tail", "own", "ids")).alias("t")).select("row", "left", F.col("t.tail").alias("key"), "t.own", "t.ids")
    c = F.coalesce(F.col("c"), F.lit(0))
    by_ids = F.col("ids").cast("double") / LN10 + math.log10(1 - MEMORY)
    seen = F.log10(F.lit(MEMORY) * (c - F.col("own")) / F.greatest(F.col("left"), F.lit(1)))
    mixed = F.when(c > F.col("own"), F.greatest(by_ids, seen) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(by_ids - seen)))).otherwise(by_ids)
    met = rest.join(words, "key", "left").groupBy("row").agg(
        F.count("c").alias("more"), F.sum(F.log10(c + 0.5)).alias("rest"), F.sum(mixed).alias("mixed")
    )  # words beyond the most frequent ones: none is a large share of the rows
    return scored.drop("tail", "own", "ids").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n") * F.lit(bottom)).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
