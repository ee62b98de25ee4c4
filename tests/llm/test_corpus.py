"""Model scores, archives, mixing, the similarity join and the pipeline against plain versions."""

import base64
import collections
import hashlib
import inspect
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import attention_lm as lm, components, jaccard_join, mixing, warc
from brindle.llm.shingles import shingle_sets
from brindle.llm.workspace import Workspace

from .conftest import SCHEMA, prose, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- scores --------------------------------------------------------------------------------------


def small_model(vocab=9, classes=3, dim=4, context=6, seed=0):
    r = np.random.default_rng(seed)
    out, bias, lean = lm.leaves(r.integers(0, 50, vocab), np.arange(vocab) % classes, classes)
    p = lm.new_parameters(vocab, bias, lean, dim, context)
    return {k: v + 0.3 * r.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}, out


def test_leaves_say_the_counts():
    counts = np.array([5, 0, 100, 7, 1, 30, 2, 9, 4, 4, 0, 12])
    out, bias, lean = lm.leaves(counts, np.array([0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3]), 4)
    p = lm.new_parameters(len(counts), bias, lean, 4, 6)
    own = np.exp(lm.id_scores(p, out, np.zeros((12, 4), np.float32), np.arange(12)))
    assert own.sum() == pytest.approx(1, abs=1e-5) and own == pytest.approx((counts + 0.01) / (counts + 0.01).sum(), abs=1e-5)


def test_probabilities_sum_to_one():
    p, out = small_model()
    h = np.random.default_rng(1).standard_normal((5, 4)).astype(np.float32)
    for row in h:
        assert np.exp(lm.id_scores(p, out, np.repeat(row[None], 9, axis=0), np.arange(9))).sum() == pytest.approx(1, abs=1e-5)


def test_gradients():
    r = np.random.default_rng(0)
    p, out = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    inputs, targets, weight = r.integers(0, 10, (3, 6)), r.integers(0, 9, (3, 6)), r.integers(0, 2, (3, 6)).astype(bool)
    _, d = lm.gradients(p, out, inputs, targets, weight)
    for name in p:
        full = np.zeros_like(p[name])
        if name in lm.ROWS:
            full[d[name][0]] = d[name][1]
        else:
            full = d[name]
        flat = p[name].ravel()
        for j in range(0, len(flat), max(1, len(flat) // 6)):
            old = flat[j]
            flat[j] = old + 1e-5
            up = lm.gradients(p, out, inputs, targets, weight)[0]
            flat[j] = old - 1e-5
            down = lm.gradients(p, out, inputs, targets, weight)[0]
            flat[j] = old
            assert (up - down) / 2e-5 == pytest.approx(full.ravel()[j], abs=1e-4), name


def plain_scores(p, out, text, context, stride):
    """Log-probability of each id of a text, from windows of its own."""
    vocab, scores = len(out.group), []
    for t, target in enumerate(text):
        first = t // stride * stride - (context - stride)  # where the window that counts this place begins
        inputs = np.array([[vocab if i == 0 else text[i - 1] for i in range(max(0, first), t + 1)]])
        h, _ = lm.forward(p, inputs)
        scores.append(lm.id_scores(p, out, h[-1:], np.array([target]))[0])
    return scores


@pytest.mark.parametrize("stride", [6, 5, 3, 1])
def test_each_id_once(stride):
    r = np.random.default_rng(1)
    p, out = small_model()
    texts = [r.integers(0, 9, n) for n in (1, 0, 5, 6, 7, 40, 100, 5, 0)]
    got = lm.Scorer(p, out, stride, batch=3).scores(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert got == pytest.approx(np.concatenate([plain_scores(p, out, t, 6, stride) for t in texts if len(t)]), abs=1e-3)


def test_training_learns():
    r = np.random.default_rng(2)
    rows = np.array([[9, *[(s + i * 3) % 8 for i in range(12)]] for s in r.integers(0, 8, 400)])
    out, bias, lean = lm.leaves(np.bincount(rows[:, 1:].ravel(), minlength=9), np.arange(9) % 3, 3)
    p = lm.new_parameters(9, bias, lean, 16, 12)
    _, losses = lm.fit(p, out, rows, batch=16, passes=12)
    assert losses[0] > 1.8 and np.mean(losses[-10:]) < 0.3


def test_steps_keep_their_memory():
    """A worker that trains doesn't give arrays back to the system at each step, whose pages it would fault in again."""
    code = """
import resource
import numpy as np
from brindle.llm import attention_lm as lm, workers
rows = np.random.default_rng(0).integers(0, 3000, (1280, 33))
out, bias, lean = lm.leaves(np.bincount(rows.ravel(), minlength=3000), np.arange(3000) % 48, 48)
p = lm.new_parameters(3000, bias, lean)
getattr(workers, "keep", int)()
lm.fit(p, out, rows[:640])
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
lm.fit(p, out, rows)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 20)
"""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True, timeout=120)
    assert float(ran.stdout) < 150


@pytest.mark.parametrize("far", [200, -200])
def test_gradients_of_far_off_weights(far):
    """What is added to all weights of a softmax changes nothing, however much it is."""
    r = np.random.default_rng(3)
    p, out = small_model()
    inputs, targets = r.integers(0, 10, (3, 6)), r.integers(0, 9, (3, 6))
    moved = p | {"near": p["near"] + np.float32(far), "bias": p["bias"] + np.float32(far)}
    (a, d), (b, e) = (lm.gradients(x, out, inputs, targets, np.ones((3, 6), bool)) for x in (p, moved))
    assert a == pytest.approx(b, abs=1e-4)
    assert all(np.allclose(d[k][1] if k in lm.ROWS else d[k], e[k][1] if k in lm.ROWS else e[k], atol=1e-4) for k in d)


def test_words_are_encoded_once_for_all_tasks(monkeypatch):
    coder, asked = lm.encoder(PATH), []
    coder.words.clear()
    plain = type(coder.words).fresh
    monkeypatch.setattr(type(coder.words), "fresh", lambda self, word: asked.append(word) or plain(self, word))
    for _ in range(2):
        words = lm.Words(coder, {}, 49407, 0)
        where, _ = words.places([[b"kept", b"words,", b"kept", b"w" * 99]])
        want = [*np.frombuffer(b"".join(plain(coder.words, w) for w in ("kept", "words,", "kept", "w" * 99)), "<u4"), 49407]
        assert words.ids_of(where)[0].tolist() == want
    assert asked == ["kept", "words,", "w" * 99, "w" * 99]  # long ones aren't kept


def test_windows_hold_a_texts_words():
    coder = lm.encoder(PATH)
    ids = lambda t: np.frombuffer(coder.encode(t), "<u4").tolist()
    text = " ".join(f"word{i} and the cat" for i in range(100))
    drawn = list(lm.drawn_windows(text.encode().split(), 20))
    assert len(drawn) == 20 and drawn == list(lm.drawn_windows(text.encode().split(), 20))
    whole = [lm.encoder(PATH).vocab_size, *ids(text), 49407]
    for w in drawn:
        row = lm.window_ids(w, coder, whole[0], 49407).tolist()
        assert len(row) == lm.CONTEXT + 1
        full = [x for x in row if x >= 0]
        assert any(whole[i : i + len(full)] == full for i in range(len(whole)))
        assert len(full) == len(row) or full[-1] == 49407
    assert lm.window_ids(b"^one $", coder, 5, 6).tolist()[:3] == [5, *ids("one"), 6]


def test_windows_of_huge_words():
    coder = lm.encoder(PATH)
    text = ["a", "x1y2" * 3000, "the", "é" * 5000, "cat"]
    drawn = list(lm.drawn_windows(" ".join(text * 20).encode().split(), 2))
    assert len(drawn) == 50 and max(map(len, drawn)) < lm.WINDOW_BYTES + lm.BEFORE_BYTES + lm.WINDOW_WORDS + 4
    for w in drawn:  # none is left out, and each is filled unless it reaches the text's end
        row = lm.window_ids(w, coder, 0, 49407)
        assert len(row) == lm.CONTEXT + 1 and ((row >= 0).all() or w.endswith(b" $"))


def test_every_id_of_every_text_is_trained_on(spark):
    """Windows of the default hold all ids, ends included, of long, short and blank texts; each behind the id before it."""
    coder = lm.encoder(PATH)
    texts = ["One two three.", "word " * 500 + "LAST", None, "", "straße " + "x" * 300, " ".join(f"w{i}" for i in range(700))]
    ids = lambda t: [i for w in lm.split_words(pa.array([t]))[0] for i in np.frombuffer(coder.words.fresh(w.decode()), "<u4").tolist()]
    want = []
    for t in texts:
        whole = [7, *ids(t), 49407]
        want += [tuple(whole[i : i + lm.CONTEXT + 1] + [-1] * (lm.CONTEXT + 1 - len(whole[i : i + lm.CONTEXT + 1]))) for i in range(0, len(whole) - 1, lm.CONTEXT)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = [tuple(np.frombuffer(r["ids"], "<i4").tolist()) for r in lm.all_windows(rows, PATH, 7, 49407).collect()]
    assert sorted(got) == sorted(want)
    assert inspect.signature(lm.score_documents).parameters["window_every"].default is None


def test_training_leaves_no_shuffle_files(spark, monkeypatch):
    """Each round shuffles its windows: their files go with the round, and the windows with the training."""
    folders = [f.toString() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    kept = lambda: {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}
    plain_train, found = lm.train, {}

    def train(spark, windows, counts):
        before, out = kept(), plain_train(spark, windows, counts)
        for _ in range(50):  # they go in the background
            if kept() <= before:
                break
            time.sleep(0.2)
        found["left"], found["windows"] = kept() - before, windows
        return out

    monkeypatch.setattr(lm, "train", train)
    docs = table(spark, [(i, f"one two t{i} " * 50, "en", "s") for i in range(20)])
    assert lm.score_documents(spark, docs, PATH).count() == 20
    assert not found["left"]
    with pytest.raises(Exception, match="(?i)not.?exist|no such"):
        found["windows"].count()


def test_windows_are_as_dense_at_every_size(spark):
    line = " ".join(f"w{i % 37} q{i % 11} z{i % 5}" for i in range(700))
    for n in (20, 200):
        docs = table(spark, [(i, f"t{i} {line}", "en", "s") for i in range(n)])
        drawn = lm.count_words(docs, PATH, 100).filter(F.substring("key", 1, 2) == F.lit(lm.WINDOW)).agg(F.sum("c")).first()[0]
        assert drawn == pytest.approx(n * 21.01, abs=n * 0.2)


def test_scores_do_not_hang_on_the_layout(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "the", "run") for b in ("", "s", "ta", "ning", "er")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)), "en", "s") for i in range(80)]
    plain_train = lm.train
    monkeypatch.setattr(lm, "train", lambda spark, windows, counts: plain_train(spark, windows, counts, task_windows=60))
    docs = table(spark, rows)
    runs = [{r["doc_id"]: r["score"] for r in lm.score_documents(spark, d, PATH, window_every=16).collect()} for d in (docs.coalesce(1), docs.orderBy(F.xxhash64("doc_id")).repartition(7))]
    assert all(runs[0][i] == pytest.approx(runs[1][i], rel=1e-4) for i in runs[0])
    # training tells more than the counts: held-out texts score higher than untrained
    monkeypatch.setattr(lm, "train", lambda spark, windows, counts: plain_train(spark, windows, counts, rounds=0))
    flat = {r["doc_id"]: r["score"] for r in lm.score_documents(spark, docs, PATH, window_every=16).collect()}
    held = [i for i in flat if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(runs[0][i] for i in held) > sum(flat[i] for i in held)


def test_scores(spark, messy, messy_docs, empty_docs, monkeypatch):
    fitted = {}

    def train(spark, windows, counts, **more):
        fitted["counts"] = counts
        fitted["model"] = plain_train(spark, windows, counts, task_windows=100, **more)
        return fitted["model"]

    plain_train = lm.train
    monkeypatch.setattr(lm, "train", train)
    got = collections.defaultdict(list)
    for r in lm.score_documents(spark, messy_docs, PATH, head_words=50, window_every=16).collect():
        got[r["doc_id"]].append(r)
    p, out = fitted["model"]
    coder = lm.encoder(PATH)
    ids = lambda w: np.frombuffer(coder.words.fresh(w), "<u4").tolist()
    learn = [t for i, t, *_ in messy if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in learn for w in words(t))
    by_id = collections.Counter(x for w, n in counts.items() for x in ids(w) * n)
    by_id[49407] += len(learn)
    assert {i: int(n) for i, n in enumerate(fitted["counts"]) if n} == dict(by_id)
    total, distinct = counts.total() + len(learn), len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    for i, t, *_ in messy:
        own = words(t)
        held = i is None or zlib.crc32(str(i).encode()) % 5 == 1
        want = (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, total, held)
        hit = [r for r in got[i] if (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == want]
        assert hit and any(r["base_score"] == pytest.approx(sum(base(counts[w]) for w in own) + base(len(learn))) for r in hit)
        if len(own) > 400:
            continue
        each = [ids(w) for w in own] + [[49407]]
        flat, at, score, mine = plain_scores(p, out, [x for e in each for x in e], lm.CONTEXT, lm.STRIDE), 0, 0.0, collections.Counter(own)
        for w, e in zip([*own, None], each, strict=True):
            by_ids, at = sum(flat[at : at + len(e)]), at + len(e)
            others = (len(learn) if w is None else counts[w]) - (0 if held else 1 if w is None else mine[w])
            score += math.log10((1 - lm.MEMORY) * math.exp(by_ids) + lm.MEMORY * others / (total - (0 if held else len(own) + 1)))
        assert any(r["score"] == pytest.approx(score, rel=1e-3, abs=1e-2) for r in hit), i
    assert sum(map(len, got.values())) == len(messy)
    same = [r["score"] for i in (106, 107) for r in got[i] if r["held_out"] == got[106][0]["held_out"]]
    assert max(same) - min(same) < 1e-3  # equal texts score alike
    assert lm.score_documents(spark, empty_docs, PATH).collect() == []
    nothing = lm.score_documents(spark, messy_docs.filter("doc_id is null"), PATH).collect()
    assert len(nothing) == 2 and all((r["train_tokens"], r["n_known"]) == (0, 0) and r["score"] < 0 for r in nothing)


def test_all_training_words_count(spark):
    rows = [(i, f"word{i} and the cat", "en", "s") for i in range(40)]
    last = max(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1)
    asked = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)

    def score(end):
        docs = [(i, t + (" the cat" * 4000 + end if i == last else ""), lang, s) for i, t, lang, s in rows] + [(asked, "a zebra quagga", "en", "s")]
        return {r["doc_id"]: r["score"] for r in lm.score_documents(spark, table(spark, docs), PATH, window_every=16).collect()}[asked]

    assert score(" zebra quagga") > score(" horse donkey") + 1


def test_long_words_are_counted_by_digest(spark):
    long = "x1y2" * 40
    rows = [(i, f"{long} {long.upper()} a", "en", "s") for i in range(30)]
    got = lm.score_documents(spark, table(spark, rows), PATH, window_every=16).collect()
    assert all((r["n_tokens"], r["n_known"]) == (4, 4) for r in got) and {r["train_tokens"] for r in got} == {4 * sum(not r["held_out"] for r in got)}
    total = got[0]["train_tokens"]
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * 4))
    n = total // 4
    assert all(r["base_score"] == pytest.approx(2 * p(2 * n) + p(n) + p(n)) for r in got)


# ---- archives ------------------------------------------------------------------------------------


def test_archive(spark):
    pages = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (7, "http://c", ""), (8, "http://d", "x" * 300_000), (None, "http://e", "<p>é</p>"), (9, "http://f", "one"), (9, "http://f", "one")]
    df = spark.createDataFrame([(*p, "clash", 0) for p in pages], "page_id long, url string, html string, address string, bytes int").repartition(3)
    rows = warc.read_archive(spark, warc.write_archive(spark, df)).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in rows:
        raw = next((h or "").encode() for i, u, h in pages if i == r["page_id"] and (i is not None or u == "http://e"))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        own = first[raw.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == r["page_id"] else ("revisit", own))
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest.endswith(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
        assert len(rest) == length + 4
        if r["record_type"] == "response":
            assert rest[:-4].endswith(raw)
        assert b"X: y" not in [line for line in head.split(b"\r\n")]


def test_archive_least_size(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, warc.write_archive(spark, df, min_bytes=3)).collect()}
    assert rows == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_archive_payloads_once_and_verified(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "same") for i in range(50)], "page_id long, url string, html string")
    path = warc.write_archive(spark, df)
    assert spark.read.parquet(f"{path}/payloads").count() == 1
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("other")).write.parquet(f"{tmp_path}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/headers")
    with pytest.raises(Exception, match="differs from its address"):
        warc.read_archive(spark, str(tmp_path)).collect()
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{path}/headers").withColumn("head", F.regexp_replace("head", "sha1:.", "sha1:_")).write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="a header differs from its payload"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(spark, empty)).collect() == []


# ---- mixing --------------------------------------------------------------------------------------


def sources(spark, tokens):
    return spark.createDataFrame(list(tokens.items()), "source string, tokens long")


def test_weights_by_entropy(spark):
    tokens = {"a": 1000, "b": 300, "c": 20, "d": 5}
    for share in (0.5, 0.8, 0.95):
        rows, power = mixing.weights(sources(spark, tokens), target_entropy=share, max_repeats=None)
        w = [r["weight"] for r in rows.collect()]
        assert sum(w) == pytest.approx(1)
        have = -sum(x * math.log(x) for x in w) / math.log(4)
        own = -sum(x * math.log(x) for x in (t / 1325 for t in tokens.values())) / math.log(4)
        assert have == pytest.approx(max(share, own), abs=1e-4) and 0 <= power <= 1


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0, 1000.0])
def test_weights_by_repeats(spark, limit):
    tokens = {"a": 1000, "b": 300, "c": 20, "d": 5}
    rows = {r["source"]: r for r in mixing.weights(sources(spark, tokens), max_repeats=limit)[0].collect()}
    times = {s: r["budget"] / r["tokens"] for s, r in rows.items()}
    assert times["a"] == pytest.approx(1) and max(times.values()) == pytest.approx(min(limit, 200), rel=1e-4)
    fixed = {r["source"]: r for r in mixing.weights(sources(spark, tokens), max_repeats=limit, budget_tokens=900)[0].collect()}
    assert sum(r["budget"] for r in fixed.values()) == pytest.approx(900)
    with pytest.raises(ValueError):
        mixing.weights(sources(spark, tokens), max_repeats=2.0, target_entropy=0.5)


def test_mixture(spark, messy, messy_docs, empty_docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 30), "en", "big" if i < 600 else f"small{i % 4}") for i in range(800)]
    docs = table(spark, rows)
    got = mixing.mix(docs, max_repeats=2.0).collect()
    size = {i: len(words(t)) + 1 for i, t, *_ in rows}
    times = collections.Counter(r["doc_id"] for r in got)
    assert set(times) == set(size) and max(times.values()) <= 2  # all once, none more than twice
    own, mixed = collections.Counter(), collections.Counter()
    for i, _, _, s in rows:
        own[s] += size[i]
    for r in got:
        assert r["n_tokens"] == size[r["doc_id"]] and 0 <= r["position"] <= 1
        mixed[r["source"]] += size[r["doc_id"]]
    want = {r["source"]: r["budget"] for r in mixing.weights(sources(spark, own), max_repeats=2.0)[0].collect()}
    for s, n in mixed.items():
        assert abs(n - want[s]) <= own[s] / 16
    # each pass is a permutation of its own, the same on every run
    order = lambda rs, e: [r["block"] for r in sorted((r for r in rs if r["source"] == "small0" and r["epoch"] == e), key=lambda r: r["position"])]
    assert list(dict.fromkeys(order(got, 0))) != list(dict.fromkeys(order(got, 1)))
    assert sorted((r["doc_id"], r["epoch"], r["position"]) for r in got) == sorted((r["doc_id"], r["epoch"], r["position"]) for r in mixing.mix(docs, max_repeats=2.0).collect())
    all_ = mixing.mix(messy_docs).collect()
    assert collections.Counter(r["doc_id"] for r in all_) >= collections.Counter(i for i, *_ in messy)
    assert mixing.mix(empty_docs).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(messy_docs, keep=["block"])


# ---- similarity join -----------------------------------------------------------------------------


def plain_shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain_components(rows, size, num, den):
    """Least id reachable, by comparing all rows; rows of one id are one document."""
    sets, root = [(i, plain_shingles(t, size)) for i, t, *_ in rows], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


def copies(rng, n):
    """Documents with exact copies, chains of near copies, common passages and short texts."""
    passage = prose(rng, "en", 60)
    rows, i = [], 0
    while len(rows) < n:
        base = prose(rng, rng.choice(["en", "de"]), rng.randint(3, 160)).split()
        if rng.random() < 0.3:
            base = passage.split() + base[:80]
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            rows.append((i, " ".join(base) if rng.random() < 0.9 else " ".join(base).upper(), "en", "s"))
            i += rng.randint(1, 3)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = prose(rng, "fr", 1).strip() or "x"
    rng.shuffle(rows)
    return rows


def joined(spark, docs, **options):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(spark, docs, **options).collect()), key=key)


@pytest.mark.parametrize(("seed", "options"), [(1, {"size": 4, "num": 85}), (2, {"size": 5, "num": 80}), (3, {"size": 2, "num": 60, "group_members": 3, "group_askers": 2}), (4, {"size": 4, "num": 85, "common_rows": 2, "frequent_tokens": 40, "send_rows": 0}), (5, {"size": 4, "num": 85, "hot_rows": 3, "part_shingles": 200})])
def test_join(spark, seed, options):
    rows = copies(random.Random(seed), 220)
    want = sorted(plain_components(rows, options["size"], options["num"], 100))
    assert len({c for *_, c in want}) < len(want) - 20
    assert joined(spark, table(spark, rows), **options) == want


def test_join_edges(spark, messy, messy_docs, empty_docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = joined(spark, messy_docs, size=4, num=85)
    assert [r for r in got if r[0] is not None] == sorted([r for r in plain_components(messy, 4, 85, 100) if r[0] is not None], key=key)
    assert len(got) == len(messy)
    assert jaccard_join.link_documents(spark, empty_docs).collect() == []
    edge = [(1, "a b c d e f g h i j", "", ""), (2, "a b c d e f g h i j x", "", ""), (3, "A B", "", ""), (4, "a  b\n", "", ""), (5, "b a", "", "")]
    for num in (87, 88, 100):  # 7 of 8 shingles are common
        assert joined(spark, table(spark, edge), size=4, num=num) == sorted(plain_components(edge, 4, num, 100))


def test_frequent_shingles_and_texts_of_the_join(spark):
    """Entries of hot shingles are those of the matrix without hot ones; a text that half of the rows hold is one class."""
    rng = random.Random(6)
    prefixes = [sorted(rng.sample(range(40), rng.randint(1, 12))) + rng.sample(range(100, 10**6), 5) for _ in range(300)]
    rows = [(i, rng.randint(20, 30), i % 17, p) for i, p in enumerate(prefixes)]
    groups = spark.createDataFrame(rows, "node long, n long, gid long, prefix array<long>").repartition(3)
    counts = collections.Counter(t for p in prefixes for t in p)
    spreads = {r["token"]: r["count"] for r in jaccard_join._spreads(groups.select("prefix"), 7, 2).collect()}
    assert spreads == {t: c for t, c in counts.items() if c >= 2}
    none, hot = (spark.sparkContext.broadcast(np.array(t, np.int64)) for t in ([], sorted(t for t, c in counts.items() if c >= 60)))
    assert 0 < len(hot.value) < 40
    whole = jaccard_join._matrix(groups, 7, none, 80, 100)
    parts = jaccard_join._matrix(groups, 7, hot, 80, 100).union(jaccard_join._hot_entries(groups, hot, 80, 100))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert jaccard_join._parts_of(spark, 10**12, 2_000_000) == 500_000

    texts = [(i, "one text of many rows and of no other place" if i % 2 else prose(rng, "en", 30), "en", "s") for i in range(200)]
    for send_rows in (0, 500_000):
        got = joined(spark, table(spark, texts), size=4, num=85, send_rows=send_rows, hot_rows=20)
        assert got == sorted(plain_components(texts, 4, 85, 100))


def test_near_copies_cost_a_comparison_each(spark, monkeypatch):
    compared, plain_links = [], jaccard_join._links

    def links(work, *options):
        compared.append(work.count())
        return plain_links(work, *options)

    monkeypatch.setattr(jaccard_join, "_links", links)
    rng, took = random.Random(1), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for n in (300, 900):
        rows = []
        for i in range(n):
            own = list(base)
            if i % 3:  # a word of its own: any two of them link
                own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(own), "en", "s"))
        compared.clear()
        found = jaccard_join.link_documents(spark, table(spark, rows), size=4, num=85, group_members=10, group_askers=20).collect()
        assert {r["component_id"] for r in found} == {0}
        took.append(sum(compared))
    assert took[1] < 5 * took[0]  # all pairs of groups would be 9 times as many


def test_shingles_of_long_texts(monkeypatch):
    import pyarrow as pa

    from brindle.llm import shingles

    rng = random.Random(7)
    texts = [prose(rng, "en", n) for n in (5, 3000, 1, 400)] + [None, "", "x" * 5000, " a b ", "a" * 3000 + " " + "b" * 3000]
    whole = shingle_sets(pa.array(texts), 3)
    assert [len(s) for s in whole] == [len(plain_shingles(t, 3)) for t in texts]
    monkeypatch.setattr(shingles, "SLICE_BYTES", 1000)
    assert [s.tolist() for s in shingle_sets(pa.array(texts), 3)] == [s.tolist() for s in whole]
    assert [s.tolist() for s in shingle_sets(pa.array(["pad", *texts]).slice(1), 3)] == [s.tolist() for s in whole]


def jobs_of(spark, group, run):
    """How many jobs Spark runs for a call."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counting_stored_tables_costs_no_jobs(spark):
    """A driver keeps what it knows of jobs: numbers of rows, and whether a turn of the stars changed a link, come with the writing."""
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(i, i - 1) for i in range(2, 40, 2)], "a long, b long")
    found, stars = jobs_of(spark, "stars", lambda: components.components(links, Workspace(spark, "jobs"), "jobs"))
    assert {r["node"]: r["root"] for r in found.collect()} == {i: 0 for i in range(1, 40)}
    texts = table(spark, [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + " end" * (i % 3), "en", "s") for i in range(30)])
    found, joins = jobs_of(spark, "joins", lambda: jaccard_join.link_documents(spark, texts, size=4, num=80))
    assert {r["component_id"] for r in found.collect()} == set(range(0, 30, 3))
    assert stars <= 60 and joins <= 100  # 74 and 146 when each number was a job


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(500, 500)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {n: find(n) for n in root if find(n) != n} == found


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = copies(rng, 150)
    rows = [(i, t, "en" if rng.random() < 0.5 else None, f"s{i % 3}") for i, t, *_ in rows] + [(5000, "12 34", "en", "s0"), (5001, None, "en", "s0"), (5002, "token = k9Xv27QpLm48ZtRw " + prose(rng, "en", 60), "en", "s1")]
    rows += [(6000 + i, prose(rng, "de", 50), "de", "s9") for i in range(30)]
    docs = table(spark, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "source_mixture", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        kept[name] = docs.collect()
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    ids = {name: {r["doc_id"] for r in got} for name, got in kept.items()}
    assert not ids["language_id"] & {5000, 5001}
    assert len(ids["language_id"]) > 0.9 * len(rows)
    left = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    assert ids["near_duplicates"] == {c for *_, c in plain_components(left, 5, 80, 100)}
    assert ids["secrets"] == ids["near_duplicates"] == ids["source_mixture"]
    clean = {r["doc_id"]: r for r in kept["secrets"]}
    assert clean[5002]["text"].startswith("[SECRET] ") and clean[5002]["n_chars"] == len(clean[5002]["text"])
    assert max(collections.Counter(r["doc_id"] for r in kept["source_mixture"]).values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == ids["source_mixture"]
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
