"""Decontamination, spelling variants and source divergence against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontamination, divergence, spelling

from .conftest import prose, table

# ---- decontamination -----------------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_report(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = plain_words(text)
        n = min(size, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[i : i + n])].add(item)
    out = []
    for doc, text in rows:
        ws, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        named = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    made = [(i, prose(rng, "en", rng.randint(12, 40))) for i in range(12)]
    # the same passage in two items, short items, an empty one, nulls, a repeated row
    return [*made, (20, made[0][1] + " and more"), (21, "Zwölf kurze Worte"), (22, "einzig2"), (23, "..."), (24, None), (None, "ten words of an item without an id are one window"), made[5]]


@pytest.fixture(scope="module")
def leaky(items, messy):
    rng = random.Random(4)
    quote = lambda i, a, b: " ".join(plain_words(items[i][1])[a:b])
    own = [
        (300, prose(rng, "en", 40) + " " + items[0][1].upper() + " " + prose(rng, "en", 40)),
        (301, quote(1, 0, 9)),  # one word less than a window
        (302, quote(1, 0, 10) + "! " + quote(2, 1, 12)),
        (303, "\n".join(["zwölf, KURZE worte"] * 3)),
        (304, "einzig2 einzig20 xeinzig2"),
        (305, quote(3, 0, 12) + " " + quote(3, 0, 12)),
        (305, quote(3, 0, 12) + " " + quote(3, 0, 12)),
        (None, "so: ten words of an item without an id are one window"),
        (306, "x " * 60_000 + quote(4, 0, 11)),
    ]
    return [(i, t, "en", "s0") for i, t in own] + messy


def test_decontamination_report(spark, leaky, items):
    docs, bench = table(spark, leaky), spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1)).withColumn("doc_id", F.lit(2))
    found = decontamination.find(docs, bench)
    want = plain_report([(i, t) for i, t, _, _ in leaky], items)
    assert sorted((tuple(r) for r in decontamination.report(found).collect()), key=str) == want
    # blocks of the windows change the work only
    small = decontamination.find(docs, bench, send_bytes=20_000)
    assert sorted((tuple(r) for r in decontamination.report(small).collect()), key=str) == want


def test_decontamination_empty(spark, empty_docs, leaky, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.report(decontamination.find(empty_docs, bench)).count() == 0
    clean = decontamination.report(decontamination.find(table(spark, leaky), bench.limit(0)))
    assert clean.count() == len(leaky) and clean.filter("contaminated").count() == 0


def test_decontamination_remove(spark, leaky, items):
    docs, bench = table(spark, leaky), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find(docs, bench)
    bad = {(r["doc_id"], r["text_hash"]) for r in found.collect() if r["spans"]}
    key = lambda i, t: (i, hashlib.md5((t or "").encode()).hexdigest())
    kept = decontamination.remove(docs, found, how="documents")
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((i, t) for i, t, _, _ in leaky if key(i, t) not in bad)
    cut = decontamination.remove(docs, found)
    rows = cut.collect()
    assert len(rows) == len(leaky) and cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[303] == "" and texts[304] == "einzig20 xeinzig2" and texts[306] == "x " * 60_000
    untouched = Counter((i, t) for i, t, _, _ in leaky if key(i, t) not in bad)
    assert not untouched - Counter((r["doc_id"], r["text"]) for r in rows)
    # what is left holds no window but those that meet over a cut
    assert decontamination.report(decontamination.find(cut, bench)).filter("contaminated").count() <= 1
    with pytest.raises(ValueError):
        decontamination.remove(docs, found, how="words")


# ---- spelling ------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, drop_every=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, forms = {}, {}
    for w, n in known.items():
        near = sorted((-known[x], x) for x in known if x != w and one_apart(w, x))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        forms[w] = form
        out[w] = (form, n, len(near), known[form] if form else None)
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, form, root, n, n_near, form_n)
    return sorted(out.values())


def variants_of(rng, word):
    alphabet = "abcdeéøßÿ"
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(alphabet) + word[i:], word[:i] + rng.choice(alphabet) + word[i + 1 :]])


@pytest.fixture(scope="module")
def misspelt(messy):
    rng = random.Random(8)
    words = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "abcabc": 7, "bcabca": 7, "abacbc": 40, "aßéøab": 6, "aßéøaba": 31, "tietie": 5, "tietia": 25, "tietib": 25, "xietie": 4}
    for _ in range(60):
        base = "".join(rng.choice("abcdeéøßÿ") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 6, 30, 150])
        for _ in range(6):
            base = variants_of(rng, base)
            words.setdefault(base, rng.choice([4, 5, 9, 25, 130]))
    bag = [w if rng.random() < 0.8 else w.upper().replace("SS", "ß") if w.isascii() else w for w, n in words.items() for _ in range(n)]
    rng.shuffle(bag)
    docs = [(i, " ".join(bag[i::40]) + rng.choice(["", ".", "\n"])) for i in range(40)]
    docs += [(None, "aaaaaaa, aaaaaa"), (90, None), (91, ""), (92, "ab" * 200_000 + " " + "ab" * 200_000)]
    return [(i, t, "en", "s0") for i, t in docs] + messy


def test_spelling(spark, misspelt):
    want = plain_variants([(i, t) for i, t, _, _ in misspelt])
    got = sorted(tuple(r) for r in spelling.group_variants(table(spark, misspelt)).collect())
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)  # forms, and chains of them


def test_spelling_of_long_words(spark):
    """Words of many letters, and permutations of the same letters that aren't near."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    same = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 400)]
    rows = [(i, f"{long} {long[:777]}{long[778:]} " + " ".join(same), "en", "s") for i in range(5)]
    want = plain_variants([(i, t) for i, t, _, _ in rows])
    assert sorted(tuple(r) for r in spelling.group_variants(table(spark, rows)).collect()) == want


def test_spelling_empty(spark, empty_docs):
    assert spelling.group_variants(empty_docs).count() == 0
    assert spelling.group_variants(table(spark, [(1, "rarely seen", "en", "s")])).count() == 0


def test_letter_values_have_no_equal_differences():
    points = [*range(97, 123), *range(0xC0, 0x100)]
    differences = Counter(a**5 - b**5 for a, b in itertools.permutations(points, 2))
    assert max(differences.values()) == 1


# ---- divergence ----------------------------------------------------------------------------------


def plain_audit(rows, min_docs=10, top=10):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    far = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        sources = [s for a, s in counts if a == lang]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        p = {s: [share(counts[lang, s][t], n[s], len(kept)) for t in kept] for s in sources}
        q = [share(whole[t], sum(n.values()), len(kept)) for t in kept]
        for s in sources:
            pairs = [(-sum(map(far, p[s], p[o])), o) for o in sources if o != s]
            terms = [(-far(a, b), t) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(messy):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang := rng.choice(["en", "fr"]), rng.randint(5, 80)), lang, rng.choice(["a", "b", "é", "😀", "a"])) for i in range(150)]
    rows += [(500 + i, "Équal tied tied équal Ω Z", "xx", s) for i, s in enumerate("abc" * 4)]  # all alike: ties
    rows += [(600, None, "en", "none"), (601, "", "yy", "1"), (602, None, "yy", None), (603, "9 8", None, None), (604, "word", None, "w")]
    return rows + messy


def test_divergence(spark, sourced):
    rows = [(t, lang, s) for _, t, lang, s in sourced]
    want = plain_audit(rows)
    docs = table(spark, sourced, 5).withColumn("item", F.lit("x")).withColumn("n", F.lit(1))
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want
    # the size of chunks, and how groups reach the tasks, change the work only
    assert sorted(tuple(r) for r in divergence.audit(docs, chunk_rows=40, send_groups=2).collect()) == want


def test_divergence_in_small_pieces(spark, sourced, monkeypatch):
    want = plain_audit([(t, lang, s) for _, t, lang, s in sourced], min_docs=3, top=4)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    raw = ("Wort, für 😀 " * 50 + "x" * 300).encode()
    assert [t for p in divergence._pieces(raw) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(raw)
    assert sorted(tuple(r) for r in divergence.audit(table(spark, sourced), min_docs=3, top=4).collect()) == want


def test_divergence_empty(spark, empty_docs):
    assert divergence.audit(empty_docs).count() == 0
    alone = divergence.audit(table(spark, [(1, "a b", "en", "s"), (2, "c", "en", "t")]))
    assert sorted(tuple(r) for r in alone.collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact():
    counts = np.array([0, 7, 9_300_000_000, 10**15], np.int64)
    assert divergence.scaled(counts, 10**15 + 11).tolist() == [1 + 10**9 * (int(c) + 2) // (10**15 + 11) for c in counts]


def test_dense_chunks_count_large_numbers():
    terms, sources = np.array([b"a", b"a", b"b"], object), np.array(["x", "y", "x"], object)
    made = list(divergence.dense_chunks("l", terms, sources, np.array([1 << 60, 3, 5]), np.array([9, 1, 10]), 10, cells=2))
    assert [(m[1], m[2], m[3]) for m in made] == [([b"a"], ["x", "y"], [1 << 60, 3]), ([b"b"], ["x", "y"], [5, 0])]
