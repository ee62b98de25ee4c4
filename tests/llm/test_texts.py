"""Language id, secrets, sketches and quality rules against plain versions."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import langid, quality, secret_scan, sketch

from .conftest import prose, table


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang := rng.choice(["en", "de", "fr"]), rng.randint(20, 150)), lang, "s") for i in range(300)]
    return rows, table(spark, rows)


def test_language(labelled):
    rows, docs = labelled
    dictionaries = langid.fit_dictionaries(docs.filter(langid.fold_of() != 0))
    assert sorted(dictionaries) == ["de", "en", "fr"]
    truth = {i: lang for i, _, lang, _ in rows}
    found = langid.classify(docs.filter(langid.fold_of() == 0), dictionaries).collect()
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in found)
    assert len(found) > 30 and right >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found) and sum(r["rejected"] for r in found) <= 0.03 * len(found)


def test_language_does_not_read_labels(spark, labelled):
    rows, docs = labelled
    dictionaries = langid.fit_dictionaries(docs)
    other = table(spark, [(i + 1000, t, "xx", "other") for i, t, *_ in rows])
    a = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.classify(docs, dictionaries).collect())
    b = sorted((r["doc_id"] - 1000, r["lang_pred"], r["score"]) for r in langid.classify(other, dictionaries).collect())
    assert a == b


def test_language_edges(spark, messy, messy_docs, empty_docs):
    dictionaries = langid.fit_dictionaries(messy_docs)
    found = langid.classify(messy_docs, dictionaries).collect()
    assert len(found) == len(messy)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i in (100, 101, 102, 104):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[105]["lang_pred"] == "en"
    assert langid.fit_dictionaries(empty_docs) == {}
    assert {r["lang_pred"] for r in langid.classify(messy_docs, {}).collect()} == {"und"}
    assert langid.classify(empty_docs, dictionaries).collect() == []
    assert langid.classify_text("ab", (("x", b" ab "),), levels=(3,))[:2] == ("x", 1.0)
    tied = langid.classify_text("zz", (("b", b" q "), ("a", b" q ")))
    assert tied == ("a", 0.0, True)
    with pytest.raises(ValueError):
        langid.fit_dictionaries(messy_docs, max_languages=1)
    with pytest.raises(ValueError):
        langid.classify(messy_docs, dictionaries, keep=["score"])


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY, TOKEN = "AKIA" + "ABCDEFGH12345678", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
SECRETS = [
    "x token = \"%s\" y" % TOKEN,
    "PASSWORD: hunter secret=abcdef api_key='Zz9' apikey = Q1w2E3r4T5",
    "token:token: abcdefgh",
    f"{KEY} {KEY}X AKIA123 {TOKEN} deadbeef",
    "😀 é secret = \"s3cr3tvalue99xyzAB\" 😀 tail",
    f"bare {TOKEN}zq and s3cr3tvalue99xyzAB here",
    "",
    None,
    "secret=aaaaaa" * 40,
    ("ab12cd34ef56" * 3 + " ") * 300,
]


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base(spark, messy, messy_docs, empty_docs):
    docs = table(spark, [(i, t, "en", f"s{i}") for i, t in enumerate(SECRETS)])
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] for r in secret_scan.scan(docs).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(SECRETS)}
    assert secret_scan.scan(messy_docs).count() == len(messy)
    assert secret_scan.scan(empty_docs).collect() == []
    text = docs.sparkSession.range(1).select(secret_scan.span_text(F.expr("array(struct(1 start, 0 kind, 9 end), struct(4 start, 3 kind, 9 end))")).alias("t")).first()["t"]
    assert text == "assign:1:9,owned:4:9"


def test_secrets_ownership(spark):
    live, copied = "k9Xv27QpLm48ZtRw", "c0pied8Xv27QpLm48Zt"
    rows = [(1, f"token = {live}", "en", "a"), (2, f"see {live} there", "en", "a"), (3, "nothing", "en", "b"), (4, f"token = {live}", "en", None)]
    rows += [(10 + i, f"token = {copied}", "en", f"o{i}") for i in range(5)] + [(20, f"bare {copied}", "en", "z"), (30, "token = your_example_key_1", "en", "q")]
    rows += [rows[0]]
    got = collections.defaultdict(list)
    docs = table(spark, rows)
    scanned = secret_scan.scan(docs)
    for r in scanned.collect():
        got[r["doc_id"]].append([(s["kind"], s["verdict"]) for s in r["spans"]])
    assert got[1] == [[(0, "live")]] * 2  # a repeated row is scanned as often
    assert got[2] == [[(3, "live")]]  # the bare value that stands elsewhere with a keyword
    assert got[3] == [[]] and got[4] == [[(0, "live")]]
    assert all(got[10 + i] == [[(0, "example")]] for i in range(5)) and got[20] == [[]]
    assert got[30] == [[(0, "weak")]]
    texts = sorted((r["doc_id"], r["text"]) for r in secret_scan.redact(docs, scanned).collect())
    assert texts[:4] == [(1, "[SECRET]"), (1, "[SECRET]"), (2, "see [SECRET] there"), (3, "nothing")]
    assert (10, f"token = {copied}") in texts and len(texts) == len(rows)


def test_secrets_of_many_repositories(spark):
    copied, own = "c0pied8Xv27QpLm48Zt", "k9Xv27QpLm48ZtRw"
    rows = [(i, f"token = {copied}", "en", f"s{i % 2}") for i in range(30)] + [(40 + i, f"token = {own}", "en", "s0") for i in range(3)]
    docs = table(spark, rows)
    scanned = secret_scan.scan(docs)
    assert {(r["doc_id"] < 40, s["verdict"]) for r in scanned.collect() for s in r["spans"]} == {(True, "example"), (False, "live")}
    assert {r["doc_id"] for r in secret_scan.redact(docs, scanned).collect() if r["text"] == "[SECRET]"} == {40, 41, 42}


def test_redaction_of_null_ids(spark):
    docs = table(spark, [(None, f"a token = {TOKEN}", "en", "a"), (None, "nothing", "en", "a"), (None, None, "en", "b")])
    out = secret_scan.redact(docs, secret_scan.scan(docs)).collect()
    assert sorted((r["text"] for r in out), key=str) == [None, "a [SECRET]", "nothing"]


def test_short_and_embedded_secrets(spark):
    value, letters = "k9Xv27QpLm48ZtRw", "QwertzUiopAsdfGhjk"
    texts = ["password: hunter.", f"token = {value}", f"ends with {value}.", f"auth={value}&", f"http://host/{value}/x", f"secret={letters}", f"so {letters} again", "password = changeme"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + [(20 + i, "password: shared", "en", f"s{i}") for i in range(2)])
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect()}
    assert [out[i] for i in range(len(texts))] == [
        "[SECRET]",
        "[SECRET]",
        "ends with [SECRET].",
        "auth=[SECRET]&",
        "http://host/[SECRET]/x",
        "[SECRET]",
        "so [SECRET] again",
        "password = changeme",
    ]
    assert out[20] == out[21] == "password: shared"


def test_redaction_of_overlapping_places(spark):
    docs = table(spark, [(1, f"é token = {TOKEN} and {TOKEN}zq1 é", "en", "a"), (2, None, "en", "a")])
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, secret_scan.scan(docs)).collect()}
    assert out[1].startswith("é [SECRET] and") and out[2] is None


def plain_sketch(spark, texts, scale):
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    full = sketch.with_sketch(docs.select("doc_id", "text"), F.col("text"), "s", scale=1).collect()
    limit = -(1 << 63) + (1 << 64) // scale
    return {r["doc_id"]: [h for h in r["s"] if h < limit] for r in full}


def test_fingerprints(spark, messy, messy_docs, empty_docs):
    docs = table(spark, [(i * 7 % 41, t, None, None) for i, (_, t, *_) in enumerate(r for r in messy if r[0] is not None and r[0] < 40)])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in sketch.fingerprints(docs).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for i in range(max(1, len(w) - 4)) if w}
    errors = []
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(abs(got[i]["near_edited"] - len(a & b) / min(len(a), len(b))))
        assert got[i]["near_next"] <= 0.1
    assert sum(errors) / len(errors) < 0.15
    assert sketch.fingerprints(empty_docs).collect() == []
    found = sketch.fingerprints(messy_docs).collect()
    assert len(found) == len(messy)
    same = {r["fingerprint"] for r in found if r["doc_id"] in (106, 107)}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    alone = sketch.fingerprints(table(spark, [(5, "a b c d e f g h i", None, None)])).first()
    assert (alone["near_next"], alone["edited_sha256"]) == (1.0, hashlib.sha256(b"a b c d e f a b c").hexdigest())


def test_fingerprints_of_short_texts(spark):
    rng = random.Random(4)
    texts = [prose(rng, "en", n % 50 + 6) for n in range(100)] + [prose(rng, "en", 1500)]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in sketch.fingerprints(docs).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    for i, t in enumerate(texts[:100]):
        edited = t[: len(t) - len(t) // 3] + texts[i - 1][: len(t) // 3]
        a, b = shingles(t), shingles(edited)
        assert len(got[i]["fingerprint"].split(",")) == len(a)
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / min(len(a), len(b)))
    # a text beside one that holds it, of very unequal size
    pair = sketch.fingerprints(table(spark, [(2, " ".join(texts[100].split()[:40]), None, None), (1, texts[100], None, None)])).collect()
    assert all(r["near_next"] == 1.0 for r in pair)


def test_sketch_threshold_and_merge(spark):
    rng = random.Random(3)
    texts = [prose(rng, "en", 300), prose(rng, "de", 40), "", None, "one two"]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.select("doc_id", "text"), F.col("text"), "s", scale=8).collect()}
    assert got == plain_sketch(spark, texts, 8) and got[2] == got[3] == []
    both = spark.createDataFrame([(got[0], got[1])], "a array<long>, b array<long>").select(sketch.merge(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert both == sorted(set(got[0]) | set(got[1]))


def test_merged_sketches_are_those_of_the_joint_text(spark):
    rng = random.Random(17)
    for sizes in ((30, 40), (60, 2000), (100, 110), (900, 1500), (0, 50), (3000, 5)):
        parts = [prose(rng, "en", n).split() for n in sizes]
        apart = [" ".join(p) for p in parts]
        docs = table(spark, [(i, t, None, None) for i, t in enumerate(apart)])
        full = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.select("doc_id", "text"), F.col("text"), "s", scale=1).collect()}
        got = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.select("doc_id", "text"), F.col("text"), "s", scale=8, least=64).collect()}
        rule = lambda all_: [h for i, h in enumerate(sorted(all_)) if h < sketch.limit(8) or i < 64]
        assert got == {i: rule(h) for i, h in full.items()}
        pair = spark.createDataFrame([(got[0], got[1])], "a array<long>, b array<long>")
        m, m2 = pair.select(sketch.merge(F.col("a"), F.col("b"), least=64), sketch.merge(F.col("b"), F.col("a"), least=64)).first()
        assert m == m2 == rule(set(full[0]) | set(full[1]))


def test_stored_fingerprints_say_what_the_query_says(spark):
    rng = random.Random(18)
    words = prose(rng, "en", 4000).split()
    rows = [(5, " ".join(words)), (4, " ".join(words[:120])), (3, " ".join(words[:400])), (2, "one two"), (1, None), (0, " ".join(words[300:2000]))]
    got = {r["doc_id"]: r for r in sketch.fingerprints(table(spark, [(i, t, None, None) for i, t in rows])).collect()}
    stored = spark.createDataFrame([(i, got[i]["fingerprint"], got[i]["edited_fingerprint"], got[max(0, i - 1) if i else 5]["fingerprint"]) for i in got], "i int, a string, b string, c string")
    a, b, c = (sketch.from_text(F.col(x)) for x in "abc")
    again = {r["i"]: r for r in stored.select("i", sketch.alike(a, b, 8, 128).alias("edited"), sketch.alike(a, c, 8, 128).alias("next")).collect()}
    for i, t in rows:
        if t:  # equal texts, empty ones too, are alike whatever the hashes
            assert (again[i]["edited"], again[i]["next"]) == (got[i]["near_edited"], got[i]["near_next"]), i
    assert got[5]["near_next"] == got[4]["near_next"] == 1.0 and len(got[5]["fingerprint"]) < len(rows[0][1]) / 3
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = shingles(words[300:2000]), shingles(words)
    assert got[0]["near_next"] == pytest.approx(len(x & y) / len(x), abs=0.1)


def test_next_in_order(spark):
    keys = [5, -3, 10**18, 7, 7, None, 0, -(2**62)]
    docs = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "doc_id long, text string").repartition(3)
    got = sketch.next_in_order(docs, "doc_id", ["text"], rows_per_bucket=2).collect()
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((k is None, -(k or 0), hashes[f"v{i}"], f"v{i}") for i, k in enumerate(keys)))
    want = {a[3]: b[3] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r["text"]: r["next_text"] for r in got} == want


def test_buckets_are_even_whatever_the_keys(spark):
    far = spark.range(1500).select(F.when(F.col("id") < 1000, F.col("id")).when(F.col("id") == 1499, F.lit(1 << 60)).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = sketch.next_in_order(far, "doc_id", ["text"], rows_per_bucket=50)
    assert got.count() == 1500 and got.select("next_text").distinct().count() == 1500
    # one exchange of the rows, by bucket: its partitions are read as they are
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 200  # of 1500, with a third of null keys and one that is far off


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, messy, messy_docs, empty_docs):
    rng = random.Random(8)
    good = [(i, prose(rng, "en", 120), "en", "s0") for i in range(60)]
    line = "same words in this line here"
    odd = [
        (200, " ".join(w + rng.choice(["***", "&&&", "%%%"]) for w in prose(rng, "en", 100).split()), "en", "s0"),
        (201, "\n".join([line] * 30), "en", "s0"),
        (202, "x " * 60, "en", "s0"),
        (203, "a b c d a b c " + prose(rng, "en", 60), "en", "s0"),
        (204, "too short", "en", "s0"),
        (205, "\n".join([prose(rng, "en", 8).replace("\n", " ")] * 2 + [prose(rng, "en", 60)]), "en", "s0"),
    ]
    rows = good + odd + messy
    got = collections.defaultdict(list)
    for r in quality.judge(table(spark, rows), keep=["doc_id"]).collect():
        got[r["doc_id"]].append(r)
    for i, t, *_ in rows:
        n, chars, symbols, dups, repeats = plain_measures(t)
        if i is None:
            continue
        for r in got[i]:
            if len({x for j, x, *_ in rows if j == i}) > 1:
                continue
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats), i
            assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
            assert not (r["base_failed"] and r["kept"])
    assert sum(len(v) for v in got.values()) == len(rows)
    assert all(any(r["kept"] for r in got[i]) for i, *_ in good)
    assert not any(r["kept"] for i in (200, 201, 202, 204) for r in got[i])
    assert got[203][0]["kept"]
    assert quality.judge(empty_docs, keep=["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        quality.judge(messy_docs.withColumn("kept", F.lit(1)))


def test_fences_follow_the_group(spark):
    rng = random.Random(12)
    hashed = lambda n: " ".join(w + "###" for w in prose(rng, "en", n).split())
    rows = [(i, prose(rng, "en", 80), "en", "plain") for i in range(40)] + [(100 + i, hashed(80), "en", "marked") for i in range(40)] + [(300, hashed(80), "en", "plain")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, rows), keep=["doc_id"]).collect()}
    assert all(kept[100 + i] for i in range(40))  # usual in its source
    assert not kept[300]  # an outlier in the other


def test_fences_come_from_the_sketches(spark):
    rng = random.Random(21)
    rows = []
    for source, most in (("few", 0.02), ("many", 0.12)):
        rows += [(source, most * rng.random() ** 2, 0.0, 0.05 * rng.random(), rng.gauss(5, 0.1 if source == "few" else 0.4)) for _ in range(400)]
    rows += [("few", 0.11, 0.0, 0.0, 4.0)] * 15  # tables of symbols and short words
    measured = spark.createDataFrame(rows, "source string, symbol_share double, dup_line_share double, repeat_share double, mean_word double")
    limits = {r["source"]: r for r in quality.fences(measured, ["source"], quality.Workspace(spark, "test")).collect()}
    few, many = limits["few"], limits["many"]
    assert few["symbol_share_hi"] < 0.11 < 0.2 < many["symbol_share_hi"]
    assert few["mean_word_lo"] > 4.05 and many["mean_word_lo"] < 4.0
    assert few["dup_line_share_hi"] is None  # no spread anywhere


def test_fences_differ_between_groups_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    space = quality.Workspace(spark, "test")
    judged = space.save(quality.judge(docs, keep=["doc_id", "lang", "source"]), "judged").filter(~F.col("base_failed"))
    limits = quality.fences(judged, ["lang", "source"], space).collect()
    for rule in quality.RULES:
        assert len({round(r[f"{rule}_hi"], 6) for r in limits}) > len(limits) / 2, rule
    gone = judged.filter(~F.col("kept")).join(labels, "doc_id").agg(F.count("*").alias("n"), F.avg("quality").alias("good")).first()
    assert gone["n"] > 200 and gone["good"] < 0.2


def exact_fences(rows):
    """Fences by sorted values: (group, measures) -> group -> rule -> (low, high)."""
    import math

    def spreads(rows, rule):
        found = {}
        for g in {g for g, _ in rows}:
            own = sorted(m[rule] for h, m in rows if h == g)
            at = lambda q, own=own: own[max(1, math.ceil(q * len(own))) - 1]
            found[g] = (len(own), at(quality.RULES[rule][0]), at(quality.RULES[rule][1]))
        usual = sum(n * (b - a) for n, a, b in found.values()) / sum(n for n, *_ in found.values())
        wide = {g: max((n * (b - a) + quality.PRIOR_ROWS * usual) / (n + quality.PRIOR_ROWS), usual / 2) for g, (n, a, b) in found.items()}
        return {g: (a - 3 * wide[g], (b if quality.RULES[rule][2] else a) + 3 * wide[g]) for g, (_, a, b) in found.items() if wide[g] > 0}

    words = spreads(rows, "mean_word")
    usual = [(g, m) for g, m in rows if words[g][0] <= m["mean_word"] <= words[g][1]]
    return {"mean_word": words} | {r: spreads(usual, r) for r in quality.RULES if r != "mean_word"}


def test_kept_is_that_of_exact_quantiles(spark):
    rng = random.Random(31)
    rows, i = [], 0
    for source, marks in (("a", 0.02), ("b", 0.3), (None, 0.1)):
        for _ in range(150):
            text = " ".join(w + ("#" if rng.random() < marks * rng.random() else "") for w in prose(rng, "en", 60 + i % 90).split())
            rows.append((i, text if i % 45 else text + " ***" * rng.randrange(60, 200), "en", source))
            i += 1
    share = lambda a, b: a / b if b else 0.0
    measured, failed = {}, set()
    for i, text, _, source in rows:
        n, chars, symbols, dups, repeats = plain_measures(text)
        lines = sum(bool(x.strip()) for x in text.split("\n"))
        if n < 50 or 100 * repeats > 50 * n:
            failed.add(i)
        measured[i] = (source, {"symbol_share": share(symbols, chars), "dup_line_share": share(dups, lines), "repeat_share": share(repeats, n), "mean_word": share(chars, n)}, {"symbol_share": symbols, "dup_line_share": dups, "repeat_share": repeats})
    limits = exact_fences([(g, m) for i, (g, m, _) in measured.items() if i not in failed])
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, rows), keep=["doc_id"]).collect()}
    decided = 0
    for i, (g, m, counts) in measured.items():
        verdicts = []
        for slack in (-0.02, 0.02):  # the sketches' error, three spreads of it
            inside = i not in failed
            for rule, (_, _, low_side) in quality.RULES.items():
                if g not in limits[rule]:
                    continue
                low, high = limits[rule][g]
                inside &= m[rule] <= high * (1 + slack) or (rule in counts and counts[rule] <= quality.LEAST[rule][1])
                inside &= not low_side or m[rule] >= low * (1 - slack)
            verdicts.append(inside)
        if verdicts[0] == verdicts[1]:
            decided += 1
            assert got[i] == verdicts[0], (i, m)
    assert decided > 0.95 * len(rows) and 8 <= sum(not k for k in got.values()) < 100


def test_fences_hang_on_no_chance_and_no_order(spark):
    value = lambda seed: F.abs(F.randn(seed))
    drawn = spark.range(120_000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.lit("cold")).alias("source"), value(1).alias("symbol_share"), (value(2) / 50).alias("dup_line_share"), value(3).alias("repeat_share"), (value(4) + 4).alias("mean_word"))
    space = quality.Workspace(spark, "test")
    measured = space.save(drawn, "drawn")
    runs = [{r["source"]: r.asDict() for r in quality.fences(m, ["source"], space).collect()} for m in (measured, measured, measured.repartition(1), measured.repartition(13, "mean_word"))]
    assert runs[0] == runs[1] == runs[2] == runs[3]
    # quantiles within the stated error, from sketches of parts merged
    parts = [quality.sketched(measured.filter(f"pmod(hash(mean_word), 3) = {i}"), ["source"], ["mean_word", "symbol_share"]) for i in range(3)]
    together = quality.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["source"])
    got = {r["source"]: r for r in quality.quantiles(together, ["source"], {"mean_word": (0.25, 0.75), "symbol_share": (0.5, 0.97)}).collect()}
    exact = {r["source"]: r for r in measured.groupBy("source").agg(F.percentile_approx("mean_word", [0.25, 0.75], 10**7).alias("w"), F.percentile_approx("symbol_share", [0.5, 0.97], 10**7).alias("s")).collect()}
    for source, r in got.items():
        found = [r["mean_word_0"], r["mean_word_1"], r["symbol_share_0"], r["symbol_share_1"]]
        assert found == pytest.approx([*exact[source]["w"], *exact[source]["s"]], rel=1 / 184)
