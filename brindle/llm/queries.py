"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attention_lm, decontamination, divergence, jaccard_join, langid, mixing, packing, quality, rans, secret_scan, sketch, spelling, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rans.write_ids(spark, _table(spark, sf_dir, "documents"), _word_bpe(), end_id=1)
    return rans.document_digests(spark, files.path)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = langid.fit_dictionaries(docs.filter(langid.fold_of() != 0))
    held = F.coalesce(langid.fold_of() == 0, F.lit(False))
    found = langid.classify(docs, dictionaries)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    with_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return spans.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        with_verdict("live").alias("n_live"),
        with_verdict("example").alias("n_example"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), _word_bpe(), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(spark, _table(spark, sf_dir, "documents"), _word_bpe(), held_out_fold=1)


def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(spark, _table(spark, sf_dir, "pages"), min_bytes=0)
    records = warc.read_archive(spark, path)
    record = [F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")]
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *record)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), max_repeats=2.0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(spark, _table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return decontamination.report(found)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS eol FROM pages
), d AS (
  SELECT page_id, url, html, eol, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
), k AS (
  SELECT *, page_id = first_id AS is_first,
       list_aggregate(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)),
         'string_agg', '') AS payload_digest,
       'HTTP/1.1 200 OK' || eol || 'Content-Type: text/html; charset=UTF-8' || eol || 'Content-Length: ' || payload_bytes || eol || eol AS http
  FROM d
), r AS (
  SELECT *, 'WARC/1.1' || eol
    || 'WARC-Type: ' || CASE WHEN is_first THEN 'response' ELSE 'revisit' END || eol
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || eol
    || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || eol, '')
    || 'WARC-Date: 1970-01-01T00:00:00Z' || eol
    || 'WARC-Payload-Digest: sha1:' || payload_digest || eol
    || CASE WHEN is_first THEN '' ELSE 'WARC-Refers-To: <urn:page:' || first_id || '>' || eol
         || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || eol END
    || 'Content-Type: application/http; msgtype=response' || eol
    || 'Content-Length: ' || (octet_length(encode(http)) + CASE WHEN is_first THEN payload_bytes ELSE 0 END) || eol || eol
    || http || CASE WHEN is_first THEN html ELSE '' END || eol || eol AS record
  FROM k
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN is_first THEN NULL ELSE first_id END AS refers_to,
       octet_length(encode(record))::BIGINT AS record_bytes, sha256(record) AS record_sha256
FROM r
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(ws) >= 4 THEN list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
    ELSE [] END AS shingles
  FROM w
), n AS (
  SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s
), e AS (
  SELECT doc_id, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 85 * (na.n_shingles + nb.n_shingles - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, min(reach.b)) AS component_id
FROM n JOIN reach ON reach.a = n.doc_id
GROUP BY n.doc_id, n.n_shingles
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS l,
         unnest(list_transform(generate_series(1, greatest(len(ws) - 9, 1)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS w
  FROM b WHERE len(ws) > 0
), d AS (
  SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents
), spot AS (
  SELECT r, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l
), hit AS (
  SELECT spot.r, spot.i, spot.l, win.item FROM spot JOIN win ON win.l = spot.l AND win.w = array_to_string(spot.ws[spot.i:spot.i + spot.l - 1], ' ')
), covered AS (
  SELECT r, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS place FROM (SELECT DISTINCT r, i, l FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

#: crc32 of a string: its bytes, folded over a table that is made by the polynomial's rule.
OP12_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, steps WHERE length(run) >= 6
), noisy AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), known AS (
  SELECT word, count(*) AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), cut AS (
  SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM known)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT cut.word, known.word FROM cut JOIN known ON cut.rest = known.word
  UNION SELECT DISTINCT known.word, cut.word FROM cut JOIN known ON cut.rest = known.word
), best AS (
  SELECT p.word, count(*) AS n_near, max(k.n) AS most, arg_min(k.word, (-k.n, k.word)) AS near FROM pairs p JOIN known k ON k.word = p.near GROUP BY p.word
), forms AS (
  SELECT known.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * n THEN near END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM known LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL
  SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, chain.last AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON chain.word = forms.word JOIN forms ends ON ends.word = chain.last WHERE ends.form IS NULL
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), tok AS (
  SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), cnt AS (
  SELECT tok.lang, tok.source, tok.term, count(*) AS c FROM tok JOIN kept ON tok.lang = kept.lang AND tok.term = kept.term GROUP BY ALL
), tot AS (
  SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(cnt.c, 0) AS c,
         1 + 1000000000::HUGEINT * (coalesce(cnt.c, 0) + 2) // (coalesce(tot.n, 0) + 2 * v.v) AS p,
         1 + 1000000000::HUGEINT * (kept.c + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
  LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language": op2_language,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_lm_scores": op6_lm_scores,
    "op7_archive": op7_archive,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_decontamination": op11_decontamination,
    "op12_spelling": op12_spelling,
    "op13_divergence": op13_divergence,
}
ORACLES = {
    "op7_archive": OP7_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
