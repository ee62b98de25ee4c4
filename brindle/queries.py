"""Registered queries over the test tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .config import CATEGORY_MAPPINGS, KEYWORD_ROUTES, TOOL_NAMES, EngineConfig
from .functions import chunking, keywords as kw, text as tx
from .operators import fusion, lexical, nearest
from .plans import catalog as cat, search as plan
from .sources import embedding as emb, files

RARE_QUERY = "tion reon ndtion elle schge"
COMMON_QUERY = "the of and thon"
REPEAT_QUERY = "thon thon thon reon"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents; dealt out where the file has fewer splits than there are cores, since its texts are much work."""
    rows, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _index(spark: SparkSession, sf: str, query: str | None = None) -> lexical.LexicalIndex:
    return lexical.build(docs(spark, sf), "doc_id", "text", None if query is None else {"q": query})


# ---- keyword index -------------------------------------------------------------------------------

TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9][-a-z0-9]*[a-z0-9]|[a-z0-9]')"


def lexical_ctes(source: str = "documents", id_col: str = "doc_id") -> str:
    """SQL of the index: toks, len, post, corpus, terms."""
    return f"""
toks AS (SELECT {id_col} AS id, unnest({TOKENS_SQL}) AS term FROM {source}),
len AS (SELECT {id_col} AS id, len({TOKENS_SQL})::BIGINT AS dl FROM {source}),
post AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
corpus AS (SELECT count(*) AS n_docs, coalesce(sum(dl), 0)::BIGINT AS total_len, avg(dl) AS avgdl FROM len),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM freq, corpus),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25_ctes(query: str, k: int) -> str:
    """SQL of a search over :func:`lexical_ctes`: hits(id, score, rank)."""
    return f"""
asked AS (SELECT term, count(*) AS qtf FROM (
  SELECT unnest(regexp_extract_all(lower('{query}'), '[a-z0-9][-a-z0-9]*[a-z0-9]|[a-z0-9]')) AS term) GROUP BY term),
scored AS (SELECT p.id, round(sum(a.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))), 9) AS score
  FROM post p JOIN asked a USING (term) JOIN terms t USING (term) JOIN len l ON l.id = p.id, corpus c GROUP BY p.id),
hits AS (SELECT id, score, rank FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def _bm25(query: str, k: int = 15):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = lexical.search(_index(spark, sf, query), lexical.query_table(spark, {"q": query}), k)
        return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")

    sql = f"WITH {lexical_ctes()}, {bm25_ctes(query, k)} SELECT id AS doc_id, round(score, 6) AS score, rank FROM hits"
    return run, sql


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf")


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.text_frequency(docs(spark, sf), "text")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(docs(spark, sf), "text").withColumn("avgdl", F.round("avgdl", 6))


def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.withColumn("idf", F.round("idf", 6))


# ---- chunks --------------------------------------------------------------------------------------


def chunk_ctes(text: str = "text", source: str = "documents") -> str:
    """SQL of the chunker at size 1000 and overlap 200: chunks(doc_id, chunk_index, start_char, end_char, content)."""
    zone = "reverse(substr(t, s + 801, 200))"
    snapped = "CASE " + " ".join(
        f"WHEN instr({zone}, {p}) > 0 THEN 1000 - instr({zone}, {p}) + 1" for p in ("chr(10) || chr(10)", "chr(10)", "' .'", "' '")
    ) + " ELSE 1000 END"
    end = f"CASE WHEN s + 1000 >= n THEN n ELSE s + ({snapped}) END"
    return f"""
src AS (SELECT doc_id, {text} AS t, length({text}) AS n FROM {source} WHERE length({text}) > 0),
win(doc_id, k, s, e) AS (
  SELECT doc_id, 0, 0::BIGINT, ({end.replace('s + ', '0 + ')})::BIGINT FROM src
  UNION ALL
  SELECT doc_id, k + 1, s, ({end})::BIGINT FROM (
    SELECT w.doc_id, w.k, CASE WHEN w.e - 200 <= w.s THEN w.e ELSE w.e - 200 END AS s, src.t, src.n FROM win w JOIN src USING (doc_id)) WHERE s < n),
cut AS (SELECT doc_id, k, s, e, regexp_replace(substr(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS content FROM win JOIN src USING (doc_id)),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, content
  FROM cut WHERE content <> '')"""


def _chunks(df: DataFrame) -> DataFrame:
    return chunking.chunks(df.select("doc_id", "text"), "text")


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_index", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(_chunks(docs(spark, sf)))


PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"


def chunk_paragraph_break(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(_chunks(docs(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunks(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    return rows


def _all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(docs(spark, sf)).select(tx.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.col("content").alias("text"), "doc_id", "chunk_index")


def bm25_over_chunks(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical.search(lexical.build(_all_chunks(spark, sf), "chunk_id", "text", {"q": RARE_QUERY}), lexical.query_table(spark, {"q": RARE_QUERY}), 15)
    return hits.select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _all_chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index")


CHUNK_DIGEST_SQL = "SELECT doc_id, chunk_index, start_char, end_char, md5(content) AS content_md5 FROM chunks"

# ---- vectors and fusion --------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"))


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


def _far(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9)"


def near_cte(where: str = "true", k: int = 15) -> str:
    return f"""
near AS (SELECT id, distance, rank FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id)::INT AS rank FROM (
  SELECT v.vec_id AS id, {_far('v.embedding', 'q.embedding')} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}))
  WHERE rank <= {k})"""


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(_vectors(spark, sf), _query_vector(spark, sf), 15).withColumn("distance", F.round("distance", 6))


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    inside = table(spark, sf, "embeddings").filter("label = 1").select(F.col("vec_id").alias("id"), "embedding")  # reaches the scan
    return nearest.nearest(inside, _query_vector(spark, sf), 15).withColumn("distance", F.round("distance", 6))


def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return nearest.nearest_batch(_vectors(spark, sf), asked, 10).withColumn("distance", F.round("distance", 6))


KNN_BATCH_SQL = f"""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, {_far('v.embedding', 'q.embedding')} AS distance
    FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


def _hybrid(alpha: float, category: str | None = None, scope: str = "semantic", k: int = 5):
    config = EngineConfig(filter_scope=scope)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        kinds = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
        vectors = _vectors(spark, sf).drop("category").join(kinds, "id")
        if category and scope == "both":  # keyword hits may come from documents without a vector
            vectors = kinds.join(vectors.drop("category"), "id", "left")
        queries = lexical.query_table(spark, {"q": COMMON_QUERY})
        semantic, keyword = plan.legs(vectors, _index(spark, sf, COMMON_QUERY), queries, _query_vector(spark, sf), k, category=category, config=config)
        return fusion.fuse(semantic, keyword, alpha, k).drop("query_id")

    where = f"v.vec_id IN (SELECT doc_id FROM documents WHERE lang = '{category}')" if category else "v.vec_id IN (SELECT doc_id FROM documents)"
    inside = f" AND id IN (SELECT doc_id FROM documents WHERE lang = '{category}')" if category and scope == "both" else ""
    sql = f"""WITH {lexical_ctes()}, {bm25_ctes(COMMON_QUERY, 3 * k).replace("WHERE score > 0", "WHERE score > 0" + inside)}, {near_cte(where, 3 * k)},
fused AS (SELECT coalesce(n.id, h.id) AS id, n.rank AS semantic_rank, h.rank AS bm25_rank,
  {alpha} * (1.0::DOUBLE / (60 + coalesce(n.rank, 1000))) + {1 - alpha} * (1.0::DOUBLE / (60 + coalesce(h.rank, 1000))) AS raw
  FROM near n FULL JOIN hits h ON n.id = h.id)
SELECT id, round(raw, 6) AS score, semantic_rank, bm25_rank,
  CASE WHEN semantic_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN 'hybrid' WHEN semantic_rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS search_method, rank
FROM (SELECT *, row_number() OVER (ORDER BY round(raw, 12) DESC, id)::INT AS rank FROM fused) WHERE rank <= {k}"""
    return run, sql


# ---- routes, categories, keywords ----------------------------------------------------------------

#: Words of the test texts, so that routes and keywords are met.
TEST_ROUTES = (("first", ("the", "tion", "of the")), ("second", ("que", "la", "elle")), ("third", ("und", "der", "sch", "to")))


def route_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", kw.route(F.col("text"), TEST_ROUTES).alias("routed"))


def _route_sql() -> str:
    def hit(word: str) -> str:
        edge = "[^\\p{L}\\p{M}\\p{N}_]"  # \\b knows ASCII only there
        return f"contains(q, '{word}')::INT" if " " in word else f"regexp_matches(q, '(?:^|{edge}){word}(?:$|{edge})')::INT"

    sums = {name: " + ".join(hit(w) for w in words) for name, words in TEST_ROUTES}
    names = [n for n, _ in TEST_ROUTES]
    case = " ".join(f"WHEN {n} = greatest({', '.join(names)}) AND {n} > 0 THEN '{n}'" for n in names)
    return f"SELECT conv_id, turn, CASE {case} END AS routed FROM (SELECT conv_id, turn, {', '.join(f'{s} AS {n}' for n, s in sums.items())} FROM (SELECT *, lower(text) AS q FROM conversations))"


def _test_path() -> Column:
    kind = F.element_at(F.array(*[F.lit(p) for p, _ in CATEGORY_MAPPINGS], F.lit("other")), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat_ws("/", "source", kind, F.concat(F.col("lang"), F.lit(".md")))


def _test_path_sql() -> str:
    return "concat_ws('/', source, [" + ", ".join(f"'{p}'" for p, _ in CATEGORY_MAPPINGS) + ", 'other'][doc_id % 8 + 1], lang || '.md')"


def doc_category(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", kw.category(_test_path()).alias("category"))


def _category_sql(path: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({path}, '{p}') THEN '{c}'" for p, c in sorted(CATEGORY_MAPPINGS, key=lambda m: -len(m[0]))) + " ELSE 'general' END"


def _keyword_text() -> Column:
    """Texts with terms at the end that depend on the id."""
    n = F.col("doc_id").cast("string")
    extra = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" nmap rapid CVE-2021-"), F.lpad(n, 5, "0"), F.lit(" cve-1999-0001 T1059.001 XT12345")))
    ips = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.concat(F.lit(" 10.0.0."), F.col("doc_id") % 7), (F.col("doc_id") % 9).cast("int")))
    return F.concat(F.col("text"), F.coalesce(extra, F.lit("")), F.coalesce(ips, F.lit("")))


KEYWORD_TEXT_SQL = """(text
  || CASE WHEN doc_id % 3 = 0 THEN ' nmap rapid CVE-2021-' || lpad(doc_id::VARCHAR, 5, '0') || ' cve-1999-0001 T1059.001 XT12345' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN repeat(' 10.0.0.' || (doc_id % 7)::VARCHAR, doc_id % 9) ELSE '' END)"""
CVE_SQL, TECHNIQUE_SQL = "regexp_extract_all(t, '(?i)CVE-\\d{4}-\\d{4,}')", "regexp_extract_all(t, 'T\\d{4}(?:\\.\\d{3})?')"
ADDRESS_SQL = "regexp_extract_all(t, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b')"
FEW_ADDRESSES_SQL = f"CASE WHEN len({ADDRESS_SQL}) <= 5 THEN {ADDRESS_SQL} ELSE [] END"


def _word_list_sql() -> str:
    words = dict.fromkeys([w.lower() for _, ws in KEYWORD_ROUTES for w in ws] + list(TOOL_NAMES))
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(kw.keywords(_keyword_text()), "|").alias("keywords"))


DOC_KEYWORDS_SQL = f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter({_word_list_sql()}, lambda w: contains(lower(t), w)),
  {CVE_SQL}), list_concat({TECHNIQUE_SQL}, {FEW_ADDRESSES_SQL})))), '|'), '') AS keywords FROM (SELECT doc_id, {KEYWORD_TEXT_SQL} AS t FROM documents)"""


def ip_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(kw.addresses(_keyword_text()), "|").alias("addresses"))


def cve_mitre_keywords(spark: SparkSession, sf: str) -> DataFrame:
    t = _keyword_text()
    return docs(spark, sf).select("doc_id", F.array_join(kw.cves(t), "|").alias("cves"), F.array_join(kw.techniques(t), "|").alias("techniques"))


# ---- parsers -------------------------------------------------------------------------------------


def _markdown() -> Column:
    """A Markdown text made of a document."""
    front = F.when(F.col("doc_id") % 2 == 0, F.lit("---\nk: v\n---\n")).otherwise("")
    return F.concat(front, F.lit("## part "), "lang", F.lit("\n"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("# "), "source", F.lit(" \n"))).otherwise(""), "text", F.lit("\n### end\n"))


MARKDOWN_SQL = """(CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) ELSE '' END || '## part ' || lang || chr(10)
  || CASE WHEN doc_id % 3 > 0 THEN '# ' || source || ' ' || chr(10) ELSE '' END || text || chr(10) || '### end' || chr(10))"""
HEADERS_SQL = "regexp_extract_all(t, '(?m)^(#{{1,6}})\\s+(.+)$', {})"


def md_headers(spark: SparkSession, sf: str) -> DataFrame:
    found = docs(spark, sf).select("doc_id", tx.md_headers(_markdown()).alias("h"))
    return found.select("doc_id", F.array_join(F.transform("h", lambda h: F.concat_ws(":", h["level"].cast("string"), h["title"])), "|").alias("headers"))


def md_title(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.md_title(tx.md_headers(_markdown()), F.concat(F.lit("stem"), F.col("doc_id"))).alias("title"))


def md_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    t = _markdown()
    return docs(spark, sf).select(
        "doc_id", tx.has_front_matter(t).alias("has_frontmatter"), tx.has_code_blocks(t).alias("has_code_blocks"), F.md5(tx.without_front_matter(t).cast("binary")).alias("content_md5")
    )


def text_line_count(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.line_count(F.col("text")).alias("line_count"))


def _code() -> Column:
    n = F.col("doc_id").cast("string")
    return F.concat(
        F.lit('"""Module '), n, F.lit('."""\nimport os\n\nfrom a.b import c, d\nX = 1\n\ndef f'), n, F.lit("(x):\n    def inner():\n        pass\n\nasync def g():\n    pass\n\nclass K"), n, F.lit(":\n    pass\n\nclass  L(K):\n    pass\n")
    )


CODE_SQL = """('\"""Module ' || doc_id || '.\"""' || chr(10) || 'import os' || chr(10) || chr(10) || 'from a.b import c, d' || chr(10) || 'X = 1' || chr(10) || chr(10) || 'def f' || doc_id
  || '(x):' || chr(10) || '    def inner():' || chr(10) || '        pass' || chr(10) || chr(10) || 'async def g():' || chr(10) || '    pass' || chr(10) || chr(10) || 'class K' || doc_id
  || ':' || chr(10) || '    pass' || chr(10) || chr(10) || 'class  L(K):' || chr(10) || '    pass' || chr(10))"""


def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    t = _code()
    return docs(spark, sf).select(
        "doc_id", tx.docstring(t).alias("docstring"), F.array_join(tx.py_functions(t), "|").alias("functions"), F.array_join(tx.py_classes(t), "|").alias("classes")
    )


CODE_SYMBOLS_SQL = f"""SELECT doc_id, trim(regexp_extract(t, '(?s)\\A["'']{{3}}(.*?)["'']{{3}}', 1)) AS docstring,
  array_to_string(regexp_extract_all(t, '(?m)^def\\s+(\\w+)\\s*\\(', 1), '|') AS functions,
  array_to_string(regexp_extract_all(t, '(?m)^class\\s+(\\w+)\\s*[:\\(]', 1), '|') AS classes FROM (SELECT doc_id, {CODE_SQL} AS t FROM documents)"""


def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(tx.py_imports(_code()), "|").alias("imports"))


CODE_IMPORTS_SQL = f"""SELECT doc_id, array_to_string(regexp_extract_all(t, '(?m)^(?:from\\s+[\\w.]+\\s+)?import\\s+[\\w.,\\s]+')[1:10], '|') AS imports
  FROM (SELECT doc_id, {CODE_SQL} AS t FROM documents)"""


def json_structure(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit(", 1]"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.col("props"), F.lit("}")))
    rows = table(spark, sf, "events").select("event_id", p.alias("p"))
    return rows.select("event_id", files.parse_json("p").alias("j")).select("event_id", F.col("j.valid").alias("is_valid_json"), "j.structure", "j.length")


JSON_STRUCTURE_SQL = """SELECT event_id, json_valid(p) AS is_valid_json,
  CASE WHEN json_valid(p) THEN CASE json_type(p) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END END AS structure,
  CASE WHEN json_valid(p) AND json_type(p) = 'ARRAY' THEN json_array_length(p)::INT END AS length
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || props || ', 1]' WHEN 1 THEN props ELSE props || '}' END AS p FROM events)"""


def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.array_join(tx.json_keys(F.col("props")), "|").alias("keys"))


def pretty_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", files.pretty_json("props").alias("content"))


def decode_ignore(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF0D0A")), F.lit("x").cast("binary"))
    return docs(spark, sf).select("doc_id", F.md5(files.decode_utf8(raw).cast("binary")).alias("content_md5"))


# ---- catalog -------------------------------------------------------------------------------------


def doc_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.document_id(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit("2024-01-01"), F.col("n_chars")).alias("hash"))


def _catalog(spark: SparkSession, sf: str, category: str) -> DataFrame:
    own = docs(spark, sf).filter(F.col("lang") == category)  # reaches the scan, before anything is cut
    counts = _chunks(own).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    rows = own.select("doc_id", "source", F.col("lang").alias("category"), F.lit(".txt").alias("format"), kw.keywords(F.col("text")).alias("keywords"))
    return rows.join(counts, "doc_id", "left").fillna(0, ["chunks"])


def list_categories(spark: SparkSession, sf: str) -> DataFrame:
    return cat.list_categories(docs(spark, sf).select(F.col("lang").alias("category")))


def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cat.list_documents(_catalog(spark, sf, "en"), "en").withColumn("keywords", F.array_join("keywords", "|"))


LIST_DOCUMENTS_SQL = f"""WITH RECURSIVE {chunk_ctes()}, n AS (SELECT doc_id, count(*)::INT AS chunks FROM chunks GROUP BY doc_id),
kw AS (SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter({_word_list_sql()}, lambda w: contains(lower(t), w)), {CVE_SQL}),
  list_concat({TECHNIQUE_SQL}, {FEW_ADDRESSES_SQL}))))[1:5], '|'), '') AS keywords FROM (SELECT doc_id, text AS t FROM documents))
SELECT d.doc_id, d.source, d.lang AS category, '.txt' AS format, coalesce(n.chunks, 0) AS chunks, kw.keywords
FROM documents d LEFT JOIN n USING (doc_id) JOIN kw USING (doc_id) WHERE d.lang = 'en'"""


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cat.index_stats(docs(spark, sf), _chunks(docs(spark, sf)))


def incremental_new_docs(spark: SparkSession, sf: str) -> DataFrame:
    return cat.new_documents(docs(spark, sf).select("doc_id", "source"), table(spark, sf, "labels"))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return emb.hash_features(docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", F.round("value", 6).alias("value"))


HASH_EMBED_SQL = f"""WITH h AS (SELECT doc_id, md5(unnest({TOKENS_SQL})) AS h FROM documents),
s AS (SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL)
SELECT doc_id, bucket, round(s::DOUBLE / sqrt(sum((s * s)::DOUBLE) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE s <> 0"""

# ---- registry ------------------------------------------------------------------------------------

bm25_search, BM25_SEARCH_SQL = _bm25(RARE_QUERY)
bm25_common_terms, BM25_COMMON_SQL = _bm25(COMMON_QUERY)
bm25_repeat_term, BM25_REPEAT_SQL = _bm25(REPEAT_QUERY)
_HYBRIDS = {
    "hybrid_rrf_a00": _hybrid(0.0),
    "hybrid_rrf_a50": _hybrid(0.5),
    "hybrid_rrf_a100": _hybrid(1.0),
    "hybrid_filtered": _hybrid(0.5, "fr"),
    "hybrid_strict_filter": _hybrid(0.5, "fr", "both"),
}

QUERIES = {
    "tokenize_counts": tokenize_counts,
    "term_df": term_df,
    "corpus_stats": corpus_stats,
    "bm25_idf": bm25_idf,
    "bm25_search": bm25_search,
    "bm25_common_terms": bm25_common_terms,
    "bm25_repeat_term": bm25_repeat_term,
    "bm25_over_chunks": bm25_over_chunks,
    "chunk_documents": chunk_documents,
    "chunk_paragraph_break": chunk_paragraph_break,
    "chunk_stats": chunk_stats,
    "chunk_ids": chunk_ids,
    "knn_l2": knn_l2,
    "knn_filtered": knn_filtered,
    "knn_batch": knn_batch,
    **{name: run for name, (run, _) in _HYBRIDS.items()},
    "route_queries": route_queries,
    "doc_category": doc_category,
    "doc_keywords": doc_keywords,
    "ip_keywords": ip_keywords,
    "cve_mitre_keywords": cve_mitre_keywords,
    "md_headers": md_headers,
    "md_title": md_title,
    "md_frontmatter": md_frontmatter,
    "text_line_count": text_line_count,
    "code_symbols": code_symbols,
    "code_imports": code_imports,
    "json_structure": json_structure,
    "json_keys": json_keys,
    "pretty_json": pretty_json,
    "decode_ignore": decode_ignore,
    "doc_id_hash": doc_id_hash,
    "list_categories": list_categories,
    "list_documents": list_documents,
    "index_stats": index_stats,
    "incremental_new_docs": incremental_new_docs,
    "hash_embed": hash_embed,
}

ORACLES = {
    "tokenize_counts": f"WITH {lexical_ctes()} SELECT id AS doc_id, term, tf FROM post",
    "term_df": f"WITH {lexical_ctes()} SELECT term, df FROM freq",
    "corpus_stats": f"WITH {lexical_ctes()} SELECT n_docs, total_len, round(avgdl, 6) AS avgdl FROM corpus",
    "bm25_idf": f"WITH {lexical_ctes()} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_search": BM25_SEARCH_SQL,
    "bm25_common_terms": BM25_COMMON_SQL,
    "bm25_repeat_term": BM25_REPEAT_SQL,
    "bm25_over_chunks": f"""WITH RECURSIVE {chunk_ctes()}, named AS (SELECT doc_id || '_' || chunk_index AS chunk_id, content AS text FROM chunks),
{lexical_ctes("named", "chunk_id")}, {bm25_ctes(RARE_QUERY, 15)} SELECT id AS chunk_id, round(score, 6) AS score, rank FROM hits""",
    "chunk_documents": f"WITH RECURSIVE {chunk_ctes()} {CHUNK_DIGEST_SQL}",
    "chunk_paragraph_break": f"WITH RECURSIVE {chunk_ctes(PARAGRAPHS)} {CHUNK_DIGEST_SQL}",
    "chunk_stats": f"WITH RECURSIVE {chunk_ctes()} SELECT doc_id, count(*) AS chunk_count, sum(end_char - start_char)::BIGINT AS chars FROM chunks GROUP BY doc_id",
    "chunk_ids": f"WITH RECURSIVE {chunk_ctes()} SELECT doc_id || '_' || chunk_index AS chunk_id, doc_id, chunk_index FROM chunks",
    "knn_l2": f"WITH {near_cte()} SELECT id, round(distance, 6) AS distance, rank FROM near",
    "knn_filtered": f"WITH {near_cte('v.label = 1')} SELECT id, round(distance, 6) AS distance, rank FROM near",
    "knn_batch": KNN_BATCH_SQL,
    **{name: sql for name, (_, sql) in _HYBRIDS.items()},
    "route_queries": _route_sql(),
    "doc_category": f"SELECT doc_id, {_category_sql(_test_path_sql())} AS category FROM documents",
    "doc_keywords": DOC_KEYWORDS_SQL,
    "ip_keywords": f"SELECT doc_id, coalesce(array_to_string({FEW_ADDRESSES_SQL}, '|'), '') AS addresses FROM (SELECT doc_id, {KEYWORD_TEXT_SQL} AS t FROM documents)",
    "cve_mitre_keywords": f"""SELECT doc_id, coalesce(array_to_string({CVE_SQL}, '|'), '') AS cves, coalesce(array_to_string({TECHNIQUE_SQL}, '|'), '') AS techniques
  FROM (SELECT doc_id, {KEYWORD_TEXT_SQL} AS t FROM documents)""",
    "md_headers": f"""SELECT doc_id, array_to_string(list_transform(list_zip({HEADERS_SQL.format(1)}, {HEADERS_SQL.format(2)}),
  lambda z: length(z[1]) || ':' || trim(z[2])), '|') AS headers FROM (SELECT doc_id, {MARKDOWN_SQL} AS t FROM documents)""",
    "md_title": f"""SELECT doc_id, coalesce(trim(list_filter(list_zip({HEADERS_SQL.format(1)}, {HEADERS_SQL.format(2)}), lambda z: z[1] = '#')[1][2]), 'stem' || doc_id) AS title
  FROM (SELECT doc_id, {MARKDOWN_SQL} AS t FROM documents)""",
    "md_frontmatter": f"""SELECT doc_id, starts_with(t, '---') AS has_frontmatter, contains(t, '```') AS has_code_blocks,
  md5(regexp_replace(t, '(?s)\\A---\\n.*?\\n---\\n', '')) AS content_md5 FROM (SELECT doc_id, {MARKDOWN_SQL} AS t FROM documents)""",
    "text_line_count": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count FROM documents",
    "code_symbols": CODE_SYMBOLS_SQL,
    "code_imports": CODE_IMPORTS_SQL,
    "json_structure": JSON_STRUCTURE_SQL,
    "json_keys": "SELECT event_id, array_to_string(list_distinct(json_keys(props))[1:20], '|') AS keys FROM events",
    "pretty_json": """SELECT event_id, '{' || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  "' || k || '": ' || json_extract(props, '$."' || k || '"')), ',' || chr(10))
  || chr(10) || '}' AS content FROM events""",
    "doc_id_hash": "SELECT doc_id, substr(sha256(source || '/' || doc_id || ':2024-01-01:' || n_chars), 1, 16) AS hash FROM documents",
    "list_categories": "SELECT coalesce(lang, 'unknown') AS category, count(*) AS documents FROM documents GROUP BY 1",
    "list_documents": LIST_DOCUMENTS_SQL,
    "index_stats": f"WITH RECURSIVE {chunk_ctes()} SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM chunks) AS total_chunks",
    "incremental_new_docs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "hash_embed": HASH_EMBED_SQL,
    "decode_ignore": "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'x') AS content_md5 FROM documents",
}
