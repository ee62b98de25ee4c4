"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of excerpts of its
labelled documents.  A text's letters are compressed with every dictionary,
block by block and whole, and the language whose dictionary leaves the fewest
bytes wins.  Where the runner-up comes close, a slower level with a better
search decides; where it comes nearly as close there too, the text is rejected.

Scale: the dictionaries are the only thing sent to tasks; prediction is one
narrow pass.  The fit reads ids and labels to draw its sample, then the texts
of the drawn rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .workers import release

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    """Lower-case words of letters, one blank before and after each."""
    return f" {' '.join(WORD.findall(text.lower()))} ".encode()



def fit_dictionaries(
    labelled: DataFrame,
    *,
    sample_docs: int = 160,
    excerpt_chars: int = 4096,
    dictionary_bytes: int = 98_304,
    max_languages: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows.

    The sample is bounded: ``sample_docs`` rows of each language, those whose id
    hashes lowest, and of each an excerpt of ``excerpt_chars`` characters from a
    place that the hash picks.  All excerpts of a language get equal shares of
    its ``dictionary_bytes``.  Rows with null labels or without text don't count.
    Raises ValueError beyond ``max_languages`` labels.  No rows: no dictionaries.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull()).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    names = [r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not names:
        return {}
    # a language may hold most rows: first the lowest of each of many shares, then of those
    keys = rows.filter(F.col("text") != "").select("lang", "id", "h")
    by_share = Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h", "id")
    by_lang = Window.partitionBy("lang").orderBy("h", "id")
    drawn = keys.withColumn("k", F.row_number().over(by_share)).filter(F.col("k") <= sample_docs)
    drawn = drawn.withColumn("k", F.row_number().over(by_lang)).filter(F.col("k") <= sample_docs).select("lang", "id")
    place = F.pmod("h", F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1)))
    excerpt = F.substr("text", (place + 1).cast("int"), F.lit(excerpt_chars))
    # sample_docs rows for each of max_languages at most
    picked = rows.join(F.broadcast(drawn.distinct()), ["lang", "id"]).select("lang", "h", excerpt.alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    made = {}
    for lang in sorted(parts):
        own = sorted(set(parts[lang]))[:sample_docs]
        share, spare, pieces = dictionary_bytes // len(own), 0, []
        for _, text in sorted(own, key=lambda p: len(p[1])):  # what short excerpts leave goes to longer ones
            raw = letters_of(text)[: share + spare]
            spare += share - len(raw)
            pieces.append(raw)
        made[lang] = b"".join(pieces)
    return made


@functools.lru_cache(maxsize=8)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard as z

    made = []
    for _, raw in dictionaries:
        data = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        made.append(z.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def classify_text(
    text: str | None, dictionaries: tuple[tuple[str, bytes], ...], *, levels: tuple[int, ...] = (3, 12), close: float = 0.1, min_margin: float = 0.02, block_bytes: int = 4096
) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text.

    score: the share of the runner-up's bytes that the winner saves, 0 to 1, at
    the first of ``levels`` where that is over ``close``, else at the last.
    Rejected: the score is under ``min_margin``.  Ties go to the name that sorts
    first.  Null, empty or letterless texts, and any text where there are no
    dictionaries: ("und", 0, rejected).
    """
    if not dictionaries or not has_letter(text):
        return UNDETERMINED, 0.0, True
    raw = letters_of(text)
    blocks = [raw[at : at + block_bytes] for at in range(0, len(raw), block_bytes)]
    for level in levels:
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for c, (lang, _) in zip(_compressors(dictionaries, level), dictionaries, strict=True))
        score = 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]
        if score > close:
            break
    return sizes[0][1], score, score < min_margin


def classify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    *,
    levels: tuple[int, ...] = (3, 12),
    close: float = 0.1,
    min_margin: float = 0.02,
    block_bytes: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, lang_pred, score, rejected; with ``keep``, these columns of
    the input instead of doc_id.  ``names`` names the last three, which must not
    clash with those kept (ValueError).  See :func:`classify_text` for nulls, empty
    texts and ties.  A row for each row, repeated ones too; an empty table gives
    none.  Texts longer than a block are the sum of their blocks.
    """
    if set(names) & set(keep or []):
        raise ValueError(f"names {names} clash with kept columns")
    known = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))  # fit_dictionaries bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [classify_text(t, known.value, levels=levels, close=close, min_margin=min_margin, block_bytes=block_bytes) for t in part.column(text_at).to_pylist()]
                langs, scores, rejected = zip(*made, strict=True)
                yield pa.record_batch(
                    [*part.columns[first:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*part.schema.names[first:], *names],
                )
        _compressors.cache_clear()
        release()

    first, text_at = 1, 0  # columns from the first on are returned
    if keep is None:
        rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("doc_id"))
    elif text_col in keep:  # texts go to the workers once
        rows, first, text_at = docs.select(*[docs[c] for c in keep]), 0, keep.index(text_col)
    else:
        rows = docs.select(F.col(text_col).alias("__text"), *[docs[c] for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[first:])
    return rows.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
