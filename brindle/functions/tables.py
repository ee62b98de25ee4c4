"""Table functions for SQL.

    register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 1000, 200) c")

The DataFrame form, :func:`brindle.functions.chunking.chunks`, stays in the JVM
and is the one to use on large tables.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .chunking import BREAKS, ZONE


@functools.lru_cache(maxsize=8)
def window_pattern(size: int) -> re.Pattern:
    """One window: all that is left if it fits, else up to the last break of the best kind in the last part, else ``size`` characters."""
    if size < 1:
        raise ValueError("a chunk has a character at least")
    skip = int(size * ZONE)
    breaks = [f".{{{skip},{size - len(b)}}}{re.escape(b)}" for b in BREAKS if size - len(b) >= skip]
    return re.compile("|".join([rf".{{1,{size}}}\Z", *breaks, f".{{{size}}}"]), re.DOTALL)


class ChunkText:
    """Rows (chunk_index, start_char, end_char, content) of one text; blank windows take no index."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        one, at, index = window_pattern(size), 0, 0
        while window := one.match(text or "", at):
            if content := window[0].strip():
                yield index, *window.span(), content
                index += 1
            at = max(window.end() - overlap, 0)
            if at <= window.start():
                at = window.end()


def register(spark: SparkSession) -> None:
    """Make ``chunk_text(text, size, overlap)`` known to SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, start_char int, end_char int, content string"))
