"""Text expressions: tokens, file names, and what the parsers read out of content.

All are column expressions that Spark evaluates in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The patterns.
TOKEN = r"[a-z0-9][-a-z0-9]*[a-z0-9]|[a-z0-9]"
MD_HEADER = r"(?Umd)^(#{1,6})\s+(.+)$"
FRONT_MATTER = r"(?s)\A---\n.*?\n---\n"
DOCSTRING = r"""(?s)\A["']['"]{2}(.*?)["']['"]{2}"""
PY_FUNCTION = r"(?Umd)^def\s+(\w+)\s*\("
PY_CLASS = r"(?Umd)^class\s+(\w+)\s*[:\(]"
PY_IMPORT = r"(?Umd)^(?:from\s+[\w.]+\s+)?import\s+[\w.,\s]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def relative_path(path: Column, root: str) -> Column:
    """The part below ``root``, or the whole path outside of it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def document_id(path: Column, modified: Column, size: Column) -> Column:
    """16 hexadecimal digits that change with path, time of change and size."""
    return F.substring(F.sha2(F.concat_ws(":", path, modified.cast("string"), size.cast("string")), 256), 1, 16)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat_ws("_", doc_id.cast("string"), index.cast("string"))


def iso_time(ts: Column) -> Column:
    """Local ISO time; the fraction is left out when it is zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def md_headers(text: Column) -> Column:
    """(level, title) of each header line, in order."""
    marks = F.regexp_extract_all(text, F.lit(MD_HEADER), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(MD_HEADER), F.lit(2))
    return F.zip_with(marks, titles, lambda m, t: F.struct(F.length(m).alias("level"), strip(t).alias("title")))


def md_title(headers: Column, default: Column) -> Column:
    """The first header of level 1, or the default."""
    return F.coalesce(F.get(F.filter(headers, lambda h: h["level"] == 1), F.lit(0))["title"], default)


def has_code_blocks(text: Column) -> Column:
    return F.contains(text, F.lit("```"))


def has_front_matter(text: Column) -> Column:
    return text.rlike(FRONT_MATTER)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def docstring(text: Column) -> Column:
    """The module's docstring; null without one."""
    return F.when(text.rlike(DOCSTRING), strip(F.regexp_extract(text, DOCSTRING, 1)))


def py_functions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PY_FUNCTION), F.lit(1))


def py_classes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PY_CLASS), F.lit(1))


def py_imports(text: Column, most: int = 10) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(PY_IMPORT), F.lit(0)), 1, most)


def json_keys(text: Column, most: int = 20) -> Column:
    """The first keys of an object, each once, in the order of the text."""
    return F.slice(F.array_distinct(F.json_object_keys(text)), 1, most)
