"""Parsers, keywords, categories and routes on hand-derived values."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import keywords as kw, text as tx


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    text = "Use CVE-2021-44228, -x- a--b rapid_api café Z"
    assert one(spark, text, tx.tokens) == ["use", "cve-2021-44228", "x", "a--b", "rapid", "api", "caf", "z"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("security/redteam/x.md", "redteam"),
        ("security/x.md", "security"),
        ("ctf/x.md", "general"),
        ("logscale/development.txt", "development"),
        ("myinsecurity.txt", "security"),
        ("Security\\CTF\\x.md", "ctf"),
    ],
)
def test_category(spark, path, want):
    assert one(spark, path, kw.category) == want


def test_keywords(spark):
    text = "Rapid scan of 10.0.0.1 with nmap, see CVE-2021-44228 and T1059.001"
    assert one(spark, text, kw.keywords) == ["10.0.0.1", "CVE-2021-44228", "T1059.001", "api", "nmap"]
    assert one(spark, " ".join(f"10.0.0.{i}" for i in range(6)), kw.keywords) == []
    assert one(spark, "XT12345", kw.keywords) == ["T1234"]


ROUTES = [
    ("RAPID response", None),
    ("c2 beacon", "redteam"),
    ("reverse shells", "redteam"),
    ("python api with cloudflare bypass and playwright", "development"),
    ("case{} x", None),
    ("case{}x", "logscale"),
]


@pytest.mark.parametrize(("query", "want"), ROUTES)
def test_route(spark, query, want):
    assert one(spark, query, kw.route) == want
    assert kw.route_text(query) == want


def test_markdown(spark):
    text = "---\nk: v\n---\n# One \n## Two\nx\n##\n\nfoo\n"
    assert [tuple(h) for h in one(spark, text, tx.md_headers)] == [(1, "One"), (2, "Two"), (2, "foo")]
    assert one(spark, text, lambda t: tx.md_title(tx.md_headers(t), F.lit("stem"))) == "One"
    assert one(spark, "no header", lambda t: tx.md_title(tx.md_headers(t), F.lit("stem"))) == "stem"
    assert one(spark, text, tx.has_front_matter)
    assert one(spark, text, tx.without_front_matter).startswith("# One")
    assert one(spark, "a\n---\nk: v\n---\n", tx.has_front_matter) is False


def test_code(spark):
    text = '"""Doc\nstring. """\nimport os\nX = 1\nfrom a import b\n\nclass A:\n    def m(self): pass\n\ndef f(x):\n    pass\n\nasync def g(): pass\n'
    assert one(spark, text, tx.docstring) == "Doc\nstring."
    assert one(spark, "x = 1", tx.docstring) is None
    assert one(spark, text, tx.py_functions) == ["f"]
    assert one(spark, text, tx.py_classes) == ["A"]
    # white space in the name list runs on to the next line
    assert one(spark, text, tx.py_imports) == ["import os\nX ", "from a import b\n\nclass A"]


def test_strip_and_names(spark):
    assert one(spark, "\u2003 a b\u00a0\n", tx.strip) == "a b"
    assert one(spark, "x/y.tar.gz", lambda p: tx.stem(tx.filename(p))) == "y.tar"
    assert one(spark, "x/.env", lambda p: tx.stem(tx.filename(p))) == ".env"
    assert one(spark, "/r/a/b.MD", lambda p: tx.extension(tx.filename(p))) == ".md"
    assert one(spark, "/r/a/b.md", lambda p: tx.relative_path(p, "/r")) == "a/b.md"
    assert one(spark, "/q/b.md", lambda p: tx.relative_path(p, "/r")) == "/q/b.md"
    assert one(spark, "a\nb\n", tx.line_count) == 3
    assert one(spark, '{"a": 1, "b": 2, "a": 3}', tx.json_keys) == ["a", "b"]
