import random

import pytest

CLASHING = "row string, h string, id string, n string, sig string, node string, token string, part string, score string, rejected string, block string, epoch string, position string, b string, words string, hash string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def table(spark, rows, partitions=3):
    """documents out of (doc_id, text, lang, source), with columns that clash with names inside the operators."""
    extra = (None,) * len(CLASHING.split(", "))
    full = [(i, t, lang, s, len(t) if t is not None else None, *extra) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


SYLLABLES = {"en": "the of and ing tion er th he an re".split(), "de": "sch ich der die und ung ein keit ver ge".split(), "fr": "eau que les oi et ment ou aux é è".split()}


def prose(rng, lang, words):
    make = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    return " ".join(make() + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(words))


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with every trouble: nulls, empty, blank, very long, repeated, tied, non-BMP, no letters."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang := rng.choice(["en", "de", "fr"]), rng.randint(60, 200)), lang, f"s{i % 3}") for i in range(40)]
    same = prose(rng, "en", 90)
    rows += [
        (100, None, "en", "s0"),
        (101, "", None, None),
        (102, " \n\t ", "de", None),
        (103, "one", None, "s1"),
        (104, "123 456 !!", "fr", "s2"),
        (105, prose(rng, "en", 30_000), "en", "s0"),
        (106, same, "en", "s1"),
        (106, same, "en", "s1"),
        (107, same, None, "s2"),
        (None, prose(rng, "de", 70), "de", "s1"),
        (None, None, None, None),
        (108, "😀 é́ İ ß  x <|endoftext|> " * 30, "fr", "s2"),
        (109, "a\x00b c " * 40, "en", "s2"),
    ]
    return rows


@pytest.fixture(scope="session")
def messy_docs(spark, messy):
    return table(spark, messy).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
