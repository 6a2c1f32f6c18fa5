import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, node string, size string, copy string"


@pytest.fixture(scope="session")
def prose():
    """Invented sentences of a language, from a seed."""
    syllables = {"en": ["the", "ing", "on", "st", "wh", "er", "ea"], "de": ["sch", "ung", "ü", "keit", "ver", "zu"], "fr": ["eau", "é", "oi", "ment", "que"]}

    def make(seed, n=80, lang="en"):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."

    return make


@pytest.fixture
def table(spark):
    """A documents table with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls in every column, empty and blank texts, a very long text, one very long word, equal rows, equal ids."""
    a, b = prose(1), prose(2)
    return [
        (1, a, "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n", "en", ""), (None, prose(3), "en", "s1"),
        (None, None, None, None), (5, a, "en", "s2"), (6, b, "en", "s2"), (6, b, "en", "s2"), (7, a, None, None), (7, prose(4), "de", "s1"),
        (8, "\n".join(prose(s, 40) for s in range(400)), "en", "s1"), (9, "x" * 60000, "en", "s3"), (10, "中文 é  ß 😀", "fr", "s3"),
        (11, "one", "en", "s1"), (12, "the the the the the the", "en", "s1"),
    ]
