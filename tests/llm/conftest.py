import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [f"{a}{b}{c}" for a in ("ka", "to", "mi", "ser") for b in ("lo", "ne", "ru") for c in ("", "s", "ta")]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (".\n" if x % 11 == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; ids from 1, or as given."""

    def make(texts, ids=None, sources=None):
        ids = ids or range(1, len(texts) + 1)
        sources = sources or ["src0"] * len(texts)
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and blank texts, repeated rows, copies, a very long text."""
    base = prose(1, 60)
    texts = [base, base, base + " end", None, "", " \n\t ", "one two", prose(2, 80), prose(2, 80), "x" * 50_000, prose(3, 30_000), "password = abc123XYZ9 café\nkey"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, None]
    return make_docs(texts, ids, ["a", "a", None, "b", "a", "a", "a", "c", "c", "d", "a", "a"])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
