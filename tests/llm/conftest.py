import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing():
    """Adds columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "row piece start length blob found sigs n c regs bucket label _part _next shard rank score held_out".split()

    def add(df):
        return df.withColumns({n: F.lit("x") for n in names})

    return add


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "two words"), (6, "Ünï 日本 🙂 é"), (7, "word " * 30_000), (None, "no id here"), (8, "x" * 50_000)]


@pytest.fixture
def edges():
    return list(EDGES)
