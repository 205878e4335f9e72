import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim

TEXTS = ["a\nb\nc\n", "a\nb\nc", "\n", "\n\n\n", "no line end", "é\n日本\n🙂 x\ny", "x <P> y\n", "<S\n>\n", "ends in <\nP>\n<", "<<P\n", "\r\nq\r\n", "tab\t\x00\nz", "l\n" * 20_000, "x" * 100_000 + "\n" + "y" * 9]


def plainly(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 30), (0, 50), (100, 0), (100, 100)])
def test_against_plain_python(documents, clashing, edges, percent, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12, 100)] + edges
    got = fim.fill_in_middle(clashing(documents(rows)), percent=percent, spm_percent=spm)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plainly(i, t, 7, percent, spm), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    if percent == 100 and spm == 50:
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query(spark, documents, tmp_path):
    rows = list(enumerate(TEXTS)) + [(None, "a\nb"), (3, None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = fim.op13_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(p := plainly(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(documents):
    assert fim.fill_in_middle(documents([])).collect() == []


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "y"), ("ab", "xaby", "z")])
def test_marks_that_cannot_be_told_apart(documents, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents([(1, "a")]), marks=marks)


def test_other_marks_and_text_keys(spark):
    marks = ("[p]", "(s)", "{m}.*")
    rows = [(f"k{i}", f"a{i}\nb(\nc[\nd\n") for i in range(50)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "k string, body string"), "body", "k", marks=marks)
    back = {r["k"]: r["back"] for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()}
    assert back == dict(rows)
