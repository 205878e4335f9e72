import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import phrases


def plainly(docs, most=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            gone |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= percent * found[lang, p[i : i + k]]}
    out = []
    for lang in {k[0] for k in found}:
        rows = []
        for (g, p), a in found.items():
            if g == lang and (g, p) not in gone:
                score, k = min((1_000_000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    names = ["the", "The", "of", "é", "日本", "x1", "a-b", "\xa0q", "b'", "🙂"]
    weights = [9, 3, 6, 3, 3, 2, 2, 1, 1, 1]
    out = []
    for _ in range(n):
        text = "".join(rng.choices(names, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "?!"]) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "de", "und", None])))
    return out


@pytest.fixture
def table(documents):
    return lambda rows: documents([(i, t, g) for i, (t, g) in enumerate(rows)])


@pytest.mark.parametrize("seed, most, least, percent, top", [(1, 3, 10, 50, 2000), (2, 3, 3, 50, 2000), (3, 2, 5, 50, 7), (4, 5, 4, 30, 2000), (5, 4, 10, 0, 2000)])
def test_against_plain_python(table, clashing, edges, seed, most, least, percent, top):
    rows = made(seed) + [(t, "en") for _, t in edges]
    got = phrases.collocations(clashing(table(rows)).repartition(3), most, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plainly(rows, most, least, percent, top)


def test_small_shards_change_nothing(table, monkeypatch):
    rows = made(9)
    monkeypatch.setattr(phrases, "SHARD", 200)
    assert sorted(map(tuple, phrases.collocations(table(rows)).collect())) == plainly(rows)


def test_nothing_to_find(table):
    assert phrases.collocations(table([])).collect() == []
    assert phrases.collocations(table([(None, "en"), ("", "en"), (" \t ,", None), ("a b", "en")])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 6))
def test_suffix_array_and_counts(numbers, most):
    sequence = np.array(numbers, np.int64)
    padded = numbers + [0] * most
    order = phrases.suffix_array(sequence, most)
    keys = [padded[i : i + most] for i in order]
    assert sorted(order.tolist()) == list(range(len(numbers))) and keys == sorted(keys)
    for n, place, count in phrases.phrase_counts(sequence, most):
        want = Counter(tuple(padded[i : i + n]) for i in range(len(numbers)) if 0 not in padded[i : i + n])
        assert dict(zip((tuple(padded[p : p + n]) for p in place), count.tolist())) == want


def test_exact_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 9_000_000_011, 7_000_000_001
    rows = [("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a), ("en", 0, "", 10**11)]
    found = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    (row,) = phrases.scored(found, 3).collect()
    assert tuple(row) == ("en", 2, "x y", a, 1_000_000 * a * a // (left * right), left, right)


def test_ties_of_cuts_go_to_the_shorter_first_part(spark):
    rows = [("en", 1, "x", 20), ("en", 1, "z", 20), ("en", 2, "x y", 20), ("en", 2, "y z", 20), ("en", 3, "x y z", 20)]
    found = spark.createDataFrame([*rows, ("en", 1, "y", 20)], "lang string, words int, phrase string, f long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in phrases.scored(found, 3).collect()}
    assert got["x y z"] == (20, 20, 1_000_000)


def test_query(spark, table, tmp_path):
    rows = made(12)
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, phrases.op12_collocations(spark, str(tmp_path)).collect())) == plainly(rows)
