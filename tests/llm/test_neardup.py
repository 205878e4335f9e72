import random
import re

import numpy as np
import pytest

from tidemark.llm import neardup

WORDS = re.compile(r"[^ \t-\r]+")


def sets_of(text, width):
    w = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, width, percent):
    sets = [(i, sets_of(t, width)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, families=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    docs = []
    for f in range(families):
        base = [word() for _ in range(rng.randrange(3, 120))]
        docs.append(" ".join(base))
        for _ in range(copies):
            t = base[:]
            for _ in range(rng.randrange(1 + len(t) // 12)):
                t[rng.randrange(len(t))] = word()
            docs.append(" ".join(t).upper() if rng.random() < 0.2 else "\t".join(t))
            if f % 3 == 0:
                base = t  # a chain of copies of copies
    rng.shuffle(docs)
    return list(enumerate(docs + docs[:5], 10))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_as_by_brute_force(documents, clashing, width, percent):
    docs = corpus(width)
    want = brute(docs, width, percent)
    rows = neardup.near_duplicates(clashing(documents(docs)), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert any(r["n_links"] for r in rows) and sum(not r["kept"] for r in rows) > 20


def test_edges(documents, edges):
    rows = neardup.near_duplicates(documents(edges), 3, 85).collect()
    assert len(rows) == len(edges)
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 7)] == [0, 0, 0, 1, 1, 1]
    assert all(got[i]["component_id"] == i and got[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 7, 8))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert neardup.near_duplicates(documents([])).collect() == []


def test_kept_leaves_one_of_each(documents, clashing, edges):
    docs = [*edges, (20, "a b c d e f g"), (21, "a b c d e f g"), (22, "A b c  d e f g")]
    df = clashing(documents(docs))
    out = neardup.kept(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 7, 8, 20]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for n in (30, 400, 3000):
        for share in (0.5, 0.85, 0.95):
            both = int(2 * n * share / (1 + share))
            pool = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = neardup.registers(a), neardup.registers(b)
            c = neardup.chance(np.array([n]), np.array([n]))[0]
            exact = both / (2 * n - both)
            assert abs(((x == y).mean() - c) / (1 - c) - exact) < 0.17
            assert 0 < c < 0.01


def test_hubs_and_rarest_meet_in_large_buckets(documents):
    """A star: copies that are like their base only, in one bucket of every band."""
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    docs = [(500, " ".join(base))]
    for k in range(80):
        t = base[:]
        for _ in range(5):
            t[rng.randrange(200)] = "x%d" % rng.randrange(10**6)
        docs.append((k, " ".join(t)))
    want = brute(docs, 3, 85)
    rows = neardup.near_duplicates(documents(docs), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_one_id_with_different_texts_loses_no_text(documents):
    docs = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (1, "a b c d e f g h"), (2, "p q r s t u v w"), (3, "A B c d e f g h"), (4, "alone in this table it is")]
    out = neardup.kept(documents(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (4, "alone in this table it is")]


def test_components_of_a_long_chain(spark):
    n = 700
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([tuple(sorted((order[i], order[i + 1]))) for i in range(n - 1)], "a long, b long")
    assert {r["label"] for r in neardup.components(links).collect()} == {0}


def test_bands_follow_the_threshold():
    assert [neardup.band_width(p) for p in (60, 80, 85, 100)] == [2, 4, 4, 8]
    with pytest.raises(ValueError):
        neardup.band_width(5)
    assert 80 <= neardup.least_matches(85) <= 85 and neardup.least_matches(100) == 128


def test_recall_on_the_documents_table(spark):
    """Every pair at the threshold of a whole table, by brute force over shared shingles."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute(docs, 3, 85)
    rows = neardup.op6_hyperminhash(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
