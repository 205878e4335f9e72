import hashlib
import random
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    found |= names
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made(seed, n=60, vocabulary=9):
    rng = random.Random(seed)
    names = ["the", "The", "of", "é", "日本", "x1", "_", "a-b", "Zed", "q"][:vocabulary]
    phrase = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choice(names) for _ in range(rng.randrange(most)))
    items = [(rng.choice([None, *range(8)]), phrase(16)) for _ in range(20)] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for i in range(n):
        parts = [phrase(30), rng.choice(items)[1] or "", phrase(30), rng.choice(items)[1] or ""]
        docs.append((i // 2, " ".join(parts)))
    return docs, items


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [1, 3, 10])
def test_against_plain_python(spark, documents, clashing, edges, seed, width):
    docs, items = made(seed)
    docs += edges
    got = decontam.contaminated(clashing(documents(docs)).repartition(3), spark.createDataFrame(items, ITEMS), width)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items"]
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(docs, items, width)


def test_small_shards_and_blocks_change_nothing(spark, documents, monkeypatch):
    docs, items = made(7, 80)
    monkeypatch.setattr(decontam, "SHARD", 300)
    monkeypatch.setattr(decontam, "STEP", 5)
    index = decontam.build(documents(docs))
    assert index.count() > 10
    found = decontam.matches(index, spark.createDataFrame(items, ITEMS), 3, block=4)
    hits = {(r["shard"], r["seat"]): (r["n_hit"], r["items"]) for r in decontam.hit_words(found).collect()}
    got = [(k, n, *hits.get((row["shard"], i), (0, []))) for row in index.collect() for i, (k, n) in enumerate(zip(row["keys"], row["n_words"]))]
    assert sorted(got, key=repr) == plainly(docs, items, 3)


def test_each_shard_is_stored_and_sent_alone(spark, documents, monkeypatch):
    """Rows of several MB: a row group or a batch of many of them takes memory in proportion to a task's input."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(decontam, "SHARD", 300)
    monkeypatch.setattr(decontam, "ROW_GROUP", 64)
    docs, items = made(4)
    index = decontam.build(documents(docs).coalesce(1))
    groups = [m.row_group(i).num_rows for f in glob.glob(index._saved_at.removeprefix("file://") + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = []
    monkeypatch.setattr(decontam, "saved", lambda df, *a, **b: sizes.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    decontam.matches(index, spark.createDataFrame(items, ITEMS))
    assert sizes == ["1"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_index_holds_every_token(documents):
    docs = [(1, "b a b"), (2, None), (3, "c, A!")]
    (row,) = decontam.build(documents(docs).coalesce(1)).collect()
    lists = {t: row["positions"][a:b] for t, (a, b) in zip(row["terms"], pairwise(row["starts"]))}
    # one position is free behind every text: 3 behind the first, 4 for the one without words
    assert lists == {"b": [0, 2], "a": [1, 6], "c": [5]}
    assert (row["keys"], row["n_words"]) == ([1, 2, 3], [3, 0, 2])


def test_phrases_do_not_cross_texts(spark, documents):
    items = spark.createDataFrame([(1, "one two three")], ITEMS)
    got = decontam.contaminated(documents([(1, "x one two"), (2, "three y"), (3, "one two three")]).coalesce(1), items)
    assert {r["doc_id"]: r["n_hit"] for r in got.collect()} == {1: 0, 2: 0, 3: 3}


def shortest(text, window, within):
    """Whether some ``within`` consecutive words hold all of a window's."""
    return any(set(window) <= set(text[i : i + within]) for i in range(len(text)))


@pytest.mark.parametrize("seed", range(4))
def test_proximity_against_plain_python(spark, documents, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(40)]
    items = [(i, " ".join(rng.sample("abcdefgh", 4))) for i in range(12)]
    index = decontam.build(documents(docs).coalesce(1))
    keys = index.first()["keys"]
    found = decontam.matches(index, spark.createDataFrame(items, ITEMS), 4, within=6).where("kind = 'near'").collect()
    text = {i: words(t) for i, t in docs}
    for r in found:
        window, held = words(dict(items)[r["item"]]), text[keys[r["seat"]]]
        assert set(window) <= set(held[r["start"] : r["end"]])
    want = {(i, k) for i, t in text.items() for k, x in items if shortest(t, words(x), 6)}
    assert {(keys[r["seat"]], r["item"]) for r in found} == want


def test_frequent_words_in_steps():
    """A window of one frequent word has as many possible starts as the word has places; they are taken a step at a time."""
    texts = pa.array(["the " * 5_000, "of the the of " * 100])
    p = decontam.postings(texts)
    shard = decontam.Shard(p["terms"], p["starts"], p["positions"], p["n_words"], 10)
    windows = decontam.Windows.of([(1, "the " * 10), (2, "the of of the"), (3, "absent the")], 10)
    _, start = shard.phrases(windows)
    assert len(start) == 4_991 + 99
    assert len(np.unique(start)) == len(start)


def test_query(spark, documents, tmp_path):
    docs, items = made(11)
    docs += [(500, None), (None, "The of the"), (501, "")]
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = decontam.op11_decontamination(spark, str(tmp_path)).collect()
    want = [(i, n, hit, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), hit > 0) for i, n, hit, x in plainly(docs, items)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(documents([]), none).collect() == []
    assert decontam.contaminated(documents([]), spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []
    assert [tuple(r) for r in decontam.contaminated(documents([(1, "a b")]), none).collect()] == [(1, 2, 0, [])]
