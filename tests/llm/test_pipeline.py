import os
import zlib
from collections import Counter

import numpy as np
import pytest

from test_neardup import brute, sets_of
from test_secrets import brute as secrets_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def cleaned(text):
    """Every span replaced, those that overlap as one, in plain Python."""
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secrets_of(text).split(",") if s)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:] if spans else text


def pieces_of(text, library):
    ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_stages_against_plain_python(spark):
    """Each stage on what its predecessor left, worked out again row by row; the two classifiers by their own scores of each text."""
    import corpus_pipeline
    import public_tokenizers
    from tidemark.llm import quality, toxicity
    from tidemark.llm.common import table
    from tokenizers import Tokenizer

    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).persist()
        seen.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in new.collect()]))
        assert stage is corpus_pipeline.STAGES[-1][1] or new.columns == documents.columns
        docs = new
    ids = [({r["doc_id"] for r in a}, {r["doc_id"] for r in b}) for a, b in seen]
    votes = toxicity.fit(documents, labels)
    assert ids[0][1] == {r["doc_id"] for r, (score, _) in zip(seen[0][0], votes.of([r["text"] for r in seen[0][0]])) if score < 0.5} != ids[0][0]
    model = quality.fit(documents, labels)
    assert ids[1][1] == {r["doc_id"] for r in seen[1][0] if model.above(r["text"])[-1] >= 0.5} != ids[1][0]
    want = brute([(r["doc_id"], r["text"]) for r in seen[2][0]], 5, 80)
    assert ids[2][1] == {i for i, (_, c) in want.items() if i == c} != ids[2][0]
    assert {r["doc_id"]: r["text"] for r in seen[3][1]} == {r["doc_id"]: cleaned(r["text"]) for r in seen[3][0]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = seen[4][1]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted((r["doc_id"], *p) for r in seen[4][0] for p in pieces_of(r["text"], library))
    fill = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    again = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_stages_at_the_edge(spark, documents, clashing, edges, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, other columns, and an empty table, stage by stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [*edges, (9, "token = abcdefgh12 of this text here"), (9, "token = abcdefgh12 of this text here"), (9, "another text of the same id as before")]
    odd = documents(rows).withColumns({c: F.when(F.col("doc_id") != 3, F.col(c)) for c in ("lang", "source", "n_chars")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet")
    known.write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.write.parquet(f"{tmp_path}/b/labels.parquet")
    for sf_dir in (str(tmp_path), f"{tmp_path}/b"):
        docs = clashing(odd)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir).persist()
            if name == "packing":
                assert out.count() >= docs.count()
                break
            assert out.columns == docs.columns, name
            before, after = Counter((r["doc_id"], r["text"]) for r in docs.collect()), Counter((r["doc_id"], r["text"]) for r in out.collect())
            if name == "near-duplicates":
                assert all(n == 1 for (i, t), n in after.items() if i is not None and sets_of(t, 5)) and {(i, t) for i, t in before if i is None or not sets_of(t, 5)} <= set(after)
                assert {t for i, t in before if i == 9} == {t for i, t in after if i == 9}
            elif name == "secrets":
                assert after == Counter({(i, cleaned(t)): n for (i, t), n in before.items()})
            else:
                assert all(before[k] == n for k, n in after.items())
                if sf_dir == str(tmp_path):
                    assert after == before  # nothing to learn from
            docs = out
        empty = odd.limit(0)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, sf_dir).collect() == [], name


def test_entry_lists_every_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names
