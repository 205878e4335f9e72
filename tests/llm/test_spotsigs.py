import hashlib
import random

from tidemark.llm import spotsigs


def edited(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {}
    for k, (i, t) in enumerate(docs):
        q, nxt = len(t) // 4, docs[(k + 1) % len(docs)][1]
        out.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def run(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return spotsigs.op9_spotsigs(spark, str(tmp_path)).collect()


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "is", "to"]) if rng.random() < 0.4 else "w%d" % rng.randrange(400) for _ in range(n))


def test_edited_texts_and_likeness(spark, documents, clashing, tmp_path, edges):
    rng = random.Random(2)
    docs = edges + [(100 + 3 * k, prose(rng, rng.randrange(5, 200))) for k in range(1200)]
    docs += [(9001, docs[-1][1])]
    rows = run(spark, clashing(documents(docs)), tmp_path)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {i: sorted(v) for i, v in got.items()} == edited(docs)
    for r in rows:
        a, b = ({x[k : k + 16] for k in range(0, len(x), 16)} for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    by = {r["doc_id"]: r for r in rows}
    assert by[9001]["fingerprint"] == by[docs[-2][0]]["fingerprint"]
    long_ = [r for r in rows if r["n_chars"] > 400 and r["doc_id"] and r["doc_id"] >= 100]
    assert sum(r["near_edited"] for r in long_) / len(long_) > 0.4
    assert sum(r["near_next"] for r in long_) / len(long_) < 0.1


def test_one_row_and_none(spark, documents, tmp_path):
    rows = run(spark, documents([(5, "abcdefgh")]), tmp_path / "a")
    assert rows[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert run(spark, documents([]), tmp_path / "b") == []


def test_similar_pairs_as_by_brute_force(spark):
    rng = random.Random(4)
    sets = []
    for k in range(60):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(1, 40))]
        sets.append(base)
        for _ in range(2):
            sets.append(sorted(set(base[: max(1, len(base) - rng.randrange(3))] + [rng.randrange(10**6) for _ in range(rng.randrange(3))])))
    sets += [[], [], sets[0]]
    rows = [(k, sorted(set(s))) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, sigs array<long>")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in spotsigs.similar_pairs(df, 0.8).collect()}
    first = {}
    for k, s in rows:
        first.setdefault(tuple(s), k)
    want = {}
    reps = [(k, set(s)) for s, k in first.items() if s]
    for x, (i, a) in enumerate(reps):
        for j, b in reps[x + 1 :]:
            s = len(a & b) / len(a | b)
            if s >= 0.8:
                want[min(i, j), max(i, j)] = s
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_python_in_the_plan(spark, documents, tmp_path):
    documents([(1, "the a b c"), (2, "of x y z")]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = spotsigs.op9_spotsigs(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_without_anchors(spark, documents, tmp_path):
    """Edits of a text without any common word keep most of its signatures; equal texts have equal ones."""
    rng = random.Random(7)
    text = " ".join("слово%d" % rng.randrange(10**6) for _ in range(300))
    rows = run(spark, documents([(1, text), (2, text), (3, "одно слово"), (4, " ")]), tmp_path)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1
    assert by[2]["near_edited"] > 0.6 and by[4]["fingerprint"] == "" and len(by[3]["fingerprint"]) == 16
