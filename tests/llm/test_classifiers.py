import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity
from tidemark.llm.common import letter_words


def prose(rng, n, extra=()):
    return " ".join(rng.choice(extra) if extra and rng.random() < 0.1 else rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz") for _ in range(n))


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        bad, poor = i % 6 == 0, i % 4 == 0
        t = prose(rng, rng.randrange(10, 80), ("idiot", "scum") if bad else ())
        docs.append((i, t.upper().replace(" ", "!! ") if poor else t))
        labels.append((i, int(not poor), int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def held(i, parts=5, part=0):
    return zlib.crc32(str(i).encode()) % parts == part


def test_toxicity_on_held_out_rows(spark, documents, clashing, marked, edges):
    docs, labels = marked
    more = [(10_000 + (i or 0), t) for i, t in edges]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (77777, 1, 1), (10_007, None, None)], LABELS)
    df = clashing(documents(docs + more))
    index = toxicity.fit(df, marks)
    rows = toxicity.scored(df, index).collect()
    assert len(rows) == len(docs) + len(more)
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] >= 10_000)
    kept = {r["doc_id"] for r in toxicity.kept(df, index).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}
    assert toxicity.kept(df, index).columns == df.columns


def test_labels_of_the_held_fold_teach_nothing(spark, documents, marked):
    docs, labels = marked
    df = documents(docs)
    other = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a = toxicity.scored(df, toxicity.fit(df, spark.createDataFrame(labels, LABELS))).orderBy("doc_id").collect()
    b = toxicity.scored(df, toxicity.fit(df, spark.createDataFrame(other, LABELS))).orderBy("doc_id").collect()
    assert a == b


def test_calibration_keeps_the_order_of_votes():
    """Votes all far below even odds, as large groups of copies give them: whole Newton steps overshoot and make the scores 0 and 1."""
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1], [2000, 400])
    votes = np.where(y[:, None] == 1, -5.0, -7.5) + rng.normal(0, 0.8, (len(y), 2))
    index = toxicity.Index(np.arange(len(y)), y, np.where(y == 1, 1.0, 7.5), {}, np.zeros(0))
    model = toxicity.Votes(index, index, np.zeros(0, np.int32))
    model.judged = lambda rows, without=None: (votes[without], [])
    model.calibrate([()] * len(y))
    score = model.score(votes)
    bad, good = score[y == 1], score[y == 0]
    assert (model.curve[:2] > 0).all() and np.abs(model.curve).max() < 1000
    assert (bad[:, None] > good[None, :]).mean() > 0.95 and np.mean((score >= 0.5) == y) > 0.9


def test_nearest_are_exact():
    rng = random.Random(8)
    vocabulary = {b"w%d" % i: i for i in range(60)}
    index = toxicity.Index(np.arange(500), np.array([i % 2 for i in range(500)]), np.ones(500), vocabulary, np.linspace(0.5, 3, 60), block=16, k=10)
    vectors = [{rng.randrange(60): rng.randrange(1, 5) for _ in range(rng.randrange(0, 9))} for _ in range(500)]
    vectors = [(np.array(list(v), int), np.array(list(v.values()), int)) for v in vectors]
    index.build(vectors)
    at, term, w = index.vectors(vectors)
    dense = np.zeros((500, 60))
    dense[at, term] = w
    queries = [{rng.randrange(60): rng.randrange(1, 5) for _ in range(rng.randrange(0, 12))} for _ in range(100)]
    queries = [(np.array(list(v), int), np.array(list(v.values()), int)) for v in queries]
    at, term, w = index.vectors(queries)
    x = np.zeros((100, 60))
    x[at, term] = w
    for words in (1024, 20, 0):  # all words dense, some, none
        index.dense, index.laid = words, None
        for without in (None, np.arange(100)):
            got = index.nearest(queries, without)
            for i, q in enumerate(x):
                want = sorted((-round(c, 12), n) for n, c in enumerate(dense @ q) if c > 1e-15 and (without is None or n != i))[:10]
                assert [(-round(c, 12), n) for c, n in got[i]] == want
    assert index.nearest([]) == []


def test_blocks_of_similar_examples_are_passed_over():
    rng = random.Random(2)
    topics = [range(k * 40, k * 40 + 40) for k in range(8)]
    rows = [(np.array(rng.sample(topics[n % 8], 9)), np.ones(9, int)) for n in range(800)]
    index = toxicity.Index(np.arange(800), np.zeros(800, int), np.ones(800), {}, np.ones(320), block=20)
    index.build(rows)
    index.nearest(rows[:64])
    assert index.read < index.pairs / 3


def test_every_word_of_the_examples_counts(spark, documents, marked):
    """Evidence is the nearest by cosine over all words, rare and unmarked ones too."""
    docs, labels = marked
    docs = [(i, f"{t} own{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}") for i, t in docs]
    df = documents(docs)
    index = toxicity.fit(df, spark.createDataFrame(labels, LABELS)).whole
    of = {i: Counter(letter_words(t)) for i, t in docs}
    examples = [i for i, _ in docs if not held(i)]
    words = {w for i in examples for w in of[i]}
    assert set(index.vocabulary) == words
    idf = {w: np.log((1 + len(docs)) / (1 + sum(w in c for c in of.values()))) + 1e-9 for w in words}
    vec = {i: {w: (1 + np.log(k)) * idf[w] for w, k in c.items() if w in words} for i, c in of.items()}
    vec = {i: {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in vec.items()}
    for r in toxicity.scored(df, toxicity.fit(df, spark.createDataFrame(labels, LABELS))).where("doc_id < 40").collect():
        cos = sorted(((-round(sum(x * vec[e].get(w, 0) for w, x in vec[r["doc_id"]].items()), 12), e) for e in examples))[:3]
        assert [int(x.split(":")[0]) for x in r["evidence"].split(",")] == [e for _, e in cos]
        assert [float(x.split(":")[2]) for x in r["evidence"].split(",")] == pytest.approx([-c for c, _ in cos], abs=1e-4)


def test_nothing_to_learn_from(spark, documents, marked):
    df, none = documents(marked[0][:20]), spark.createDataFrame([], LABELS)
    assert toxicity.fit(df, none) is None and quality.fit(df, none) is None and language.fit(documents([])) is None
    assert {r["score"] for r in toxicity.scored(df, None).collect()} == {0.0}
    assert toxicity.kept(df, None).count() == quality.kept(df, None).count() == 20
    assert {r["selected"] for r in quality.scored(df, None).collect()} == {True}
    assert {(r["lang_pred"], r["score"]) for r in language.predicted(df, None).collect()} == {("und", 0.0)}
    assert toxicity.scored(documents([]), None).collect() == quality.scored(documents([]), None).collect() == []


def test_quality_on_held_out_rows(spark, documents, clashing, marked, edges):
    docs, labels = marked
    df = clashing(documents(docs + [(10_000 + (i or 0), t) for i, t in edges]))
    model = quality.fit(df, spark.createDataFrame([*labels, (None, 0, 0), (10_007, None, None)], LABELS))
    rows = quality.scored(df, model).collect()
    truth = {i: q for i, q, _ in labels}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["selected"] == bool(truth[r["doc_id"]]) for r in out]) > 0.97
    assert all(0 <= r["tail_probability"] <= 1 and abs(r["expected_grade"] - r["tail_probability"]) < 1e-9 for r in rows)
    kept = quality.kept(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["selected"]}


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    z = x @ np.array([2, -1, 0, 0, 1, 0]) + rng.logistic(size=900) * 0.3
    y = np.digitize(z, [-2, 0, 1.5])
    m = quality.fit_ordinal(x, y, np.ones(900), [1, 2, 3, 5], steps=400)
    assert np.all(np.diff(m.thresholds) > 0)
    up = 1 / (1 + np.exp(-((x @ m.weights)[:, None] - m.thresholds)))
    assert np.all(np.diff(up, axis=1) <= 0)
    grade = np.array([m.expected(u) for u in up])
    assert np.corrcoef(grade, np.array([1, 2, 3, 5])[y])[0, 1] > 0.85


def test_language(documents, clashing, edges):
    rng = random.Random(6)
    stock = {"en": "the of and that with from this have", "de": "der die und nicht mit auf sich ein", "fr": "le la les dans pour avec une que", "es": "el los las para con una que del"}
    docs = [(i, " ".join(rng.choice(stock[v].split()) for _ in range(rng.randrange(5, 40))), v) for i, v in enumerate(list(stock) * 60)]
    docs += [(500 + i, t, None) for i, (_, t) in enumerate(edges)]
    df = clashing(documents(docs))
    rows = {r["doc_id"]: r for r in language.predicted(df, language.fit(df)).collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert np.mean([rows[i]["lang_pred"] == v for i, _, v in docs[:240] if held(i, 4, 2)]) > 0.95
    assert [rows[500 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and {r["lang_pred"] for r in rows.values()} <= {*stock, "und"}


def test_words():
    assert letter_words("The IDIOT's 2nd über-Haus.") == [b"the", b"idiot", b"s", b"nd", "über".encode(), b"haus"] and letter_words(None) == []


def test_quality_as_by_brute_force(spark, documents, marked):
    """The query's figures from features, examples and sums worked out one by one."""
    docs, labels = marked
    grades = spark.createDataFrame([(i, q + 0.5 * (i % 3), t) for i, q, t in labels], "doc_id long, quality double, toxic int")
    df = documents(docs + docs[:30])
    model = quality.fit(df, grades, per_grade=10_000)
    assert model.grades == [0.0, 0.5, 1.0, 1.5, 2.0]
    learned = [(i, q + 0.5 * (i % 3)) for i, q, _ in labels if not held(i)]
    x = np.zeros((len(learned), quality.SIZE), np.float32)
    for n, (i, _) in enumerate(learned):
        raw = docs[i][1].encode()
        words, shapes = raw.lower().split(), []
        for w in raw.split():
            shape = "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c for c in w.decode())
            shapes.append("".join(c for k, c in enumerate(shape) if not (k and c == shape[k - 1] and c in "xX9")).encode())
        for mark, found, scale in ((b"s", shapes, 2), (b"w", words, 1)):
            for w, c in Counter(found).items():
                x[n, zlib.crc32(mark + w) % (quality.SIZE - 2)] += scale * (c / len(words)) ** 0.5
        x[n, quality.SIZE - 2] = 2 * (sum(a == b for a, b in zip(raw.split(), raw.split()[1:])) / len(words)) ** 0.5
    again = quality.fit_ordinal(x, np.array([model.grades.index(g) for _, g in learned]), np.ones(len(learned)), model.grades)
    want = {i: 1 / (1 + np.exp(-(float(again.weights @ v) - again.thresholds))) for (i, _), v in zip(learned, x)}
    for r in quality.scored(df, model).collect():
        if r["doc_id"] in want:
            up = want[r["doc_id"]]
            assert abs(r["tail_probability"] - up[-1]) < 1e-3 and abs(r["expected_grade"] - sum(0.5 * u for u in up)) < 3e-3


def test_many_grades_become_some(spark, documents, marked):
    docs, labels = marked
    grades = spark.createDataFrame([(i, float(i), 0) for i, _, _ in labels] + [(3, float("nan"), 0)], "doc_id long, quality double, toxic int")
    model = quality.fit(documents(docs), grades, most_grades=6)
    assert len(model.grades) == 6 and model.grades == sorted(model.grades) and 30 < model.grades[0] < 70
    assert np.all(np.diff(model.thresholds) > 0)


def test_long_words_differ_behind_their_start():
    a, b = (quality.features("q" * 80 + x) for x in "xy")
    assert set(a[0]) != set(b[0])


def test_language_as_by_brute_force(documents):
    """Votes and margins of all machines, counted one by one, over a table with three families."""
    rng = random.Random(11)
    langs = ["en", "de", "fr", "es", "fi"]
    stock = {v: ["".join(rng.choice("abcdefghijklmnop"[i : i + 9]) for _ in range(4)) for _ in range(9)] for i, v in enumerate(langs)}
    docs = [(i, " ".join(rng.choice(stock[langs[i % 5]]) for _ in range(12)), langs[i % 5]) for i in range(200)]
    df = documents(docs)
    model = language.fit(df)
    assert model.level.names == ["fi", "germanic", "romance"]

    def vote(level, x):
        wins, sums = Counter(), Counter()
        for (i, j), w, b in zip(level.pairs, level.weights, level.bias):
            m = float(np.dot(w, x)) + float(b)
            wins[level.names[i if m >= 0 else j]] += 1
            sums[level.names[i]] += m
            sums[level.names[j]] -= m
        return max(level.names, key=lambda n: (wins[n], sums[n]))

    for r in language.predicted(df, model).collect():
        x = language.features(docs[r["doc_id"]][1])
        group = vote(model.level, x)
        assert r["lang_pred"] == (model.alone.get(group) or vote(model.below[group].level, x))


def test_more_languages_than_one_level_holds(documents):
    rng = random.Random(12)
    names = [f"l{k:02d}" for k in range(40)]
    stock = {v: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(5)] for v in names}
    docs = [(i, " ".join(rng.choice(stock[names[i % 40]]) for _ in range(15)), names[i % 40]) for i in range(1200)]
    df = documents(docs)
    model = language.fit(df, most_rows=1000)
    assert len(model.level.names) <= language.WIDEST
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(df, model).collect()}
    assert np.mean([got[i] == v for i, _, v in docs]) > 0.9


def test_every_language_is_learned(documents):
    """However many languages there are to few rows, none is left out."""
    rng = random.Random(13)
    names = [f"m{k:03d}" for k in range(70)]
    stock = {v: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3)] for v in names}
    docs = [(i, " ".join(rng.choice(stock[names[i % 70]]) for _ in range(12)), names[i % 70]) for i in range(70 * 9)]
    df = documents(docs)
    model = language.fit(df, most_rows=70)

    def learned(m):
        return set(m.alone.values()).union(*(learned(b) for b in m.below.values()))

    assert learned(model) == set(names)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(df, model).collect()}
    assert len(set(got.values())) == 70 and np.mean([got[i] == v for i, _, v in docs]) > 0.8


def test_letters_beyond_the_basic_plane_count(documents):
    rare = {"zh": "\U00020000\U00020001\U0002a700 ", "osa": "\U000104b0\U000104b1\U000104b2 "}
    for text in (*rare.values(), "\u207f\u2102"):
        assert all(map(str.isalpha, text.strip())) and language.features(text).any()
    assert not language.features("\U0001f600 \u2192 \u2014 12 !").any()
    docs = [(i, (rare["zh"] if i % 2 else rare["osa"]) * (1 + i % 3), "zh" if i % 2 else "osa") for i in range(60)]
    df = documents(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(df, language.fit(df)).collect()}
    assert got == {i: v for i, _, v in docs}


def test_samples_are_bounded_and_alike(spark):
    from tidemark.llm.common import bounded_sample

    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id < 50 then 'b' else 'c' end as y")
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    got = {r["y"]: r["n"] for r in bounded_sample(df, "y", 500, sizes).groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got["b"] == 33 and all(500 - 140 < got[y] < 500 + 140 for y in "ac")
    assert bounded_sample(df, "y", 500, sizes).exceptAll(bounded_sample(df.repartition(7), "y", 500, sizes)).isEmpty()
    assert bounded_sample(df, "y", 500, {}).isEmpty()
