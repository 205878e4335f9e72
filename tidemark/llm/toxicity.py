"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled rows (``per_label`` of each label).
All their words are the vocabulary, so it is bounded as well; inverse document
frequencies are counted over all documents.  Words that no example holds meet
nothing and count neither in a product nor in a length.  The examples' TF-IDF
vectors form an inverted index in blocks of similar examples with the largest
weight per word and block: a block is read only while its bound may still
reach the ``k`` nearest, so the nearest by cosine over all words are exact.
These are the evidence.  Texts go through the index in batches.

Two votes, each weighted by nearness and corrected for the sampling of labels,
make the score: that of the nearest by all words, and that of the nearest by
the words alone that go with a label (chi-square), as most words of a text say
nothing of it.  Lengths stay those over all words there, so that a text with a
single such word by chance is near to nothing.  A logistic curve over the log
odds of both, fitted to the examples' own leave-one-out votes, joins and
calibrates them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, few, fold, letter_words, on_workers, rows_of, saved, table, trim

FOLDS = 5
BATCH = 256  # texts that are scored at once
CERTAIN = 10.83  # chi-square of one in a thousand; for the second vote only
SCORED = "doc_id long, held_out boolean, score double, predicted int, evidence string"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one range behind the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


#: The different words of a text by number, and how often it has them.
Words = tuple[np.ndarray, np.ndarray]


@dataclass
class Index:
    """Examples in blocks of similar ones, with postings and largest weights by word and block.

    Postings (example number, weight) go by word.  From them each worker lays
    out, once, the ``dense`` words with most postings as a matrix, as batches
    of texts meet these fastest that way, and the largest weight that each of
    them has in each block.  Postings of the other words are short and are read
    whole, so a text's bound for a block is the largest sum there by those
    words plus what the largest weights allow for the rest.
    """

    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # how many rows of its label an example stands for
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    block: int = 64
    k: int = 15
    dense: int = 1024
    far: float = 0.2  # weight of the whole sample, as of one far vote
    at: np.ndarray | None = None  # postings: example numbers
    weight: np.ndarray | None = None
    first: np.ndarray | None = None  # first posting of each word, and the end
    place: np.ndarray | None = None  # of each example among the blocks
    laid: tuple | None = None
    read: int = 0  # pairs of text and block that had to be read, and all such pairs
    pairs: int = 0

    def vectors(self, rows: list[Words], lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and weight of vectors, one entry for each word of a row; unit vectors unless their ``lengths`` are given."""
        of = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows] or [np.zeros(0)]).astype(np.int64)
        w = (1 + np.log(np.concatenate([c for _, c in rows] or [np.zeros(0)]).astype(float))) * self.idf[term]
        norm = np.sqrt(np.bincount(of, w * w, minlength=len(rows))) if lengths is None else lengths
        return of, term, w / np.where(norm > 0, norm, 1)[of]

    def lengths(self, rows: list[Words]) -> np.ndarray:
        of, _, w = self.vectors(rows, np.ones(len(rows)))
        return np.sqrt(np.bincount(of, w * w, minlength=len(rows)))

    def build(self, rows: list[Words], lengths: np.ndarray | None = None) -> None:
        of, term, w = self.vectors(rows, lengths)
        order = np.lexsort((of, term))[: len(of)]
        self.at, self.weight = of[order].astype(np.int32), w[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.idf) + 1))
        self.place, self.laid = np.arange(len(rows)), None
        self.place = np.argsort(self._alike(), kind="stable").argsort()
        self.laid = None

    def _alike(self) -> np.ndarray:
        """A group number for each example, by a few rounds of spherical k-means over the dense words."""
        x = self._lay_out()[1][: len(self.ids)]
        many = max(1, len(x) // self.block)
        if many == 1:
            return np.zeros(len(x))
        heart = x[np.linspace(0, len(x) - 1, many).astype(int)]
        for _ in range(6):
            group = (x @ heart.T).argmax(axis=1)
            heart = np.zeros_like(heart)
            np.add.at(heart, group, x)
            heart /= np.maximum(np.linalg.norm(heart, axis=1), 1e-9)[:, None]
        return group

    def _lay_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column of each word (-1: not dense), matrix of places and dense words, largest weights by block, example at each place."""
        if self.laid is None:
            held = np.diff(self.first)
            words = np.sort(np.argsort(-held, kind="stable")[: self.dense])
            column = np.full(len(held), -1)
            column[words] = np.arange(len(words))
            blocks = max(1, -(-len(self.ids) // self.block))
            x = np.zeros((blocks * self.block, len(words)))
            post = _ranges(self.first[words], held[words])
            x[self.place[self.at[post]], np.repeat(np.arange(len(words)), held[words])] = self.weight[post]
            number = np.full(len(x), -1)
            number[self.place] = np.arange(len(self.place))
            self.laid = column, x, x.reshape(blocks, self.block, -1).max(axis=1), number
        return self.laid

    def __getstate__(self) -> dict:
        return self.__dict__ | {"laid": None}

    def nearest(self, rows: list[Words], without: np.ndarray | None = None, lengths: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each of a batch of texts the ``k`` nearest examples of positive cosine, equal ones by number.

        ``without`` names an example for each text that is to be left out.
        """
        if not rows or not len(self.ids):
            return [[] for _ in rows]
        column, x, most, number = self._lay_out()
        of, term, w = self.vectors(rows, lengths)
        many, places, blocks = len(rows), len(x), len(most)
        to = column[term]
        q = np.zeros((many, x.shape[1]))
        q[of[to >= 0], to[to >= 0]] = w[to >= 0]
        short = np.flatnonzero(to < 0)
        held = (self.first[term[short] + 1] - self.first[term[short]]).astype(np.int64)
        post = _ranges(self.first[term[short]], held)
        at = np.repeat(of[short], held) * places + self.place[self.at[post]]
        part = np.bincount(at, np.repeat(w[short], held) * self.weight[post], minlength=many * places).reshape(many, places)
        bound = part.reshape(many, blocks, self.block).max(axis=2) + q @ most.T
        order = np.argsort(-bound, axis=1, kind="stable")
        score = np.zeros((many, places))
        reach = np.zeros(bound.shape, dtype=bool)
        k = min(self.k, places)
        for turn in range(2):  # the likeliest blocks of each text, then all that are still in reach
            if turn == 0:
                np.put_along_axis(reach, order[:, :3], True, axis=1)
                wanted = reach & (bound > 0)
            else:
                least = np.partition(score, places - k, axis=1)[:, places - k] - 1e-11
                wanted = ~reach & (bound > 0) & (bound >= least[:, None])
            self.read += int(wanted.sum())
            for b in np.flatnonzero(wanted.any(axis=0)):
                who, here = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                score[who, here] = part[who, here] + q[who] @ x[here].T
            if without is not None:
                score[np.arange(many), self.place[without]] = 0
        self.pairs += bound.size
        least = np.maximum(np.partition(score, places - k, axis=1)[:, places - k] - 1e-11, 1e-15)
        out: list[list[tuple[float, int]]] = []
        for i in range(many):
            hits = np.flatnonzero(score[i] >= least[i])
            found = zip(score[i, hits].tolist(), number[hits].tolist())
            out.append(sorted(found, key=lambda f: (-round(f[0], 12), f[1]))[: self.k])
        return out

    def raw(self, near: list[tuple[float, int]]) -> float:
        """Share of the positive label among weighted votes, with the whole sample as one far vote."""
        base = (self.votes * self.labels).sum() / max(self.votes.sum(), 1e-9)
        weight = [(c * c * self.votes[n], self.labels[n]) for c, n in near]
        mean = self.votes.mean() if len(self.votes) else 1.0
        return (sum(w * y for w, y in weight) + self.far * mean * base) / (sum(w for w, _ in weight) + self.far * mean)


@dataclass
class Votes:
    """The index of all words, that of the surer ones, and the curve over the votes of both."""

    whole: Index
    sure: Index
    number: np.ndarray  # of a word among the sure ones (-1: it isn't one), by its number among all
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))

    def judged(self, rows: list[Words], without: np.ndarray | None = None) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        """For each of a batch of texts the log odds of the votes of both indexes, and its nearest by all words."""
        near = self.whole.nearest(rows, without)
        sure = self.sure.nearest(self.surer(rows), without, self.whole.lengths(rows))
        share = np.array([[self.whole.raw(a), self.sure.raw(b)] for a, b in zip(near, sure)]).reshape(-1, 2).clip(1e-4, 1 - 1e-4)
        return np.log(share / (1 - share)), near

    def surer(self, rows: list[Words]) -> list[Words]:
        numbered = [(self.number[t], c) for t, c in rows]
        return [(t[t >= 0], c[t >= 0]) for t, c in numbered]

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.curve[:2] + self.curve[2], -500, 500)))

    def of(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text, in batches of ``BATCH``."""
        for i in range(0, len(texts), BATCH):
            votes, near = self.judged([_counts(t, self.whole.vocabulary) for t in texts[i : i + BATCH]])
            yield from zip(self.score(votes).tolist(), near)

    def calibrate(self, rows: list[Words]) -> None:
        """Fits the curve to the votes that the examples get from all others."""
        parts = [self.judged(rows[i : i + BATCH], np.arange(i, min(i + BATCH, len(rows))))[0] for i in range(0, len(rows), BATCH)]
        x = np.concatenate([np.concatenate(parts), np.ones((len(rows), 1))], axis=1)
        y, w = self.whole.labels.astype(float), self.whole.votes / self.whole.votes.sum()
        prior = c = self.curve

        def loss(c: np.ndarray) -> float:
            z = x @ c
            return float(w @ (np.logaddexp(0, z) - y * z) + 5e-5 * ((c - prior) ** 2).sum())

        for _ in range(100):  # Newton, with a prior that keeps the slopes finite and positive; a step that overshoots is halved until the loss falls
            p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
            g = x.T @ (w * (p - y)) + 1e-4 * (c - prior)
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
            step, now = np.linalg.solve(h, g), loss(c)
            while loss(c - step) >= now and np.abs(step).max() > 1e-9:
                step = step / 2
            if np.abs(step).max() <= 1e-9:
                break
            c = c - step
        if np.isfinite(c).all() and c[:2].sum() > 0:
            self.curve = c


def _counts(text: str | None, vocabulary: dict[bytes, int]) -> Words:
    got = Counter(map(vocabulary.get, letter_words(text)))
    got.pop(None, None)
    return np.fromiter(got, np.int32, len(got)), np.fromiter(got.values(), np.int32, len(got))


def _document_frequencies(texts: DataFrame, words: Broadcast) -> np.ndarray:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        total = np.zeros(len(known), dtype=np.int64)
        for (part,) in rows_of(batches, "text"):
            for t in part:
                seen = set(map(known.get, letter_words(t)))
                seen.discard(None)
                total[list(seen)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])

    got = texts.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words.value))
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 2000, held: int = 0) -> Votes | None:
    """Indexes of labelled rows outside fold ``held``; None if they lack one of the labels.

    Rows whose id, label or text is null teach nothing; of several labels for
    one id the highest counts, of several texts the least, so that repeated
    rows teach once.  Very long texts are examples whole.
    """
    spark = on_workers(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != held))
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("y"))
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(marks, "y", per_label, totals)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = saved(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "examples", 2 * per_label, 500)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ys in rows_of(batches, "text", "y"):
            got = [(w, y) for t, y in zip(part, ys) for w in sorted(set(letter_words(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()), pa.array([y for _, y in got], pa.int32())], ["w", "y"])

    sizes = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    df = examples.mapInArrow(words, "w binary, y int").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n")).orderBy("w").toArrow()
    vocabulary = {w: i for i, w in enumerate(df.column("w").to_pylist())}
    known = spark.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part, ys in rows_of(batches, "doc_id", "text", "y"):
            got = [_counts(t, known.value) for t in part]
            flat = [pa.array([x[i].tobytes() for x in got], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), *flat], ["doc_id", "y", "terms", "counts"])

    rows = sorted(examples.mapInArrow(counted, "doc_id long, y int, terms binary, counts binary").collect(), key=lambda r: (r["doc_id"], bytes(r["terms"])))

    counts = [(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows]
    seen, n = _document_frequencies(docs, known), docs.count()
    ys = np.array([r["y"] for r in rows])
    about = np.array([r["doc_id"] for r in rows]), ys, np.array([totals[y] / sizes[y] for y in ys])
    whole = Index(*about, vocabulary, np.log((1 + n) / (1 + seen)) + 1e-9)
    one, zero = float(sizes[1]), float(sizes[0])
    a, held_by = (df.column(x).to_numpy().astype(float) for x in ("a", "n"))
    b = held_by - a
    chi = (a * (zero - b) - b * (one - a)) ** 2 * (one + zero) / np.maximum(held_by * (one + zero - held_by) * one * zero, 1)
    chosen_words = np.flatnonzero((chi > CERTAIN) & (held_by >= 4))
    number = np.full(len(vocabulary), -1, np.int32)
    number[chosen_words] = np.arange(len(chosen_words))
    votes = Votes(whole, Index(*about, {}, whole.idf[chosen_words], far=0.02), number)
    votes.whole.build(counts)
    votes.sure.build(votes.surer(counts), whole.lengths(counts))
    votes.calibrate(counts)
    whole.laid = votes.sure.laid = None  # workers lay out their own
    known.destroy()
    trim()
    return votes


def scored(docs: DataFrame, index: Votes | None) -> DataFrame:
    """A row per row of ``docs``; without an index (nothing to learn from) scores are 0.

    Null and empty texts have no neighbours and get the score of a text
    without any word of the vocabulary; very long ones are read whole.  Ties
    between neighbours go to the example of the smaller id.  Repeated rows are
    told each, an empty table gives no rows, other columns are ignored.
    """
    spark = on_workers(docs.sparkSession)
    model = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Votes | None = model.value
        for ids, held, part in rows_of(batches, "doc_id", "held_out", "text"):
            scores, evidence = [], []
            for score, near in ix.of(part) if ix else [(0.0, [])] * len(part):
                scores.append(score)
                evidence.append(",".join(f"{ix.whole.ids[n]}:{ix.whole.labels[n]}:{c:.4f}" for c, n in near[:3]))
            cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "text").mapInArrow(run, SCORED)


def kept(docs: DataFrame, index: Votes | None, at: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``at`` or more; same columns, also ones named like the operator's own.

    Null, empty and very long texts, ties, repeated rows and empty tables are
    as in ``scored``; without an index all rows stay.
    """
    if index is None:
        return docs
    model = on_workers(docs.sparkSession).sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Votes = model.value
        for b in few(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([score < at for score, _ in ix.of(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from ``labels.toxic``; edge cases as in ``fit`` and ``scored``."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
