"""Quality by ordinal regression on graded ratings.

A cumulative-link model: one weight per hashed text feature, shared by all
grades, and ordered thresholds between them, so that
``P(grade > k) = sigmoid(x . w - threshold_k)``.  It gives the expected grade
and the probability of the upper tail, by which rows are selected.  Features
are relative frequencies of hashed words, of word shapes (upper, lower, digits
and marks) and of repetition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, few, fold, on_workers, rows_of, table

FOLDS = 5
SIZE = 4096
_SHAPE = bytes(
    ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"([xX9])\1+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and values; empty for texts without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n = len(words)
    shapes = Counter(_RUNS.sub(rb"\1", raw.translate(_SHAPE)).split())
    out: dict[int, float] = {}
    for prefix, counts, scale in ((b"s", shapes, 2.0), (b"w", Counter(raw.lower().split()), 1.0)):
        for w, c in counts.items():
            at = zlib.crc32(prefix + w) % (SIZE - 2)
            out[at] = out.get(at, 0.0) + scale * (c / n) ** 0.5
    out[SIZE - 2] = 2.0 * (sum(a == b for a, b in zip(words, words[1:])) / n) ** 0.5
    lines = raw.split(b"\n")
    out[SIZE - 1] = 2.0 * (1 - len(set(lines)) / len(lines)) ** 0.5
    at = np.fromiter(out, np.int32, len(out))
    return at, np.fromiter(out.values(), np.float32, len(out))


@dataclass
class Ordinal:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every grade but the highest, falling."""
        at, x = features(text)
        return 1 / (1 + np.exp(-(float(self.weights[at] @ x) - self.thresholds)))

    def expected(self, above: np.ndarray) -> float:
        return float(self.grades[0] + np.diff(self.grades) @ above)


def fit_ordinal(x: np.ndarray, y: np.ndarray, w: np.ndarray, grades: list[float], steps: int = 150, decay: float = 1e-5) -> Ordinal:
    """Weighted maximum likelihood with a small ridge, by Adam on the whole sample; ``y`` counts grades from 0."""
    levels = len(grades) - 1
    rng = np.arange(levels)
    shares = np.array([(w * (y > k)).sum() / w.sum() for k in rng]).clip(1e-3, 1 - 1e-3)
    first = -np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = np.concatenate([np.zeros(x.shape[1]), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    w = (w / w.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        d = x.shape[1]
        th = np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))
        up = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(-(x @ p[:d].astype(np.float32))[:, None] + th)), np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        lo, hi = up[at, y], up[at, y + 1]  # P(grade >= y), P(grade > y)
        like = np.maximum(lo - hi, 1e-9)
        slo, shi = lo * (1 - lo), hi * (1 - hi)
        gz = -w * (slo - shi) / like
        gth = np.zeros(levels)
        np.add.at(gth, np.maximum(y - 1, 0), np.where(y > 0, w * slo / like, 0))
        np.add.at(gth, np.minimum(y, levels - 1), np.where(y < levels, -w * shi / like, 0))
        tail = np.cumsum(gth[::-1])[::-1]
        g = np.concatenate([x.T @ gz.astype(np.float32) + decay * p[:d], tail[:1], tail[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    th = np.cumsum(np.concatenate([p[x.shape[1] : x.shape[1] + 1], np.exp(p[x.shape[1] + 1 :])]))
    return Ordinal(grades, p[: x.shape[1]], th)


def _graded(marks: DataFrame, most_grades: int) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """``marks`` with ``y`` counting grades from 0, the grades' values, and how many rows each has.

    More than ``most_grades`` different values become that many grades of
    about as many rows each, valued at their mean.
    """
    values = [r["grade"] for r in marks.select("grade").distinct().orderBy("grade").limit(most_grades + 1).collect()]
    cuts = values[1:]
    if len(values) > most_grades:
        wanted = [i / most_grades for i in range(1, most_grades)]
        cuts = sorted(set(marks.agg(F.percentile_approx("grade", wanted, 10_000).alias("c")).first()["c"]))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("grade")))
    marks = marks.withColumn("y", at)
    got = marks.groupBy("y").agg(F.avg("grade").alias("value"), F.count("*").alias("n")).collect()
    return marks.drop("grade"), {r["y"]: r["value"] for r in got}, {r["y"]: r["n"] for r in got}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_grade: int = 2000, held: int = 0, most_grades: int = 20, most_rows: int = 8000) -> Ordinal | None:
    """A model of labelled rows outside fold ``held``; None with fewer than two grades.

    Some ``per_grade`` rows a grade teach, and ``most_rows`` in all.  Rows whose
    id, grade or text is null or whose grade isn't finite teach nothing; of
    several grades for one id the lowest counts, of several texts the least, so
    that repeated rows teach once.  Grades may be fractions.
    """
    on_workers(docs.sparkSession)
    grade = F.col(label).cast("double")
    marks = labels.where(F.col("doc_id").isNotNull() & grade.isNotNull() & ~F.isnan(grade) & (F.abs(grade) < float("inf")) & (fold("doc_id", FOLDS) != held))
    marks = marks.groupBy("doc_id").agg(F.min(grade).alias("grade"))
    marks, values, totals = _graded(marks, most_grades)
    if len(totals) < 2:
        return None
    chosen = bounded_sample(marks, "y", min(per_grade, most_rows // len(totals)), totals)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part, ys in rows_of(batches, "doc_id", "text", "y"):
            got = [features(t) for t in part]
            cols = [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "at", "x"])

    rows = texts.mapInArrow(run, "doc_id long, y int, at binary, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["at"])))
    sizes = Counter(r["y"] for r in rows)
    grades = sorted(sizes)
    if len(grades) < 2:
        return None
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    y = np.array([grades.index(r["y"]) for r in rows])
    w = np.array([totals[r["y"]] / sizes[r["y"]] for r in rows])
    return fit_ordinal(x, y, w, [values[g] for g in grades])


def scored(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """A row per row of ``docs``: expected grade, probability of the highest grade, the selection by it.

    Null and empty texts have no features and get what the thresholds say;
    very long ones are read whole.  Texts that tie get equal figures, repeated
    rows are told each, an empty table gives no rows, other columns are
    ignored.  Without a model the figures are null and every row is selected.
    """
    shared = on_workers(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ordinal | None = shared.value
        for ids, held, part in rows_of(batches, "doc_id", "held_out", "text"):
            up = [m.above(t) if m else None for t in part]
            cols = [
                pa.array(ids, pa.int64()),
                pa.array(held, pa.bool_()),
                pa.array([m.expected(u) if m else None for u in up], pa.float64()),
                pa.array([float(u[-1]) if m else None for u in up], pa.float64()),
                pa.array([bool(u[-1] >= 0.5) if m else True for u in up], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "expected_grade", "tail_probability", "selected"])

    schema = "doc_id long, held_out boolean, expected_grade double, tail_probability double, selected boolean"
    return docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "text").mapInArrow(run, schema)


def kept(docs: DataFrame, model: Ordinal | None, at: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose probability of the highest grade is under ``at``; same columns, also ones named like the operator's own.

    Null, empty and very long texts, ties, repeated rows and empty tables are
    as in ``scored``; without a model all rows stay.
    """
    if model is None:
        return docs
    shared = on_workers(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([bool(shared.value.above(t)[-1] >= at) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from ``labels.quality``; edge cases as in ``fit`` and ``scored``."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
