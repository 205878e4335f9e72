"""Language identification in two levels.

A linear support vector machine per pair of language families picks the
family first; within it, one machine per pair of languages (one-versus-one)
tells the close relatives apart.  Most votes win, equal ones by summed
margins.  Where there are more than a dozen families, such as lie near each
other are first told from the rest together.  Features are hashed letter n-grams (one to three) with word edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, on_workers, rows_of, table

FOLDS, HELD = 4, 2
SIZE = 4096
FEW = 16  # rows of a language, or all it has: a sample by hashes misses none of so many but once in 10^7
WIDEST = 12  # groups that one level tells apart
#: Families of some languages; any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}


def _in_words() -> np.ndarray:
    """Of every code point whether it belongs to words: all letters, and what else stands beyond ASCII but for signs, punctuation and pictures."""
    c = np.arange(0x110000)
    marks = (c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2C00)) & ~((c >= 0x3000) & (c < 0x3003)) & (c < 0x1F000)
    return marks | ((c >= 97) & (c <= 122)) | (np.array([chr(i).isalpha() for i in c]) & (c >= 128))


IN_WORDS = _in_words()


def features(text: str | None) -> np.ndarray:
    """A unit vector of square-rooted n-gram counts; zeros without letters."""
    c = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where(IN_WORDS[c], c, 32).astype(np.uint32)
    a, b, d = c[:-2], c[1:-1], c[2:]
    inner = b != 32
    one = b[inner] * np.uint32(2654435761)
    two = (a[inner] * np.uint32(40503) + b[inner]) * np.uint32(2246822519)
    three = (two ^ d[inner]) * np.uint32(3266489917)
    at = np.concatenate([one, two, three]) >> np.uint32(20)
    x = np.sqrt(np.bincount(at, minlength=SIZE).astype(np.float32))
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss for labels -1 and 1 (classes count alike), by accelerated gradients."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    xb = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    w = z = np.zeros(xb.shape[1], np.float32)
    rate, t = np.float32(1 / (1 + 4 * cost)), 1.0  # rows have length sqrt(2), weights sum to 1
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (xb @ z))
        g = z - 2 * cost * (xb.T @ (share * y * miss))
        new = z - rate * g
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = (new + (t - 1) / t2 * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), t2
    return w[:-1], float(w[-1])


@dataclass
class Level:
    """Machines for all pairs of some names."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, of: np.ndarray, names: list[str]) -> Level:
        pairs = list(combinations(range(len(names)), 2))
        got = []
        for i, j in pairs:
            rows = np.isin(of, (names[i], names[j]))
            got.append(fit_svm(x[rows], np.where(of[rows] == names[i], 1, -1).astype(np.float32)))
        return cls(names, pairs, np.array([w for w, _ in got], np.float32).reshape(-1, x.shape[1]), np.array([b for _, b in got]))

    def pick(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes, and a share of confidence in 0 to 1 from its margins."""
        if not self.pairs:
            return self.names[0], 1.0
        margin = self.weights @ x + self.bias
        votes, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (i, j), m in zip(self.pairs, margin):
            votes[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
        best = max(range(len(self.names)), key=lambda k: (votes[k], total[k], -k))
        own = [m if i == best else -m for (i, j), m in zip(self.pairs, margin) if best in (i, j)]
        return self.names[best], float(np.prod([1 / (1 + np.exp(-3 * m)) for m in own]))


@dataclass
class Model:
    """A level of groups of languages, and for each group of more than one language the level below."""

    level: Level
    below: dict[str, Model]
    alone: dict[str, str]  # languages of groups of one

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        return self.pick(features(text))

    def pick(self, x: np.ndarray) -> tuple[str, float]:
        name, p = self.level.pick(x)
        if name in self.alone:
            return self.alone[name], p
        lang, q = self.below[name].pick(x)
        return lang, p * q


def _alike(hearts: dict[str, np.ndarray], most: int) -> list[list[str]]:
    """Names in at most ``most`` groups, none of all names: those nearest to the same of some names that lie far apart."""
    names = sorted(hearts)
    seeds = [names[0]]
    while len(seeds) < most:
        seeds.append(min((n for n in names if n not in seeds), key=lambda n: (max(float(hearts[n] @ hearts[s]) for s in seeds), n)))
    groups: dict[str, list[str]] = {s: [] for s in seeds}
    for n in names:
        groups[n if n in groups else max(seeds, key=lambda s: float(hearts[n] @ hearts[s]))].append(n)
    return list(groups.values())


def grow(x: np.ndarray, y: np.ndarray, groups: dict[str, list[str]]) -> Model:
    """Machines between groups of languages, then within each; levels have at most ``WIDEST`` groups."""
    hearts = {v: x[y == v].mean(axis=0) for g in groups.values() for v in g}
    if len(groups) > WIDEST:
        means = {g: np.mean([hearts[v] for v in vs], axis=0) for g, vs in groups.items()}
        wider = [{g: groups[g] for g in part} for part in _alike(means, WIDEST)]
    else:
        wider = [{g: vs} for g, vs in groups.items()]
    named = {"+".join(part): part for part in wider}  # a family's name, or those of several
    of = {v: name for name, part in named.items() for vs in part.values() for v in vs}
    rows = np.isin(y, list(of))
    below, alone = {}, {}
    for name, part in named.items():
        langs = [v for vs in part.values() for v in vs]
        if len(langs) == 1:
            alone[name] = langs[0]
        else:
            below[name] = grow(x, y, part if len(part) > 1 else {v: [v] for v in langs})
    return Model(Level.fit(x[rows], np.array([of[v] for v in y[rows]], dtype=object), sorted(named)), below, alone)


def fit(docs: DataFrame, per_language: int = 600, most_rows: int = 8000, families: dict[str, str] = FAMILIES) -> Model | None:
    """Learns from rows outside fold ``HELD`` with a language and letters; None if there are none.

    Some ``per_language`` rows a language teach, and ``most_rows`` in all, or
    ``FEW`` of each where there are too many languages for that; every language
    is learned, so the model grows with their number.  Rows
    without an id teach nothing; repeated rows of an id and language teach
    once, by the least of their texts.
    """
    on_workers(docs.sparkSession)
    rows = docs.where((fold("doc_id", FOLDS) != HELD) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").alias("y"), "text")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    chosen = bounded_sample(rows, "y", min(per_language, max(FEW, most_rows // len(sizes))), sizes)
    texts = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, part in rows_of(batches, "doc_id", "y", "text"):
            cols = [pa.array(ids, pa.int64()), pa.array(ys, pa.string()), pa.array([features(t).astype(np.float16).tobytes() for t in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "x"])

    got = texts.mapInArrow(run, "doc_id long, y string, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    if not got:
        return None
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    y = np.array([r["y"] for r in got], dtype=object)
    groups: dict[str, list[str]] = {}
    for v in sorted(set(y)):
        groups.setdefault(families.get(v, v), []).append(v)
    return grow(x, y, groups)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per row of ``docs``; ``und`` with score 0 for null texts and such without letters, or where nothing could be learned.

    Very long texts are read whole; equal votes go by summed margins, then by
    name; repeated rows are told each; an empty table gives no rows; other
    columns are ignored.
    """
    shared = on_workers(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, part in rows_of(batches, "doc_id", "held_out", "text"):
            m: Model | None = shared.value
            got = [m.predict(t) if m else ("und", 0.0) for t in part]
            cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([g for g, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from their ``lang``; edge cases as in ``fit`` and ``predicted``."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
