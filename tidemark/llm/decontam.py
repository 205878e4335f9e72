"""Benchmark passages in training documents, by a positional inverted index.

``build`` cuts the documents into shards of bounded size and stores, of every
shard, each term with the list of its positions: all tokens of all documents,
in Parquet, one row a shard.  ``matches`` looks for passages of test items: in
each shard a window's terms are put in order of how often the shard has them,
the positions of the rarest, less its place in the window, are the possible
starts, and these are intersected with the lists of the next rarest term and so
on; one binary search over (term, position) pairs does so for all windows at
once.  Words are compared as bytes, so a match is an exact phrase.  With
``within`` also passages that hold all words of a window, in any order, in so
many consecutive words are told.

Neither step shuffles tokens: an index row is made where its documents are read
and searched where it is read.  Shards are bounded, so a frequent word's list
is; a test set of any size is searched in blocks of ``BLOCK`` words, the only
part of it that the driver and a task hold at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import LOWER, by_size, utf8, words
from .common import on_workers, rows_at_once, saved, table

WIDTH = 10
SHARD = 4 << 20  # bytes of text in a shard; a longer text is a shard of its own
ROW_GROUP = 1 << 20  # each shard is a row group of its own, so that one is written, read and sent at once
BLOCK = 200_000  # words of test items searched for at once
STEP = 1 << 21  # possible starts held at once
_WORDY = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words lie before each text (and in all), and the words: A-Z lowered, all but ASCII letters, digits and what is beyond ASCII parts them."""
    data, offsets = utf8(column)
    _, before, found = words(LOWER[data], offsets, _WORDY)
    return before, found


def postings(column: pa.Array) -> dict:
    """The index of one shard: terms, where the list of each begins, and all positions, one position left free behind every text."""
    before, found = tokens(column)
    coded = found.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    count = np.diff(before)
    at = np.arange(len(code)) + np.repeat(np.arange(len(count)), count)
    starts = np.zeros(len(coded.dictionary) + 1, np.int64)
    np.cumsum(np.bincount(code, minlength=len(coded.dictionary)), out=starts[1:])
    return {"n_words": count, "terms": coded.dictionary, "starts": starts, "positions": at[np.argsort(code, kind="stable")]}


def build(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of ``docs``, written to the shared folder: ``shard``, and arrays ``keys``, ``n_words``, ``terms``, ``starts``, ``positions``.

    Every row has its place, those of null texts (no words), null keys and equal
    keys too.
    """
    on_workers(docs.sparkSession)
    name = docs.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, b in enumerate(by_size(batches, "text", SHARD)):
            row = {"keys": b.column("key")} | postings(b.column("text"))
            kinds = {"n_words": pa.int32(), "starts": pa.int32(), "positions": pa.int32(), "terms": pa.string()}
            lists = {}
            for k, v in row.items():
                v = v if isinstance(v, pa.Array) else pa.array(v)
                v = v.cast(kinds.get(k, v.type))
                lists[k] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([first + i], pa.int64())} | lists)

    shape = f"shard long, keys array<{name}>, n_words array<int>, terms array<string>, starts array<int>, positions array<int>"
    return saved(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(kernel, shape), "index", **{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})


@dataclass
class Windows:
    """Different windows of some test items: rows of places in ``terms``, -1 behind a short one's end, and the (window, item) pairs."""

    terms: pa.Array
    grid: np.ndarray
    window: np.ndarray
    item: np.ndarray
    names: list

    @classmethod
    def of(cls, items: list[tuple], width: int) -> Windows:
        before, found = tokens(pa.array([t for _, t in items], pa.string()))
        coded = found.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.diff(before)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + before[item]
        place = start[:, None] + np.arange(width)
        inside = place < before[item + 1][:, None]
        grid = np.where(inside, np.append(code, -1)[np.where(inside, place, len(code))], -1)
        grid, window = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.empty(0, np.int64))
        return cls(coded.dictionary, grid, window.ravel(), item, [x for x, _ in items])


class Shard:
    """The stored lists of one shard, as arrays; term and position together are in rising order."""

    def __init__(self, terms: pa.Array, starts: np.ndarray, positions: np.ndarray, n_words: np.ndarray, room: int):
        self.terms, self.starts, self.positions = terms, starts.astype(np.int64), positions.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + 1)])
        self.span = int(self.first[-1]) + 2 * room + 2
        self.held = np.diff(self.starts)
        self.pairs = np.repeat(np.arange(len(self.held)), self.held) * self.span + self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term * self.span + position
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return self.pairs[at] == wanted

    def next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The least position of the term that is not before ``position``; beyond all where there is none."""
        wanted = term * self.span + position
        at = np.searchsorted(self.pairs, wanted)
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)] - term * self.span
        return np.where((at < len(self.pairs)) & (found < self.span) & (found >= position), found, 2 * self.span)

    def grids(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose terms the shard has, and those rows with the shard's own term numbers."""
        code = pc.fill_null(pc.index_in(windows.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.where(windows.grid < 0, -1, code[windows.grid])
        whole = np.flatnonzero(((own >= 0) | (windows.grid < 0)).all(axis=1))
        return whole, own[whole]

    def rarest_first(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the places of its terms, rarest in the shard first, and how often each of those stands there."""
        held = np.where(grid < 0, np.iinfo(np.int64).max, self.held[grid])
        order = np.argsort(held, axis=1, kind="stable")
        return order, np.take_along_axis(held, order, axis=1)

    def starts_of(self, grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows at a time: each position of a row's rarest term as (row, place of the term in the row, position)."""
        order, held = self.rarest_first(grid)
        rows, upto = held[:, 0], np.cumsum(held[:, 0])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
            row = np.repeat(np.arange(at, end), rows[at:end])
            nth = np.arange(len(row)) - np.repeat(upto[at:end] - rows[at:end] - (upto[at - 1] if at else 0), rows[at:end])
            place = order[row, 0]
            yield row, place, self.positions[self.starts[grid[row, place]] + nth]
            at = end

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        whole, grid = self.grids(windows)
        if not len(whole):
            return whole, whole
        order, _ = self.rarest_first(grid)
        found = []
        for row, place, position in self.starts_of(grid):
            start = position - place
            row, start = row[start >= 0], start[start >= 0]
            for nth in range(1, grid.shape[1]):
                place = order[row, nth]
                term = grid[row, place]
                keep = (term < 0) | self.has(term, start + place)
                row, start = row[keep], start[keep]
            found.append((whole[row], start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def nearby(self, windows: Windows, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, end) of a shortest span of at most ``within`` words of one text around each position of the rarest term that holds all terms."""
        whole, grid = self.grids(windows)
        out = [(np.empty(0, np.int64),) * 3]
        for row, _, position in self.starts_of(grid) if len(whole) else ():
            for k in range(grid.shape[1]):
                least = np.maximum(position - within + 1, 0)
                keep = (grid[row, k] < 0) | (self.next(grid[row, k], least) < position + within)
                row, position = row[keep], position[keep]
            best = np.full(len(row), within + 1)
            start = np.zeros(len(row), np.int64)
            for back in range(within):
                left = position - back
                last = left.copy()
                for k in range(grid.shape[1]):
                    last = np.where((grid[row, k] < 0) | (left < 0), last, np.maximum(last, self.next(grid[row, k], np.maximum(left, 0))))
                fits = (left >= 0) & (self.text_of(np.maximum(left, 0)) == self.text_of(last)) & (last - left + 1 < best)
                best, start = np.where(fits, last - left + 1, best), np.where(fits, left, start)
            keep = best <= within
            out.append((whole[row[keep]], start[keep], (start + best)[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def told(self, windows: Windows, window: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
        """Spans of each text and item, those that touch made one: (text, item, start, end), in words of the text."""
        order = np.argsort(windows.window, kind="stable")
        by_window = np.searchsorted(windows.window[order], np.arange(len(windows.grid) + 1))
        many = np.diff(by_window)[window]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = windows.item[order[np.repeat(by_window[window], many) + nth]]
        start, end = np.repeat(start, many), np.repeat(end, many)
        order = np.lexsort((end, start, item))
        item, start, end = item[order], start[order], end[order]
        # A free position lies between texts, so spans of two texts never touch.
        far = item * (2 * self.span)
        reach = np.maximum.accumulate(far + end) if len(far) else far
        new = np.append(True, far[1:] + start[1:] > reach[:-1])[: len(far)]
        heads = np.flatnonzero(new)
        text = self.text_of(start[heads])
        tails = np.append(heads[1:], len(far))[: len(heads)] - 1
        return text, item[heads], start[heads] - self.first[text], reach[tails] - far[tails] - self.first[text]


def blocks(items: DataFrame, text: str, key: str, most: int) -> Iterator[list[tuple]]:
    """The test items in lists of some ``most`` characters at most; only one list is on the driver at a time."""
    held, size = [], 0
    for row in items.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).toLocalIterator():
        held.append((row["key"], row["text"]))
        size += len(row["text"])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(index: DataFrame, items: DataFrame, width: int = WIDTH, within: int | None = None, text: str = "text", key: str = "item_id", block: int = BLOCK) -> DataFrame:
    """``shard``, ``seat`` (the row's place in its shard), ``item``, ``kind``, ``start``, ``end``: spans of words that are occurrences of an item's windows.

    A window is ``width`` consecutive words of an item, an item of fewer words
    is one, one without words has none.  Spans of a text and an item that touch
    are one.  ``kind`` is ``phrase``; with ``within`` there are also rows of
    kind ``near``.  Items of one id, and those without an id, are each searched
    for.
    """
    spark = index.sparkSession
    name = items.schema[key].dataType.simpleString()
    shape = f"shard long, seat int, item {name}, kind string, start long, end long"
    parts = []
    for held in blocks(items, text, key, block * 6):
        shared = spark.sparkContext.broadcast(Windows.of(held, width))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            names = pa.array(windows.names)
            for b in batches:
                for i in range(b.num_rows):
                    row = {n: b.column(n).slice(i, 1).flatten() for n in ("terms", "starts", "positions", "n_words")}
                    lists = [row[n].to_numpy(zero_copy_only=False) for n in ("starts", "positions", "n_words")]
                    if not len(row["terms"]) or not len(windows.grid):
                        continue
                    shard = Shard(row["terms"], *lists, room=max(width, within or 0))
                    found = [("phrase", *shard.phrases(windows))]
                    lengths = (windows.grid >= 0).sum(axis=1)
                    found = [("phrase", w, s, s + lengths[w]) for _, w, s in found]
                    if within:
                        found.append(("near", *shard.nearby(windows, within)))
                    for kind, window, start, end in found:
                        seat, item, start, end = shard.told(windows, window, start, end)
                        n = len(seat)
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array(np.full(n, b.column("shard")[i].as_py())), "seat": pa.array(seat, pa.int32()), "item": names.take(pa.array(item)),
                            "kind": pa.array([kind] * n, pa.string()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()),
                        })

        with rows_at_once(spark, 1):
            parts.append(saved(index.select("shard", "terms", "starts", "positions", "n_words").mapInArrow(kernel, shape), "matches"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], shape)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def hit_words(found: DataFrame) -> DataFrame:
    """Of each text with a phrase its ``n_hit`` words inside any span and its ``items``, as texts in order (without an id: the empty text)."""
    found = found.where(F.col("kind") == "phrase")
    earlier = Window.partitionBy("shard", "seat").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    item = F.coalesce(F.col("item").cast("string"), F.lit(""))
    return found.withColumn("fresh", fresh).groupBy("shard", "seat").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(item)).alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_hit`` and ``items`` of every row of ``docs``.

    Null and empty texts have no words and no hit; repeated rows are told each;
    texts of any length are searched whole; columns beyond key and text are left
    out, so that none can clash; an empty table gives no rows, one without items
    no hits.
    """
    index = build(docs, text, key)
    hits = hit_words(matches(index, items, width))
    rows = index.select("shard", F.posexplode(F.arrays_zip("keys", "n_words")).alias("seat", "row"))
    rows = rows.select("shard", "seat", F.col("row.keys").alias(key), F.col("row.n_words").cast("long").alias("n_words"))
    rows = rows.join(hits, ["shard", "seat"], "left")
    return rows.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of ``documents`` inside ten-word windows of ``benchmark``; cases as in ``contaminated`` and ``matches``."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS m, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT k, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM v))),
o AS (SELECT DISTINCT s.k, s.i, s.m, v.item FROM s JOIN v ON s.g = v.g AND s.m = v.m),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT k, i, m FROM o)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM o) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
