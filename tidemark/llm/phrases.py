"""Phrases whose words stand together more often than they would by chance.

Documents are cut into shards of bounded size.  In each shard words become
numbers, the numbers of all pieces (texts cut at punctuation) one sequence with
a zero behind every piece, and numpy sorts its suffixes by prefix doubling as
far as the longest phrase asked for.  Neighbours in that order share their
longest common prefix, so the phrases of n words are the intervals in which it
is n or more, and an interval's length is the count.  The counts of all shards
are added up by key, an ordinary grouped sum; scores are exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import LOWER, by_size, utf8, words
from .common import on_workers, saved, shuffles_dropped, table

SHARD = 6 << 20  # bytes of text in a shard; a longer text is a shard of its own
_WORDY = np.array([b not in b" \t.,;:!?\n\x0b\x0c\r" for b in range(256)])
_PARTS = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``sequence`` in the order of the ``depth`` numbers from each on (zeros behind the end), by prefix doubling."""
    rank, known = sequence.astype(np.int64), 1
    order = np.argsort(rank)
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - step] = rank[step:]
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(pair)
        rank = np.empty_like(pair)
        rank[order] = np.cumsum(np.append(True, np.diff(pair[order]) != 0)[: len(pair)])
        known += step
    return order


def phrase_counts(sequence: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1 to ``most``: (n, a place of each phrase of n numbers without a zero, how often it stands there)."""
    order = suffix_array(sequence, most)
    padded = np.append(sequence, np.zeros(most, sequence.dtype))
    same = np.ones(len(order), bool)  # with the suffix before: as many first numbers
    whole = np.ones(len(order), bool)
    same[:1] = False
    for n in range(1, most + 1):
        number = padded[order + n - 1]
        same[1:] &= number[1:] == number[:-1]
        whole &= number != 0
        heads = np.flatnonzero(~same)
        counts = np.diff(np.append(heads, len(order)))
        keep = whole[heads]
        yield n, order[heads[keep]], counts[keep]


def shard_counts(column: pa.Array, langs: pa.Array, orders: range) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of so many words in the texts of one shard, keyed ``phrase<tab>language``; a phrase of no words counts all words."""
    data, offsets = utf8(column)
    begins, before, found = words(LOWER[data], offsets, _WORDY)
    if not len(found):
        return
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    lang = pc.fill_null(langs, "und").cast(pa.large_string()).dictionary_encode()
    tongue = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    coded = found.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + tongue * len(coded.dictionary)
    distinct, number = np.unique(code, return_inverse=True)
    vocabulary = coded.dictionary.take(pa.array(distinct % len(coded.dictionary)))
    of = lang.dictionary.take(pa.array(distinct // len(coded.dictionary)))
    parts = np.cumsum(_PARTS[data])[begins]
    fresh = np.append(True, (np.diff(parts) != 0) | (np.diff(text) != 0))
    at = np.arange(len(number)) + np.cumsum(fresh) - 1
    sequence = np.zeros(at[-1] + 2, np.int64)
    sequence[at] = number + 1
    if 0 in orders:
        totals = np.bincount(tongue, minlength=len(lang.dictionary))
        yield _rows([pa.array([""] * len(totals), pa.large_string())], lang.dictionary, totals)
    for n, place, count in phrase_counts(sequence, orders[-1]):
        for i in range(0, len(place) if n in orders else 0, 50_000):
            some, many = place[i : i + 50_000], count[i : i + 50_000]
            ids = [sequence[some + k] - 1 for k in range(n)]
            yield _rows([vocabulary.take(pa.array(x)) for x in ids], of.take(pa.array(ids[0])), many)


def _rows(parts: list[pa.Array], lang: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    key = pc.binary_join_element_wise(phrase, lang, pa.scalar("\t", pa.large_string()))
    return pa.RecordBatch.from_pydict({"key": key.cast(pa.string()), "f": pa.array(count, pa.int64())})


def counts(docs: DataFrame, most: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``words``, ``phrase`` and its count ``f``: all phrases of up to ``most`` words that occur ``least`` times or more in a language, and all words under the empty phrase.

    Phrases of up to two words are counted in one pass over the texts, longer
    ones in a pass for each length, whose shuffle goes before the next begins.
    A shard gives a phrase once, so nothing is added up ahead of the shuffle:
    few of its phrases stand in the task's other shards as well.
    """
    spark = on_workers(docs.sparkSession)
    parts = []
    for orders in [range(min(most, 2) + 1), *(range(n, n + 1) for n in range(3, most + 1))]:

        def kernel(batches: Iterator[pa.RecordBatch], orders: range = orders) -> Iterator[pa.RecordBatch]:
            for b in by_size(batches, "text", SHARD):
                yield from shard_counts(b.column("text"), b.column("lang"), orders)

        each = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(kernel, "key string, f long")
        merged = each.repartition("key").groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("key").startswith("\t"))
        phrase = F.substring_index("key", "\t", 1)
        number = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
        row = merged.select(F.expr("substring(key, length(substring_index(key, '\t', 1)) + 2)").alias("lang"), number.alias("words"), phrase.alias("phrase"), "f")
        with shuffles_dropped(spark):
            parts.append(saved(row, "phrases"))
    return reduce(DataFrame.unionAll, parts)


def scored(found: DataFrame, most: int) -> DataFrame:
    """Candidates of ``counts`` with ``a``, ``l``, ``r`` and ``score`` of their lowest-scoring cut; ties go to the shortest first part."""
    parts = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(parts, k + 1, F.col("words") - k), " ").alias("rest")))
    cut = found.where(F.col("words") > 1).withColumnRenamed("f", "a").withColumn("cut", F.explode(cuts)).select("lang", "words", "phrase", "a", "cut.*")
    shorter = found.where(F.col("words").between(1, most - 1))
    cut = cut.join(shorter.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(shorter.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, both = F.col("a").cast("decimal(15,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    score = F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), both)
    best = cut.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.score", "best.l", "best.r")


def standing_alone(candidates: DataFrame, most: int, percent: int = 50) -> DataFrame:
    """Those that no longer candidate, itself kept or not, holds in ``percent`` of a hundred of their occurrences or more."""
    parts = F.split("phrase", " ")
    spans = [F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n in range(2, most) for i in range(1, most - n + 2)]
    if not spans:
        return candidates
    fits = F.filter(F.array(*spans), lambda s: (s.n < F.col("words")) & (s.i + s.n - 1 <= F.col("words")))
    inner = F.transform(fits, lambda s: F.array_join(F.slice(parts, s.i, s.n), " "))
    longer = candidates.where(F.col("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True))).drop("longer")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first ``top`` phrases of 2 to ``most`` words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A null text is an empty one and has no phrase; a null language is ``und``,
    one with that very name; repeated rows count each; equal scores go to the
    more frequent, then to the phrase that comes first by its bytes; texts of
    any length are read whole; other columns are left out, so that none can
    clash; an empty table gives no rows.
    """
    found = counts(docs, most, least, text, lang)
    kept = standing_alone(scored(found, most), most, percent)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language of ``documents``; cases as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10),
u AS (SELECT lang, words, phrase, a, k, array_to_string(s[1:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
x AS (SELECT u.lang, u.words, u.phrase, u.a, k, h.f AS l, r.f AS r, CAST(1000000::HUGEINT * u.a * u.a // (h.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM u JOIN f h ON h.lang = u.lang AND h.phrase = head JOIN f r ON r.lang = u.lang AND r.phrase = rest),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(s[1:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(s[2:3], ' '), a FROM c WHERE words = 3) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
