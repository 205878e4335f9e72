"""Near-duplicates by HyperMinHash.

Each of 128 registers keeps, of the least hash of a text's shingles, the
count of leading zeros and ten mantissa bits, 16 bits in all.  Bands of
registers bring texts together; their width follows from the threshold, so that
a pair at it misses all bands less than once in 10^7 (bands of four for 0.80,
4.7e-8, and for 0.85, 5.5e-11).  Matching registers, corrected for chance
matches of compressed ones, estimate Jaccard similarity and drop pairs that
would be at the threshold less than once in 10^8; the rest is confirmed on the
full shingle sets.

Equal sets count as one *class* throughout, told by a number.  Within a band
bucket every class is first compared with one hub, the least class, so a group
of thousands of copies costs a comparison each and not all pairs; buckets of
two classes are done with then.  Components follow from the links; what larger
buckets still hold of several components is compared with a second hub, the
class with most links so far, and what is left then, if a bucket has two or
more classes left, goes the exact way: by the rarest shingles of sets in
different components, of which two at the threshold must share one early
enough.

Buckets and hubs that hold more than a 4,096th of the rows (so fewer than 4,096
of them) are dealt over several tasks.  Very long texts take memory in
proportion to their own shingles, a text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, joined_by_sorting, on_workers, rows_in, rows_of, saved, table

REGISTERS = 128
MANTISSA = 10
HEAD = 64  # rarest shingles of a set that travel with each of its postings
MISSED_BY_BANDS, MISSED_BY_ESTIMATE = 1e-7, 1e-8  # chances of a pair at the threshold
HOT_SHARE, COPIES = 4096, 32
SETS_A_TASK = 1000  # pairs whose full sets one task reads
REST = 20  # pairs by rare shingles to expect of a class, for the number of files only


def band_width(percent: int) -> int:
    """The widest bands of which a pair at the threshold shares one but for a chance of ``MISSED_BY_BANDS``."""
    j = percent / 100
    fit = [w for w in range(1, 9) if (1 - j**w) ** (REGISTERS // w) <= MISSED_BY_BANDS]
    if not fit:
        raise ValueError(f"a similarity of {j} is too low for {REGISTERS} registers")
    return max(fit)


def least_matches(percent: int) -> int:
    """So many registers match, or more, for a pair at the threshold but for a chance of ``MISSED_BY_ESTIMATE``."""
    j, missed, m = percent / 100, 0.0, 0
    while True:
        missed += comb(REGISTERS, m) * j**m * (1 - j) ** (REGISTERS - m)
        if missed > MISSED_BY_ESTIMATE:
            return m
        m += 1


_U = np.uint64
_MUL = np.array([int.from_bytes(hashlib.blake2b(b"mul%d" % i, digest_size=8).digest(), "little") | 1 for i in range(REGISTERS)], _U)
_ADD = np.array([int.from_bytes(hashlib.blake2b(b"add%d" % i, digest_size=8).digest(), "little") for i in range(REGISTERS)], _U)
_WORDS: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, _U)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    got = list(map(_WORDS.get, words))
    if None in got:
        for i, w in enumerate(words):
            if got[i] is None:
                got[i] = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array(got, _U)
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(width, len(h)), _U)
    for k in range(min(width, len(h))):
        acc = _mixed(acc + h[k : k + n]) if k == 0 else _mixed(acc * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(acc)


def registers(sh: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least of each register's hashes, for a set with shingles."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(sh), 4096):  # bounded memory for very long texts
        part = sh[at : at + 4096]
        least = np.minimum(least, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1))
    zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 63).astype(_U)
    rest = (least << zeros) << _U(1)
    return (zeros << _U(MANTISSA) | rest >> _U(64 - MANTISSA)).astype(np.uint16)


_CHANCE: np.ndarray | None = None


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that compressed registers of two disjoint sets match, by set sizes (to the next power of two)."""
    global _CHANCE
    if _CHANCE is None:
        z = np.arange(40)[:, None]
        lo = 2.0 ** -(z + 1) * (1 + np.arange(2**MANTISSA)[None, :] / 2**MANTISSA)
        hi = lo + 2.0 ** -(z + 1 + MANTISSA)
        p = np.array([np.exp(s * np.log1p(-lo)) - np.exp(s * np.log1p(-np.minimum(hi, 1 - 1e-16))) for s in 2.0 ** np.arange(24)])
        p = p.reshape(len(p), -1)
        _CHANCE = p @ p.T
    a, b = (np.clip(np.rint(np.log2(np.maximum(x, 1))), 0, 23).astype(int) for x in (n, m))
    return _CHANCE[a, b]


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row its number, hash of the text, size and digest of its shingle set, and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, hashes, texts in rows_of(batches, "row", "doc_id", "t", "text"):
            ns, keys, regs = [], [], []
            for t in texts:
                sh = shingles(t, width)
                ns.append(len(sh))
                keys.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                regs.append(registers(sh).tobytes() if len(sh) else None)
            cols = [*(pa.array(x, pa.int64()) for x in (rows, ids, hashes, ns)), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "t", "n", "digest", "regs"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("t"), "text")
    return numbered.mapInArrow(run, "row long, doc_id long, t long, n long, digest binary, regs binary")


def _banded(classes: DataFrame, width: int) -> DataFrame:
    """``(bucket, c)``, one row for each band of a class."""
    keys = [F.xxhash64(F.lit(k), F.substring("regs", 1 + 2 * width * k, 2 * width)) for k in range(REGISTERS // width)]
    return classes.select(F.explode(F.array(*keys)).alias("bucket"), "c")


def _met(many: DataFrame, one: DataFrame, key: str, hot: list[int], by: str) -> DataFrame:
    """Inner join by ``key``; rows of ``many`` with a ``hot`` key are dealt by ``by`` over copies of their row of ``one``."""
    if not hot:
        return many.join(one, key)
    is_hot = F.col(key).isin(hot)
    seat = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(COPIES)).cast("int")).otherwise(0)
    seats = F.when(is_hot, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("_seat", seat).join(one.withColumn("_seat", F.explode(seats)), [key, "_seat"]).drop("_seat")


def _hot(sizes: DataFrame, key: str, rows: int) -> list[int]:
    """Keys whose ``size`` is over a ``HOT_SHARE``-th of ``rows`` (and over 256).

    There are fewer than ``HOT_SHARE`` of them, mostly none, so they come to
    the driver: a plan without them needs no broadcast, and each broadcast costs
    the driver a thread and its stack.
    """
    least = max(256, rows // HOT_SHARE)
    return [r[key] for r in sizes.where(F.col("size") > least).select(key).collect()] if rows > least else []


def _sets(docs: DataFrame, wanted: DataFrame, width: int, unique: bool) -> DataFrame:
    """Full sets ``(c, sh)`` of the classes in ``wanted(doc_id, digest, c)``, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cs, digests, texts in rows_of(batches, "c", "digest", "text"):
            got = [(c, sh) for c, d, sh in ((c, d, shingles(t, width)) for c, d, t in zip(cs, digests, texts)) if hashlib.blake2b(sh.tobytes(), digest_size=16).digest() == d]
            cols = [pa.array([c for c, _ in got], pa.int64()), pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["c", "sh"])

    found = docs.select("doc_id", "text").join(wanted, "doc_id").select("c", "digest", "text").mapInArrow(run, "c long, sh array<long>")
    return found if unique else found.dropDuplicates(["c"])


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, most: int) -> DataFrame:
    """Those of the pairs ``(a, b)``, of which there are at most ``most``, each once with ``a < b``, that may be links by their sizes and registers."""
    least = (least_matches(percent) - 0.5) / REGISTERS

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, m = at["n_a"].to_numpy(), at["n_b"].to_numpy()
            x, y = (np.frombuffer(b"".join(at[k].to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("r_a", "r_b"))
            c = chance(n, m)
            estimate = ((x == y).mean(axis=1) - c) / (1 - c)
            yield pa.RecordBatch.from_arrays([at["a"], at["b"]], ["a", "b"]).filter(pa.array(estimate >= least))

    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs", most)
    total = rows_in(pairs)
    for end, other in (("a", "b"), ("b", "a")):
        hot = _hot(pairs.groupBy(end).agg(F.count("*").alias("size")), end, total)
        rows = classes.select(F.col("c").alias(end), F.col("n").alias(f"n_{end}"), F.col("regs").alias(f"r_{end}"))
        met = _met(pairs if end == "a" else met, rows, end, hot, other)
    met = met.where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    out = saved(met.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(close, "a long, b long"), "likely", total, 20_000)
    forget(pairs)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Which of the pairs ``(a, b)`` are links, by their full sets."""
    total = rows_in(pairs)
    for end, other in (("a", "b"), ("b", "a")):
        hot = _hot(pairs.groupBy(end).agg(F.count("*").alias("size")), end, total)
        met = _met(pairs if end == "a" else met, sets.select(F.col("c").alias(end), F.col("sh").alias(f"s_{end}")), end, hot, other)
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    either = F.size("s_a") + F.size("s_b") - both
    return met.where(100 * both >= percent * either).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(c, label)`` for every end of a link; the label is the least end that it reaches.

    Labels spread along links and jump to their own labels' labels until
    nothing changes; they only ever fall, so that comes to pass whatever the
    links.  Each round is written and its predecessor deleted.
    """
    ends = 2 * rows_in(links)
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", ends)
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("label")), "labels", ends)
    while True:
        heard = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("label").alias("heard")).withColumnRenamed("a", "c")
        step = labels.join(heard, "c").select("c", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = step.select(F.col("c").alias("label"), F.col("label").alias("far"))
        new = saved(step.join(jump, "label", "left").select("c", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", ends)
        forget(labels)
        labels = new.select("c", "label")
        labels._saved_at = new._saved_at
        if new.where("label <> old").isEmpty():
            forget(both)
            return labels


def _resolved(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """Signatures of all rows; per class its least id, number of links, component and whether it stands for it; whether ids are unique."""
    on_workers(docs.sparkSession)
    band = band_width(percent)
    sigs = saved(_signatures(docs, width), "signatures")
    unique = sigs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("row").alias("c"), F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = saved(classes, "classes", rows_in(sigs), 8_000)
    bands = rows_in(classes) * (REGISTERS // band)

    # One hub a bucket, its least class: the same for many buckets.
    banded = _banded(classes, band)
    buckets = saved(banded.groupBy("bucket").agg(F.min("c").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets", bands, 200_000)
    members = saved(_met(banded, buckets, "bucket", _hot(buckets, "bucket", bands), "c").where("c <> hub"), "members", bands, 200_000)
    met = rows_in(members)
    likely = _likely(members.select(F.col("c").alias("a"), F.col("hub").alias("b")), classes, percent, met)
    rest = members.where("size > 2").select("bucket", "c")
    forget(buckets)

    named = classes.select("c", "digest", F.col("class_id").alias("doc_id"))
    wanted = likely.select(F.explode(F.array("a", "b")).alias("c")).union(rest.select("c")).distinct()
    sets = saved(_sets(docs, named.join(wanted, "c", "left_semi"), width, unique), "sets")
    with joined_by_sorting(docs.sparkSession):
        links, labels = _linked(likely, rest, members, sets, classes, percent)
    forget(sets)

    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    told = classes.select("c", "digest", "class_id").join(labels, "c", "left").join(degree, "c", "left")
    told = told.withColumns({"label": F.coalesce("label", "c"), "n_links": F.coalesce("n_links", F.lit(0))})
    first = told.groupBy("label").agg(F.min(F.struct("class_id", "c")).alias("first"))
    told = told.join(first, "label").select("digest", "class_id", "n_links", F.col("first.class_id").alias("component_id"), (F.col("c") == F.col("first.c")).alias("stands"))
    return sigs, told, unique


def _linked(likely: DataFrame, rest: DataFrame, members: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and component labels from the ``likely`` pairs with first hubs and from what is left (``rest``) of the buckets in ``members``."""
    met = rows_in(members)
    links = saved(_confirmed(likely, sets, percent), "confirmed", rows_in(likely), SETS_A_TASK)
    labels = components(links)
    forget(likely)

    # Second hub: in buckets of several components, the class with most links.
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("degree"))
    open_, several = _open(rest, labels, met)
    placed = saved(open_.join(degree, "c", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "open", met, 200_000)
    forget(members, several)
    second = saved(placed.groupBy("bucket").agg(F.max(F.struct("degree", "c", "label")).alias("hub"), F.count("*").alias("size")), "second", rows_in(placed))
    beside = _met(placed.select("bucket", "c", "label"), second, "bucket", _hot(second, "bucket", rows_in(placed)), "c")
    likely = _likely(beside.where(F.col("label") != F.col("hub.label")).select(F.col("c").alias("a"), F.col("hub.c").alias("b")), classes, percent, rows_in(placed))
    rest = saved(beside.where(F.col("c") != F.col("hub.c")).select("bucket", "c"), "rest", rows_in(placed))
    links, labels = _more(links, labels, _confirmed(likely, sets, percent), rows_in(likely))
    forget(placed, second, likely)

    # The exact way for what is left of open buckets.
    open_, several = _open(rest, labels, rows_in(rest))
    left = saved(open_.select("c", "label").distinct(), "left", rows_in(rest), 5_000)
    forget(several)
    likely = _likely(_rarest(left.join(classes.select("c", "n"), "c"), sets, percent), classes, percent, REST * rows_in(left))
    links, labels = _more(links, labels, _confirmed(likely, sets, percent), rows_in(likely))
    forget(rest, left, likely)
    return links, labels


def _more(links: DataFrame, labels: DataFrame, found: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Links and labels with the new links ``found`` (at most ``most``), which are between components."""
    found = saved(found, "confirmed", most, SETS_A_TASK)
    if found.isEmpty():
        return links, labels
    both = saved(links.union(found).distinct(), "confirmed", rows_in(links) + most)
    forget(links, labels, found)
    return both, components(both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``class_id``, ``n_links``, ``component_id`` and ``kept``.

    Linked are texts whose shingle sets have ``100 * both >= percent * either``.
    ``class_id`` is the least id with the same set; ``n_links`` counts the
    other classes that a document's class was found linked with (all that
    components need, not every pair).  Null and empty texts have no shingles
    and are linked with nothing, nor are rows with a null id; repeated rows
    are told each and stay kept together; ties (equal sets) form one class;
    an empty table gives no rows; other columns are ignored.
    """
    sigs, told, _ = _resolved(docs, width, percent)
    out = sigs.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(told, "digest", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    component = F.coalesce("component_id", "class_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _open(rest: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """``(bucket, c, label)`` of the buckets that still hold more than one component, and the written table of these buckets."""
    placed = rest.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    sizes = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    several = saved(sizes.where("lo <> hi").select("bucket", "size"), "several", rows, 200_000)
    return _met(placed, several, "bucket", _hot(several, "bucket", rows), "c").select("bucket", "c", "label"), several


def _rarest(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share one of their rarest shingles and may be at the threshold.

    All sets are read in one order, from their rarest shingle on.  Two bounds
    on the overlap, both true for every pair at the threshold at the first
    shingle that it shares, keep other pairs from coming out of the join: the
    shorter rest from that shingle on; and what the first ``HEAD`` shingles
    share, plus all behind the head that ends first.
    """
    each = classes.join(sets, "c").select("c", "n", F.explode("sh").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("df"))
    by = Window.partitionBy("c").orderBy("df", "s")
    each = each.join(counts, "s").withColumn("rank", F.row_number().over(by))
    need = F.ceil(F.col("n") * percent / 100)
    each = each.where(F.col("rank") <= F.greatest(F.least(F.col("n"), F.lit(HEAD)), F.col("n") - need + 1))
    first = each.where(F.col("rank") <= HEAD).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("head"))
    heads = first.select("c", F.transform("head", lambda x: x["s"]).alias("head"), F.element_at("head", -1).alias("last"))
    rare = each.where((F.col("rank") <= F.col("n") - need + 1) & (F.col("df") > 1)).select("s", "c", "n", (F.col("n") - F.col("rank") + 1).alias("rest"))
    rare = rare.join(heads.join(classes.select("c", "label"), "c"), "c")
    other = rare.select("s", *[F.col(c).alias(f"_{c}") for c in ("c", "label", "n", "rest", "head", "last")])
    need = percent * (F.col("n") + F.col("_n"))
    behind = F.when(F.col("last") <= F.col("_last"), F.col("n") - F.size("head")).otherwise(F.col("_n") - F.size("_head"))
    likely = ((100 + percent) * F.least("rest", "_rest") >= need) & ((100 + percent) * (F.size(F.array_intersect("head", "_head")) + behind) >= need)
    met = rare.join(other, "s").where((F.col("label") != F.col("_label")) & (F.col("c") < F.col("_c")) & likely)
    return met.select(F.col("c").alias("a"), F.col("_c").alias("b"))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of least id; same columns.

    Null and empty texts and rows with a null id stay.  Of rows that share an
    id, those with different texts are judged each; of equal ones, and of
    those with equal shingle sets, one stays.  Ties: the least id, then the
    first class; an empty table stays empty; other columns go along untouched.
    """
    sigs, told, unique = _resolved(docs, width, percent)
    known = sigs.where("digest is not null and doc_id is not null").select("doc_id", "t", "digest").join(told, "digest")
    if not unique:  # of the texts of one id and one set, that of least hash
        known = known.withColumn("least", F.min("t").over(Window.partitionBy("doc_id", "digest"))).withColumn("stands", F.col("stands") & (F.col("t") == F.col("least")))
    gone = known.where(~F.col("stands") | (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_gone"), F.col("t").alias("_text"))
    left = docs.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_text")), "left_anti")
    if unique:
        return left
    names = docs.columns
    whole = left.where(F.col("doc_id").isNotNull()).withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return whole.select(*names).unionByName(left.where(F.col("doc_id").isNull()))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: three-word shingles, links from 0.85 on; edge cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
