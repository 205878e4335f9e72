"""Document fingerprints by SpotSigs.

A common word (an *anchor*) that is followed by content words spots a
signature: the chain of the next ``chain`` content words.  Boilerplate such as
menus has few common words and so few signatures.  The set of a text's
signatures is its fingerprint; two texts are alike by the Jaccard similarity
of their sets, which the set lengths alone bound from above, so sets are
partitioned by length and pairs are pruned before they are compared.
DataFrame functions only.
"""

from __future__ import annotations

import json
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Common words of four languages.
ANCHORS = tuple(
    "the a an of is was to in and that it for with as by from are on be at or this which he she not have "
    "der die das und ist ein eine zu den dem mit von sich nicht auf des im für auch "
    "le la les de des un une et est que qui dans du pour en par sur pas avec "
    "el los las y en que con por para se del una al es no su".split()
)
CHAIN = 3


def signature(words: Column) -> Column:
    """The first 60 bits of the MD5 of some words."""
    return F.conv(F.substring(F.md5(words), 1, 15), 16, 10).cast("long")


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> tuple[dict, dict, Column]:
    """Three steps to a sorted array of distinct signatures; see ``with_signatures``."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")

    def tag(w: Column, i: Column) -> Column:
        # "" for what is no content word, a mark before the first content word behind an anchor
        behind = F.get(F.col("_words"), i - 1).isin(*anchors)
        return F.when((w == "") | w.isin(*anchors), "").otherwise(F.when(behind, F.concat(F.lit("\x01"), w)).otherwise(w))

    def spot(w: Column, i: Column) -> Column:
        rest = [F.get(F.col("_content"), i + k) for k in range(1, chain)]
        bare = [F.ltrim(x, F.lit("\x01")) for x in (w, *rest)]
        return F.when(w.startswith("\x01") & rest[-1].isNotNull(), signature(F.concat_ws(" ", *bare)))

    return {"_words": words}, {"_content": F.filter(F.transform("_words", tag), lambda w: w != "")}, F.array_compact(F.transform("_content", spot))


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds the array column ``out``.

    A text without any such chain (another language, a list of names) has the
    chains of all its words, as if a common word stood before each; one of
    fewer words than a chain has one signature, that of all of them, and one
    without words none.
    """
    words, content, spots = signatures(F.coalesce(F.col(text), F.lit("")), anchors, chain)
    df = df.withColumns(words).withColumns(content).withColumn("_spots", spots).withColumn("_plain", F.filter("_words", lambda w: w != ""))
    chains = F.transform(F.sequence(F.lit(1), F.size("_plain") - (chain - 1)), lambda i: signature(F.array_join(F.slice("_plain", i, chain), " ")))
    plain = F.when(F.size("_plain") >= chain, chains).when(F.size("_plain") > 0, F.array(signature(F.array_join("_plain", " ")))).otherwise(F.array().cast("array<bigint>"))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(plain)
    return df.withColumn(out, F.array_sort(F.array_distinct(found))).drop("_words", "_content", "_spots", "_plain")


def as_text(sigs: Column) -> Column:
    """The whole set in order, 16 hexadecimal digits a signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where their lengths bound it below ``least``; 1 for two empty ones."""
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(long_ == 0, F.lit(1.0)).when((short == 0) | (short < long_ * least), F.lit(0.0)).otherwise(exact)


def length_partition(size: Column, threshold: float) -> Column:
    """Sets in partitions k and l may be similar only if k and l are equal or next to each other."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -log(threshold)).cast("int")


def similar_pairs(fingerprints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs of different sets of ``fingerprints(id, sigs)`` with Jaccard similarity of ``threshold`` or more.

    Equal sets count as one, told by their smallest id: columns ``id_a``,
    ``id_b``, ``similarity``; join on equal sets for the rest.  Sets are
    partitioned by length; within a partition and its neighbour, two similar
    sets share one of their rarest signatures (rare over all sets), so only
    those meet.  Empty sets are similar to nothing.
    """
    sets = fingerprints.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("id").alias("id"))
    sets = saved(sets.select("id", "sigs", F.size("sigs").alias("n")), "sets")
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    rare = each.join(counts, "sig").withColumn("rank", F.row_number().over(order))
    rare = rare.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1))
    part = length_partition(F.col("n"), threshold)
    left = rare.select("sig", F.col("id").alias("id_a"), F.col("n").alias("n_a"), part.alias("part"))
    right = rare.select("sig", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.explode(F.array(part, part + 1)).alias("part"))
    near = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    ahead = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    pairs = left.join(right, ["sig", "part"]).where(near & ahead).select("id_a", "id_b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("id_a"), F.col("sigs").alias("a")), "id_a")
    pairs = pairs.join(sets.select(F.col("id").alias("id_b"), F.col("sigs").alias("b")), "id_b")
    pairs = pairs.withColumn("similarity", likeness(F.col("a"), F.col("b"), threshold)).where(F.col("similarity") >= threshold)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def beside_next(docs: DataFrame, rows_a_part: int = 500) -> DataFrame:
    """``docs`` with ``_next`` (a struct of the next row by doc_id; after the last: the first).

    The ids are cut into ranges at some of them, so no task sorts them all;
    the rows with such an id also go to the range before, where they end it.
    Null ids come first; equal ids go by text.  There are 65,536 ranges at
    most; a range is sorted with spilling and read in order, so that memory
    doesn't bound its size.
    """
    spark, names = docs.sparkSession, docs.columns
    n = docs.count()
    parts = max(1, min(65_536, ceil(n / rows_a_part)))
    cuts = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("cuts")).first()
    bounds = sorted({x for x in [cuts["least"], *(cuts["cuts"] or [])] if x is not None})
    many = max(1, floor(len(bounds) ** 0.5))
    rows = [bounds[i : i + many] for i in range(0, len(bounds), many)]
    if bounds:
        # Constants that Catalyst folds into one literal each, however many bounds there are.
        heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
        blocks = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
        row = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
        at = F.size(F.filter(F.element_at(blocks, row), lambda x: x <= F.col("doc_id")))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise((row - 1) * many + at - 1)
        starts = F.col("doc_id").isNull() | (F.get(F.element_at(blocks, row), at - 1) == F.col("doc_id"))
    else:
        part, starts = F.lit(0), F.lit(True)
    last = max(len(bounds) - 1, 0)
    docs = docs.withColumn("_part", part.cast("int")).withColumn("_starts", starts)
    nulls_first = F.when(F.col("_part") == 0, last).otherwise(F.col("_part") - 1)
    seats = F.when(F.col("_starts"), F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy")), F.struct(nulls_first.alias("part"), F.lit(True).alias("copy"))))
    seats = seats.otherwise(F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy"))))
    docs = docs.withColumn("_seat", F.explode(seats))
    order = Window.partitionBy("_seat.part").orderBy("_seat.copy", F.col("doc_id").asc_nulls_first(), "text")
    docs = docs.withColumn("_next", F.lead(F.struct(*names)).over(order))
    return docs.where(~F.col("_seat.copy")).select(*names, "_next")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, and how alike they are to the edited and the next one's.

    Each text is compared with two others only, so no pair is left out by the
    lengths of sets, as ``similar_pairs`` does.  Null texts count as empty, very long ones are read whole; two texts without words are
    alike (1), one without words is unlike any other (0); rows with equal ids
    go by text; repeated rows are told each; an empty table gives no rows;
    other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_signatures(docs, "text", "sigs").withColumn("n", F.length("text"))
    docs = beside_next(docs)
    cut = F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    docs = docs.withColumn("edited", edited).withColumn("next_sigs", F.col("_next.sigs")).drop("_next")
    docs = with_signatures(docs, "edited", "edited_sigs")
    return docs.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        length_partition(F.size("sigs"), 0.8).alias("length_partition"),
    )


def _sql_signatures(text: str, out: str, source: str, target: str) -> str:
    """Common table expressions that add the sorted signatures of ``text`` to ``source``."""
    anchors = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS)) + "]"
    sig = "md5({})[1:15]"
    return f"""
{target}_w AS (SELECT *, regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') AS w FROM {source}),
{target}_c AS (
  SELECT *, list_filter(w, lambda x: x <> '') AS plain,
    list_filter(list_transform(range(1, len(w) + 1), lambda i: struct_pack(x := w[i], a := i > 1 AND list_contains({anchors}, w[greatest(i - 1, 1)]))), lambda s: s.x <> '' AND NOT list_contains({anchors}, s.x)) AS c
  FROM {target}_w),
{target}_s AS (
  SELECT *, list_transform(list_filter(range(1, len(c) - {CHAIN - 2}), lambda i: c[i].a), lambda i: {sig.format("c[i].x || ' ' || c[i + 1].x || ' ' || c[i + 2].x")}) AS spots,
    list_transform(range(1, len(plain) - {CHAIN - 2}), lambda i: {sig.format("plain[i] || ' ' || plain[i + 1] || ' ' || plain[i + 2]")}) AS chains
  FROM {target}_c),
{target} AS (
  SELECT * EXCLUDE (w, c, plain, spots, chains), list_sort(list_distinct(CASE WHEN len(spots) > 0 THEN spots WHEN len(chains) > 0 THEN chains
    WHEN len(plain) > 0 THEN [{sig.format("array_to_string(plain, ' ')")}] ELSE [] END)) AS {out}
  FROM {target}_s)"""


def _sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"""CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0::DOUBLE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE
    ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),{_sql_signatures("text", "sigs", "d", "t")},
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, count(*) OVER () AS total FROM t),
b AS (SELECT r.*, o.text AS next_text, o.sigs AS next_sigs, left(r.text, r.n - r.n // 4) || left(o.text, r.n // 4) AS edited FROM r JOIN r o ON o.k = r.k % r.total + 1),{_sql_signatures("edited", "edited_sigs", "b", "e")}
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(list_transform(sigs, lambda s: '0' || s), '') AS fingerprint,
  array_to_string(list_transform(edited_sigs, lambda s: '0' || s), '') AS edited_fingerprint, {_sql_likeness("sigs", "edited_sigs")} AS near_edited, {_sql_likeness("sigs", "next_sigs")} AS near_next,
  CAST(floor(ln(greatest(len(sigs), 1)::DOUBLE) / -ln(0.8::DOUBLE)) AS INTEGER) AS length_partition
FROM e
"""
