"""Secret scans with an incremental ledger of content-addressed blobs.

A *version* is one text at one path (a document, or a file in one commit).
Texts are addressed by their SHA-256; the ledger keeps, per blob and rule
version, the spans found.  A scan looks only at pairs of blob and rule version
that the ledger lacks, appends them, and joins findings back to every path
that ever held the blob.  DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import Files

from .common import table, work_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint`` must match in every text that ``pattern`` matches in; it is the
    cheap first look.  Rules are listed in the order in which spans that start
    together are told.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:password|passwd|secret|token|api_?key)[\"' ]*[:=]"),
    # Runs are matched whole, so the shortest length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)

SPANS = "array<struct<start:long,stop:long>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of the rule's leftmost non-overlapping matches that are long enough.

    The gaps between matches and the matches themselves follow each other, so
    their running lengths are the places.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    held = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x).cast("long"))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), held.alias("held"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + F.coalesce(part["size"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(part["held"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # Places within each run of parts, then the runs' own places.
    runs = F.transform(in_runs(parts), lambda run: F.aggregate(run, start, step))
    begins = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + run["at"])))
    moved = F.zip_with(
        F.filter(runs, lambda r: r.isNotNull()), begins, lambda run, at: F.transform(run["spans"], lambda x: F.struct((x["start"] + at).alias("start"), (x["stop"] + at).alias("stop")))
    )
    found = F.flatten(F.filter(moved, lambda x: x.isNotNull()))
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(SPANS))


def in_runs(items: Column, most: int = 64) -> Column:
    """An array in runs of at most ``most`` items: what is appended item by item copies a run, not the whole."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / most) - 1, F.lit(0)).cast("int")), lambda i: F.slice(items, i * most + 1, most))


def address(text: Column) -> Column:
    return F.sha2(text, 256)


class BlobLedger:
    """The findings so far, a folder of Parquet files that every executor can reach; one writer at a time.

    Runs that a merge has replaced are listed in ``replaced.json`` and stay for
    ``grace_s``, so that frames made before it can still be read.
    """

    MOST_RUNS = 16

    def __init__(self, spark: SparkSession, path: str, grace_s: float = 86_400):
        self.spark, self.path, self.runs, self.grace_s = spark, path, [], grace_s
        self.files = Files(spark, path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> BlobLedger:
        """The ledger that earlier scans have left at ``path``."""
        ledger = cls(spark, path)
        replaced = ledger.replaced()
        ledger.runs = [f"{path}/{name}" for name in ledger.files.folders() if name.startswith("run=") and name not in replaced]
        return ledger

    def replaced(self) -> dict[str, int]:
        """Runs that a merge has taken the place of, and when."""
        return json.loads(self.files.text("replaced.json") or "{}")

    def rows(self) -> DataFrame:
        read = self.spark.read.schema(LEDGER)
        return read.parquet(*self.runs) if self.runs else self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what the ledger lacks of ``versions(blob, text)``, each text once, and appends it."""
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
        wanted = {r.version: r for r in rules}
        if self.runs:
            seen = self.rows().where(F.col("rule").isin(list(wanted))).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            blobs = blobs.where(F.size("seen") < len(wanted))
        else:
            blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
        cells = [
            F.when(~F.array_contains("seen", v), F.struct(F.lit(v).alias("rule"), spans_of(F.col("text"), r).alias("spans")))
            for v, r in wanted.items()
        ]
        fresh = blobs.select("blob", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("blob", "x.rule", "x.spans")
        path = f"{self.path}/run={len(self.runs):06d}-{uuid.uuid4().hex}"
        fresh.write.parquet(path)
        self.runs.append(path)
        if len(self.runs) > self.MOST_RUNS:
            self.merge()

    def merge(self) -> None:
        """One run in place of all, which stay for the grace time; a crash between the steps leaves pairs twice, which ``findings`` tells once."""
        name = f"run={len(self.runs):06d}-{uuid.uuid4().hex}"
        self.rows().groupBy("blob", "rule").agg(F.first("spans").alias("spans")).write.parquet(f"{self.path}/{name}")
        now, replaced = time.time_ns(), self.replaced()
        late = {run: at for run, at in replaced.items() if now - at > self.grace_s * 1e9}
        replaced = {run: at for run, at in replaced.items() if run not in late} | {run.rsplit("/", 1)[1]: now for run in self.runs}
        for run in late:
            self.files.delete(run)
        self.files.swap("replaced.json", json.dumps(replaced))
        self.runs = [f"{self.path}/{name}"]

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per blob with any finding: ``found``, spans with kind and order, by start and then by the rules' order."""
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
        kind = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
        rows = self.rows().where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
        told = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), s["stop"].alias("stop"), kind[F.col("rule")].alias("kind")))
        # A pair scanned twice (two runs at once) has equal spans; one is kept.
        once = rows.groupBy("blob", "rule").agg(F.first(told).alias("told"))
        return once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("told"))).alias("found"))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``, all spans of its whole text (empty if none).

    Null texts count as empty; repeated rows are told each; an empty table
    gives no rows; other columns stay, also ones named like the operator's own
    (``blob`` is kept apart under another name while it works), but for a
    ``found``, which is replaced.  Very long texts and such with many spans
    take time in proportion.  Spans that start together are told in the order
    of the rules.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, f"{work_folder(spark)}/ledger-{uuid.uuid4().hex}")
    text = F.coalesce("text", F.lit(""))
    ledger.scan(docs.select(address(text).alias("blob"), text.alias("text")), rules)
    docs = docs.drop("found").withColumn("_blob_of_path", address(text))
    found = ledger.findings(rules).withColumnRenamed("blob", "_blob_of_path")
    docs = docs.join(found, "_blob_of_path", "left").drop("_blob_of_path")
    return docs.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:long,order:int,stop:long,kind:string>>")))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlaps as one) replaced by ``mark`` and ``n_chars`` counted anew; same columns.

    Null, empty and very long texts, ties, repeated rows, empty tables and
    clashing names are as in ``scan_documents``; null texts stay null.
    """
    names = docs.columns
    scanned = scan_documents(docs)

    def step(acc: Column, s: Column, part: Column, first: Column) -> Column:
        between = F.substring(part, (acc["at"] - first + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    def clean_run(acc: Column, run: Column) -> Column:
        """Cuts out the text of a run of spans once, and cleans it."""
        last = F.greatest(acc["at"], F.array_max(F.transform(run, lambda s: s["stop"])))
        part = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (last - acc["at"]).cast("int"))
        begin = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
        cleaned = F.transform(F.array(part), lambda p: F.aggregate(run, begin, lambda a, s: step(a, s, p, acc["at"])))[0]
        return F.struct(last.alias("at"), F.concat(acc["outs"], F.array(cleaned["out"])).alias("outs"))

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["outs"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("outs"))
    clean = F.when(F.size("found") > 0, F.aggregate(in_runs(F.col("found")), start, clean_run, rest)).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of all ``documents``: matches of each kind and digests of all spans.

    The method itself adds no kinds, so all spans are the base ones.  The
    ledger is that in the folder ``tidemark.ledger``, kept from run to run, or
    a new one where the session names none.  Edge cases as in ``scan_documents``.
    """
    kept = spark.conf.get("tidemark.ledger", None)
    ledger = BlobLedger.opened(spark, kept) if kept else None
    docs = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_matches(order: int, rule: Rule) -> str:
    """Matches of one rule and the gaps before them; letters in either case are spelt out, as only ASCII ones may match."""
    pattern = rule.pattern
    if pattern.startswith("(?i)"):
        head, cut, tail = pattern[4:].partition(")")
        pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + cut + tail
    pattern = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS whole, "
        f"regexp_extract_all(t, '{pattern}', {rule.group}) AS held, regexp_split_to_array(t, '{pattern}') AS gap FROM d"
    )


# The same in DuckDB: places from the lengths of gaps and matches.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_matches(i, r) for i, r in enumerate(RULES))}),
e AS (SELECT doc_id, kind, ord, least, unnest(list_transform(range(1, len(whole) + 1), lambda i: struct_pack(i := i, n := length(held[i]), w := length(whole[i]), g := length(gap[i])))) AS x FROM m),
p AS (SELECT doc_id, kind, ord, least, x.n AS n, x.w AS w, sum(x.g + x.w) OVER (PARTITION BY doc_id, kind ORDER BY x.i) AS stop FROM e),
f AS (SELECT doc_id, kind, ord, CAST(stop - w AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE n >= least),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
