"""Fill-in-the-middle rows: a text's prefix, middle and suffix in another order.

One numpy kernel works on all texts of an Arrow batch: a byte-class lookup
finds newlines and continuation bytes, a mask over neighbouring bytes marks
where a line ends (behind a newline, or where the next byte is another text's),
a running sum that each text begins anew numbers its lines, and one searchsorted
finds the bytes of both cuts for all rows together.  Rows are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import texts, utf8
from .common import few, on_workers, table

MARKS = ("<P>", "<S>", "<M>")
_NEWLINE, _CONTINUED = 1, 2
_CLASS = np.array([_NEWLINE if b == 10 else _CONTINUED if 128 <= b < 192 else 0 for b in range(256)], np.uint8)


def line_cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of lines, the two cuts as bytes of ``data``, and those cuts in characters of the text.

    ``draws`` are two whole numbers a text; a cut lies behind as many lines as
    its draw leaves modulo the number of lines and one.
    """
    kind = _CLASS[data]
    ends = kind == _NEWLINE
    full = offsets[1:] > offsets[:-1]
    ends[offsets[1:][full] - 1] = True
    behind = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ends, out=behind[1:])
    before = behind[offsets[:-1]]
    lines = behind[offsets[1:]] - before
    units = np.sort(draws % (lines + 1)[:, None], axis=1)
    at = np.searchsorted(behind, before[:, None] + units, "left")
    at = np.where(units == 0, offsets[:-1, None], at)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind != _CONTINUED, out=chars[1:])
    return lines, at, chars[at] - chars[offsets[:-1]][:, None]


def rearranged(column: pa.Array, draws: np.ndarray, wanted: np.ndarray, suffix_first: np.ndarray, marks: tuple[str, str, str]) -> dict[str, pa.Array]:
    """The columns of ``fill_in_middle`` for the texts of a batch."""
    data, offsets = utf8(column)
    whole = texts(data, offsets)
    lines, at, chars = line_cuts(data, offsets, draws)
    borders = np.append(np.column_stack([offsets[:-1], at]).ravel(), offsets[-1])
    parts = texts(data, borders)
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
    plain = ~wanted | (offsets[1:] == offsets[:-1])
    for mark in marks:
        plain |= pc.match_substring(whole, mark).to_numpy(zero_copy_only=False)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    none = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    plain, spm_wanted = pa.array(plain), pa.array(suffix_first)
    gone = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(lines),
        "form": pc.if_else(plain, "plain", pc.if_else(spm_wanted, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, gone, pa.array(chars[:, 0])),
        "middle_chars": pc.if_else(plain, gone, pa.array(chars[:, 1] - chars[:, 0])),
        "output": pc.if_else(plain, whole, pc.if_else(spm_wanted, spm, psm)),
    }


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, refused unless an output can be taken apart at them whatever the texts are."""
    for a in marks:
        for i, b in enumerate(marks):
            tails = any(b.startswith(a[k:]) for k in range(1, len(a)))
            if not a or tails or (a in b and marks[i] != a) or len(set(marks)) < 3:
                raise ValueError("marks must differ, and none may end as one begins or lie in another")
    return marks


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each row's key with ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Cuts and forms follow from SHA-256 of the seed and the key alone, so a rerun
    or a lost executor changes nothing.  A null text is an empty one; empty
    texts, texts that hold a mark and the ``100 - percent`` of the others stay
    plain (their counts null); a null key draws like an empty one; rows of one
    key draw alike; other columns, whatever their names, are left out; an empty
    table gives no rows; texts of any length are cut whole.
    """
    marks = checked(marks)
    on_workers(docs.sparkSession)
    name = docs.schema[key].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), digest.alias("digest"))
    group = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in few([batch]):
                h = [b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
                out = rearranged(b.column("text"), np.column_stack(h[:2]), h[2] % 100 < percent, h[3] % 100 < spm_percent, marks)
                yield pa.RecordBatch.from_pydict({"key": b.column("key")} | out)

    out = drawn.select("key", "text", *group).mapInArrow(kernel, f"key {name}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, told from output and form alone."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` rearranged, with digests of the outputs and of the texts rebuilt from them; cases as in ``fill_in_middle``."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
