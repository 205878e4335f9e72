"""Rows as text files and tables for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = ("tsv", "separated", "json", "pretty", "null")


def write_rows(df: DataFrame, form: str, path: str | None = None, separator: str = " ", header: bool = False) -> str | None:
    """Writes ``df`` to the folder ``path`` as ``tsv``, values apart by ``separator`` or ``json`` lines; gives back the first rows as a ``pretty`` table; or reads it all for ``null``."""
    if form == "null":
        df.write.format("noop").mode("overwrite").save()
    elif form == "pretty":
        return df._show_string(20, False)
    elif form == "json":
        df.write.option("ignoreNullFields", "false").json(path)
    elif form in ("tsv", "separated"):
        plain = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        plain.write.option("sep", "\t" if form == "tsv" else separator).option("header", header).option("nullValue", r"\N").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    else:
        raise ValueError(f"no form {form}; there are {', '.join(FORMS)}")
    return None
