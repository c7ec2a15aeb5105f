"""Lines and tokens of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a non-blank line: key, the columns to keep, line_no (0 first, blank ones counted), line (trimmed)."""
    rows = docs.select(key, *keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def explode_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a token: key, pos, token; tokens are parted by spaces and line breaks."""
    return docs.select(key, F.posexplode(F.split(text, r"[ \n]+")).alias("pos", "token")).where("token <> ''")
