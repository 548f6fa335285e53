"""Writers of artifacts: one document, a file for each key, and a new version beside the old one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(df: DataFrame, path: str, most_bytes: int = 64 << 20) -> None:
    """All rows as one JSON document {"records": [...]}, for small artifacts: one above most_bytes raises.

    The rows' texts are measured where they lie; only then one task writes the document.
    """
    rows = df.select(F.to_json(F.struct("*")).alias("row"))
    size = rows.agg(F.sum(F.octet_length("row") + 1)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes are too many for one document")
    whole = rows.agg(F.array_sort(F.collect_list("row")).alias("r"))
    whole.select(F.concat(F.lit('{"records":['), F.array_join("r", ","), F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """A folder <key>=<value> of JSON lines for each key; rows of a hot key may lie in several files."""
    df.write.partitionBy(key).json(path)


def rewrite(df: DataFrame, path: str) -> str:
    """Write a new version beside the table at path, and return its path: Spark cannot overwrite what it reads."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(new)
    return new
