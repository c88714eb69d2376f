"""Lines of a GPU monitor's CSV output (SRC13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gpu_stats(df: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The numbers of each line; units are dropped and values such as [N/A] are null. Other columns are kept."""
    parts = F.split(F.col(line), r"\s*,\s*")
    number = lambda i: F.regexp_extract(F.get(parts, F.lit(i)), r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return df.select(*(c for c in df.columns if c != line), *(F.when(number(i) != "", number(i).cast("double")).alias(c) for i, c in enumerate(columns)))
