"""Columns of the caller under names that cannot clash with those an operator makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shielded(docs: DataFrame, read: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column renamed but those in ``read``, and the new name of each."""
    names = {c: c if c in read else f"own_{k}_" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names
