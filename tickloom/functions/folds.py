"""Ordered folds: greedy choices that depend on the previous choice."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def spaced_out(rows: Column, position: str, gap: int, row_type: str) -> Column:
    """From an array of structs sorted by ``position``, keep each one that lies
    more than ``gap`` after the last one kept."""
    nothing = F.array().cast(f"array<{row_type}>")

    def keep(kept: Column, row: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)[position]
        return F.when((F.size(kept) == 0) | (row[position] - last > gap),
                      F.concat(kept, F.array(row))).otherwise(kept)

    return F.aggregate(rows, nothing, keep)
