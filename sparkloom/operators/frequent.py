"""Frequent items: mergeable counters find candidates, a second count is exact.

Each task keeps a bounded number of counters (as of Misra and Gries): whenever there are
too many, the greatest count that has to go is taken from all. What a task takes away is
at most its number of items divided by its counters, and so for all tasks together; items
that fall short of the wanted share by more than that are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters for each item that could have the wanted share.
SPARE = 10


def _summaries(counters: int, kind: str):
    """For mapInArrow: the items that a task's counters end with, their counts, and what was taken from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts, taken = None, np.zeros(0, np.int64), 0
        for batch in batches:
            found = batch.column(0).drop_null().value_counts()
            new, n = found.field("values"), found.field("counts").to_numpy()
            if items is not None:
                both = pa.table({"i": pa.concat_arrays([items, new]), "n": np.concatenate([counts, n])}).group_by("i").aggregate([("n", "sum")])
                new, n = both["i"].combine_chunks(), both["n_sum"].to_numpy()
            if len(n) > counters:
                cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                taken += cut
                kept = n > cut
                new, n = new.filter(pa.array(kept)), n[kept] - cut
            items, counts = new, n
        if items is not None and len(items):
            yield pa.RecordBatch.from_arrays([pc.cast(items, batch.schema.field(0).type), pa.array(counts), pa.array(np.full(len(counts), taken))], ["item", "n", "taken"])

    return run


def frequent(df: DataFrame, item: str, share: float) -> DataFrame:
    """item and n, exact, of the values of a column that make up at least ``share`` of all that aren't null.

    The candidates (those whose counters reach the share but for the error, a SPARE-th
    part of it) are at most 1.2 / share in number, so they may be broadcast whatever the
    size of the table. No values give no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("a share is over 0 and at most 1")
    column = df.select(F.col(item).alias("item")).where("item is not null")
    kind = column.schema["item"].dataType.simpleString()
    total = column.count()
    counters = int(np.ceil(SPARE / share))
    found = column.mapInArrow(_summaries(counters, kind), f"item {kind}, n long, taken long").groupBy("item").agg(F.sum("n").alias("n"))
    candidates = found.where(F.col("n") >= share * total * (1 - 1 / SPARE)).select("item")
    exact = column.join(F.broadcast(candidates), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") >= F.lit(share) * total).select(F.col("item").alias(item), "n")
