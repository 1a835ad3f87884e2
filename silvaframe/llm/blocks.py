"""Pairs within groups by blocks of bounded size, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, keys: list[str], id_col: str, block: int, weight: str | None = None) -> DataFrame:
    """Rows of groups with two members or more, dealt into pairs of blocks.

    A group of m rows is cut by a hash of the id into ceil(m / block) blocks; every pair of blocks,
    and every block with itself, becomes one unit (keys, _lo, _hi) of at most about two blocks. A row
    goes to as many units as its group has blocks, so m members cost m * m / block rows, not m * m.
    Each row has its own block's number in _own. What a unit needs to know of its rows is best joined
    to the dealt ids, before `gather`. With a weight, blocks hold about so much of its sum, and there are
    no more of them than rows.
    """
    total = F.least(F.count(F.lit(1)) * block, F.sum(weight)) if weight else F.count(F.lit(1))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total.alias("_m")).where("_n > 1").drop("_n")
    return (
        rows.join(sizes, keys)
        .withColumn("_blocks", F.expr(f"int((_m + {block - 1}) div {block})"))
        .withColumn("_own", F.pmod(F.xxhash64(F.lit(3), id_col), "_blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .drop("_m", "_blocks", "_other")
    )


def gather(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Brings the rows of each unit together, sorted by unit."""
    unit = [*keys, "_lo", "_hi"]
    return dealt.repartition(*unit).sortWithinPartitions(*unit)


def whole_runs(batches: Iterator[pd.DataFrame], unit: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole runs of equal keys, from sorted rows, with the places where runs begin and the last one ends.

    A run that spans Arrow batches is put together first.
    """
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in unit:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        last = starts[-1] if len(starts) else 0
        if last:
            yield batch.iloc[:last], np.concatenate([[0], starts])
        held = batch.iloc[last:]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])
