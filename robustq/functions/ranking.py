"""Ranks and neighbours that stay distributed when one group holds a large share of rows.

``Window.partitionBy(g).orderBy(o)`` puts a whole group into one task; with a hot group (a
third of all rows) that task becomes the job. ``row_number_within`` instead range-sorts the
rows on ``(g, o)`` across all partitions, numbers rows by partition offset and subtracts the
group's start position. Only one row per *partition* (offsets) and one row per *group and partition*
(start positions, partially aggregated) ever meet in a small table.

``order`` must be a total order (end it with a unique key). Partition and row ids are
checkpointed once (range bounds come from sampling), so every read of the numbering agrees
and a lost executor recomputes nothing upstream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _positions(df: DataFrame, order: Sequence, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, _pid, name): 0-based global positions of the range-sorted keys, with the sort's
    partition. Partition and row ids are checkpointed once, because range bounds come from
    sampling and a second evaluation of the sort could partition differently."""
    from robustq.functions.materialize import materialize
    s = (df.select(*keys).orderBy(*_cols(order))
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s)
    parts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_pid", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")  # one row per partition
            .select(*keys, "_pid", (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(name)))


def global_position(df: DataFrame, order: Sequence, name: str = "_pos",
                    keys: Sequence[str] | None = None) -> DataFrame:
    """Add a 0-based global position following ``order`` (a total order).

    ``keys`` are the columns that make the order total (default: the column names in
    ``order``). Only the keys are range-sorted; offsets per partition (one row each) come
    from that fixed copy, and the positions are joined back to the rows on the keys."""
    if keys is None:
        if not all(isinstance(o, str) for o in order):
            raise ValueError("pass keys= when the order contains expressions")
        keys = list(order)
    keys = list(keys)
    pos = _positions(df, order, keys, name).drop("_pid")
    if set(df.columns) <= set(keys):
        return pos.select(*df.columns, name)
    return df.join(pos, keys)


def row_number_within(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                      name: str = "rn") -> DataFrame:
    """1-based row number per group, skew-safe (see module doc).

    The group's start is looked up per (sort partition, group): the rows of a hot group stay
    with the partitions that sorted them, no join ever gathers them by the group alone. The
    table of starts has one row per group and sort partition."""
    partition, keys = list(partition), [*partition, *order]
    pos = _positions(df, keys, keys, "_gpos")
    seen = pos.groupBy("_pid", *partition).agg(F.min("_gpos").alias("_g"))
    first = seen.groupBy(*partition).agg(F.min("_g").alias("_g0"))
    starts = seen.drop("_g").join(first, partition)
    rn = (pos.join(starts, ["_pid", *partition])
          .select(*keys, (F.col("_gpos") - F.col("_g0") + 1).alias(name)))
    if set(df.columns) <= set(keys):
        return rn.select(*df.columns, name)
    return df.join(rn, keys)


def next_row(df: DataFrame, order: Sequence, cols: Sequence[str],
             prefix: str = "next_") -> DataFrame:
    """Attach ``cols`` of the following row in a global total ``order`` (LEAD without a
    single-partition window): number rows with :func:`global_position`, then equi-join
    position ``p`` with ``p + 1``. The last row gets NULLs."""
    pos = global_position(df, order, "_p")
    nxt = pos.select((F.col("_p") - 1).alias("_p"), *[F.col(c).alias(prefix + c) for c in cols])
    return pos.join(nxt, "_p", "left").drop("_p")
