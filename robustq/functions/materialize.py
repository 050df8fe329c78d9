"""Materialise small derived tables once, and broadcast only behind a size check.

A bounded table that a plan reads several times (the per-seed triggers, the label map,
the fitted weights) would otherwise be recomputed from its whole-table lineage at every
use (Spark reuses shuffles, not arbitrary subplans). ``materialize`` writes it once to the
cluster's checkpoint folder (reliable ``checkpoint``, never ``localCheckpoint``), which also
cuts the lineage so a lost executor does not replay the upstream job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustq.session import ensure_checkpoint_dir

# parameter: estimated bytes up to which a table is broadcast
BROADCAST_MAX_BYTES = 64 << 20


def rows_within(row_bytes: int) -> int:
    """Rows of about ``row_bytes`` each that may be broadcast."""
    return max(1, BROADCAST_MAX_BYTES // row_bytes)


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    """Materialise independent DataFrames at the same time: each is its own Spark job,
    submitted from its own driver thread (``InheritableThread`` keeps the caller's job
    group and scheduler properties), so the scheduler interleaves their tasks instead of
    running the jobs one after the other."""
    if len(dfs) == 1:
        return [materialize(dfs[0])]
    ensure_checkpoint_dir(dfs[0].sparkSession)
    return concurrently(*[(lambda d=d: materialize(d)) for d in dfs])


def concurrently(*fns) -> list:
    """Call functions that submit independent Spark jobs (materialisations, or builders
    that materialise inside) from separate driver threads; results in argument order,
    the first error re-raised on the caller's thread."""
    from pyspark import InheritableThread
    out: list = [None] * len(fns)
    errors: list = []

    def run(i: int, fn) -> None:
        try:
            out[i] = fn()
        except BaseException as e:  # re-raised on the caller's thread
            errors.append(e)

    threads = [InheritableThread(target=run, args=(i, fn)) for i, fn in enumerate(fns)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return out


def spread(df: DataFrame, factor: int = 2, source: DataFrame | None = None) -> DataFrame:
    """Round-robin ``df`` when its input scan has fewer splits than ``factor`` x the cluster's
    parallelism (a few large row groups cannot be split by the reader, so one task would
    do all per-row work). A no-op on large inputs, which already have many splits; column
    pruning and filters still reach the scan below the repartition.

    ``source`` is the plain file scan whose split count decides (default: ``df`` itself,
    which must then be a scan with narrow operations only). Counting the partitions of a
    plan with a shuffle or broadcast would run those stages, so a joined ``df`` passes
    its scan here."""
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    src = source if source is not None else df
    return df.repartition(target) if src.rdd.getNumPartitions() < target else df
