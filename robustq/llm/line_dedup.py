"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

State: runs of (h1, h2, owner, n_docs), h1/h2 two XXH64 of the line key. A run is a table
bucketed and sorted by the hash, so joining and merging runs needs no shuffle of them. Batches
of documents arrive in descending id order; each batch

* aggregates its line hashes (documents per key, largest id; combined on the map side),
* merge-anti-joins the runs: a key no run holds is new and is owned by this batch's largest
  id, the others only add to the count,
* adds its own run at level 0. When a level holds ``fanout`` runs they are merged into one
  run of the next level, so a key is rewritten once per level.

After the last batch the merged runs give every key's owner (largest id holding it) and its
number of documents. Keys of at least ``min_chars`` code points in ``min_docs`` documents
lose their lines everywhere but in the owner.

Hot lines: only per-batch aggregates of a key are shuffled while building; the last join of
line occurrences with the frequent keys broadcasts the keys within a checked size, and beyond
it salts the keys over ``SALTS`` copies.

Defined cases: null or empty text is one empty line and stays; repeated rows with one id are
one document when counting; rows with a null id neither count nor lose lines; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, delete_folder, saved, shared_folder

# fixed value of the contract: characters stripped at both ends of a line
STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "h1 bigint, h2 bigint, n_docs bigint, owner bigint"
SALTS = 16  # parameter: copies of the frequent keys when they are joined by a shuffle
CORE_ROWS = 1 << 18  # parameter: (line, document) keys of a batch for each core of the cluster


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), _UPPER, _LOWER)


def _hash_struct(line: Column, min_chars: int) -> Column:
    """Two hashes of the key, null for keys shorter than ``min_chars``. A line shorter than
    that cannot have such a key, which skips most of the work."""
    stripped = F.btrim(line, F.lit(STRIP))
    key = F.translate(stripped, _UPPER, _LOWER)
    return F.when((F.length(line) >= min_chars) & (F.length(stripped) >= min_chars),
                  F.struct(F.xxhash64(key).alias("h1"),
                           F.xxhash64(F.lit(1), key).alias("h2")))


class LineRuns:
    """Levelled runs of line hashes. ``add`` takes (h1, h2, n_docs, owner) per new key."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []
        self.folder = shared_folder(spark, "line-runs")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2")
         .sortBy("h1", "h2").option("path", f"{self.folder}/{name}").format("parquet")
         .saveAsTable(name))
        self.tables.append(name)
        return name

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def union(self, tables: list[str]) -> DataFrame:
        """All rows of some runs, read as plain files (a union of bucketed scans must not be
        taken for one bucketed table)."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.folder}/{t}" for t in tables])

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join ``batch`` (h1, h2, n_docs, owner) with every run, then add it: keys
        that a run already holds keep that run's owner (it has the larger ids)."""
        new = batch
        for t in self.runs():
            new = new.join(self.spark.table(t).where("owner is not null").select("h1", "h2"),
                           ["h1", "h2"], "left_anti")
        if self.runs():
            known = batch.join(new.select("h1", "h2"), ["h1", "h2"], "left_anti")
            rows = new.unionByName(known.withColumn("owner", F.lit(None).cast("bigint")))
        else:
            rows = new
        self.levels[0].append(self._write(rows.select("h1", "h2", "n_docs", "owner")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self.merged(self.levels[level]))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def merged(self, tables: list[str] | None = None) -> DataFrame:
        tables = tables if tables is not None else self.runs()
        return self.union(tables).groupBy("h1", "h2").agg(
            F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def close(self) -> None:
        """Forget the tables and delete their files. What was read from them must be written."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables = []
        delete_folder(self.spark, self.folder)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   min_chars: int = 40, min_docs: int = 5, batches: int | None = None,
                   fanout: int = 3) -> DataFrame:
    """(id, drop): per document the hashes of the lines it loses. Without ``batches`` a batch holds
    about ``CORE_ROWS`` keys a core, so their number grows with the input."""
    spark = docs.sparkSession
    lines = F.array_distinct(F.filter(
        F.transform(F.split(F.col(text), "\n"), lambda x: _hash_struct(x, min_chars)),
        lambda s: s.isNotNull()))
    keys = saved(docs.where(F.col(id_col).isNotNull() & (F.length(text) >= min_chars))
                 .select(F.col(id_col).alias("id"), F.explode(lines).alias("k"))
                 .select("id", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")))
    if batches is None:
        batches = max(1, -(-keys.count() // (CORE_ROWS * spark.sparkContext.defaultParallelism)))
    # descending id ranges of about equal size; any cut gives the same result
    cuts = [i / batches for i in range(batches - 1, 0, -1)]
    at = keys.agg(F.percentile_approx("id", cuts, 1000).alias("c")).first()["c"] if cuts else []
    edges = sorted(set(at or []), reverse=True)
    runs = LineRuns(spark, fanout=fanout)
    try:
        high = None
        for low in [*edges, None]:
            part = keys
            if high is not None:
                part = part.where(F.col("id") < high)
            if low is not None:
                part = part.where(F.col("id") >= low)
            # (key, document) pairs are distinct within a row; repeated rows of one id are not
            per_key = part.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")) \
                .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("owner"))
            runs.add(per_key)
            high = low
        frequent = saved(runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner"))
    finally:
        runs.close()
    small = broadcast_if_bounded(frequent, 40)
    if small is frequent:  # too large to broadcast: salt, so that no line's rows meet in a task
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = (keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
                 .join(salted, ["h1", "h2", "salt"]))
    else:
        found = keys.join(small, ["h1", "h2"])
    return (found.where(F.col("id") < F.col("owner"))
            .groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                        min_chars: int = 40, min_docs: int = 5, batches: int | None = None) -> DataFrame:
    """Input columns with the text cleaned, plus ``n_lines`` and ``n_dropped``. Texts that
    lose nothing stay as they are (a null text stays null)."""
    drop = saved(repeated_lines(docs, id_col, text, min_chars, min_docs, batches))
    drop = drop.select(F.col("id").alias("__id"), F.col("drop").alias("__drop"))
    drop = broadcast_if_bounded(drop, F.size("__drop") * 48 + 64)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d = docs.select(*[F.col(f"`{c}`") for c in columns]) \
        .join(drop, F.col(id_col) == F.col("__id"), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(
        F.array_contains(F.col("__drop"), _hash_struct(x, min_chars)), F.lit(False)))
    d = d.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    out = d.withColumn("n_lines", F.size(lines).cast("bigint")) \
        .withColumn("n_dropped", F.when(F.col("__kept").isNull(), F.lit(0))
                    .otherwise(F.size(lines) - F.size("__kept")).cast("bigint")) \
        .withColumn(text, F.when(F.col("__kept").isNull(), F.col(text))
                    .otherwise(F.array_join("__kept", "\n")))
    return out.select(*columns, "n_lines", "n_dropped")
