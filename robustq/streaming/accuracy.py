"""Streaming accuracy (H1): numerator and denominator accumulated batch by batch.

Predictions arrive as parquet files; a Structured Streaming aggregation keeps per-variant
(Σ correct, n) in its state store and writes the whole result of every micro-batch to a new
folder ``epoch=<n>`` (complete mode through ``foreachBatch``): a failure while writing leaves the
earlier results as they are, and a repeated batch overwrites only its own folder. With
``availableNow`` the query processes what is there and stops, which is how tests and
batch re-runs drive it; on a cluster the same query runs continuously.

Predictions that carry an event time (:data:`TIMED_SCHEMA`) are counted once per (variant, example):
the state keeps the pairs seen within the watermark's delay, so a file that is delivered again
changes nothing, and rows older than the watermark are too late and dropped, so the state stays
bounded by the delay. Where all variants of an example and seed arrive together, they are delivered
as one row (:data:`ANSWERS_SCHEMA`, :func:`pack_answers`): files, shuffles and state then hold a key
per example and seed, not one per variant of it, and a bit per answer. The names of the variants are one
text that is the same in all rows of a seed; it stays in the files, shuffles carry its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robustq.functions.materialize import materialize

PRED_SCHEMA = T.StructType([T.StructField("variant_id", T.StringType()),
                            T.StructField("correct", T.BooleanType())])

TIMED_SCHEMA = T.StructType([T.StructField("variant_id", T.StringType()), T.StructField("ex_id", T.StringType()),
                             T.StructField("correct", T.BooleanType()),
                             T.StructField("event_time", T.TimestampType())])

BLOCK = 64  # answers per number, one bit each

# the answers of one example to all variants of a seed, scored together, as one event: the names of the
# seed's variants (a JSON array), and for each of them whether it was asked and whether it was correct
ANSWERS_SCHEMA = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("ex_id", T.StringType()),
                               T.StructField("variants", T.StringType()),
                               T.StructField("asked", T.ArrayType(T.LongType())),
                               T.StructField("correct", T.ArrayType(T.LongType())),
                               T.StructField("event_time", T.TimestampType())])


def first_predictions(stream: DataFrame, delay: str, key: tuple[str, ...] = ("variant_id", "ex_id"),
                      time: str = "event_time") -> DataFrame:
    """Each (variant, example) once: its first prediction that is not older than the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def numbered_variants(variants: DataFrame) -> DataFrame:
    """``variants`` (bounded, some dozens per seed) with ``place``: 0-based among those of the seed, by name."""
    return variants.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("variant_id")) - 1)


def pack_answers(preds: DataFrame, *carry: Column, variants: DataFrame | None = None) -> DataFrame:
    """One row per (seed, example) with the answers to all its variants, a bit each. Predictions come out
    of the scorer grouped by example and gold label, so that no shuffle is needed; bits are gathered in
    numbers of fixed width, where lists of answers would be sorted, and spilled, by the examples x variants.
    ``variants``: those scored, as :func:`numbered_variants` made them (the predictions then have their
    ``place``); without it they are looked up in the predictions."""
    if variants is None:
        variants = materialize(numbered_variants(preds.select("seed", "variant_id").distinct()))
        preds = preds.join(F.broadcast(variants), ["seed", "variant_id"])
    names = materialize(variants.groupBy("seed").agg(
        F.max("place").alias("last"), F.array_sort(F.collect_list(F.struct("place", "variant_id"))).alias("v"))
        .select("seed", "last", F.to_json(F.col("v.variant_id")).alias("variants")))
    blocks = (names.agg(F.max("last")).first()[0] or 0) // BLOCK + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % BLOCK)

    def gathered(name: str, holds: Column) -> list[Column]:
        return [F.bit_or(F.when(holds & F.col("place").between(b * BLOCK, (b + 1) * BLOCK - 1), bit)
                         .otherwise(F.lit(0).cast("bigint"))).alias(f"{name}{b}") for b in range(blocks)]

    packed = preds.groupBy("ex_id", "gold", "seed").agg(*gathered("a", F.lit(True)), *gathered("c", F.col("correct")))
    return packed.join(F.broadcast(names), "seed").select(
        "seed", "ex_id", "variants", *[F.array(*[F.col(f"{x}{b}") for b in range(blocks)]).alias(name)
                                       for x, name in (("a", "asked"), ("c", "correct"))], *carry)


def variant_lists(events: DataFrame) -> DataFrame:
    """The lists of variants named in ``events`` (a few), each with its hash."""
    return materialize(events.select("variants").distinct().select(
        F.xxhash64("variants").alias("list"), F.from_json("variants", "array<string>").alias("names")))


def unpack_answers(packed: DataFrame, lists: DataFrame) -> DataFrame:
    """(variant_id, correct) of every answer in ``packed`` (list, asked, correct)."""
    names = F.when(F.col("names").isNull(), F.raise_error(F.lit("answers to an unknown list of variants"))
                   .cast("array<string>")).otherwise(F.col("names"))
    each = packed.join(F.broadcast(lists), "list", "left") \
        .select("asked", "correct", F.posexplode(names).alias("place", "variant_id"))

    def bit(c: str) -> Column:
        block = F.get(F.col(c), F.floor(F.col("place") / BLOCK).cast("int"))
        return F.call_function("shiftright", block, F.col("place") % BLOCK).bitwiseAND(F.lit(1)) != 0
    return each.where(bit("asked")).select("variant_id", bit("correct").alias("correct"))


def stream_accuracy(stream: DataFrame, by: list[str], eps: float = 1e-13) -> DataFrame:
    """Streaming aggregate: (by..., n_correct, n_examples, acc)."""
    agg = stream.groupBy(*by).agg(F.sum(F.col("correct").cast("long")).alias("n_correct"),
                                  F.count(F.lit(1)).alias("n_examples"))
    return agg.withColumn("acc", F.round(F.col("n_correct") / (F.col("n_examples") + F.lit(eps)), 6))


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, by: list[str],
                  schema: T.StructType = PRED_SCHEMA, files_per_batch: int = 1,
                  delay: str | None = None) -> DataFrame:
    """Process every file present under ``source`` (one file per micro-batch) and return
    the final result table. With ``delay`` the predictions are timed and counted once
    (:func:`first_predictions`), those of :data:`ANSWERS_SCHEMA` per seed and example."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    packed = "asked" in schema.fieldNames()
    if packed:
        lists = variant_lists(spark.read.schema(schema).parquet(source))
        stream = stream.withColumn("list", F.xxhash64("variants")).drop("variants")
    if delay:
        stream = first_predictions(stream, delay, ("seed", "ex_id") if packed else ("variant_id", "ex_id"))
    if packed:
        stream = unpack_answers(stream, lists)
    agg = stream_accuracy(stream, by)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_result(spark, sink)


def latest_result(spark: SparkSession, sink: str) -> DataFrame:
    """The result of the last written micro-batch (the epoch is a partition column, so only
    that folder is read)."""
    table = spark.read.parquet(sink)
    last = table.select(F.max("epoch").alias("e")).first()["e"]
    return table.filter(F.col("epoch") == F.lit(last)).drop("epoch")
