"""Quoted TSV whose fields hold line breaks, read by many tasks per file (A1).

Spark's reader gives such a file to one task, because a split cannot see whether it begins inside a
quoted field. Here lines are read as text (splittable) and scanned by the rule of the dialect: a
field that begins with a quote ends at a quote that is not doubled, quotes elsewhere are text.

1. Each split reports how it would end if it began outside a field and if it began inside one:
   two flags a split.
2. The flags of a file's splits are folded in order, which tells where each split begins.
3. Each task cuts its lines into records. A record that ends in a later split leaves its pieces,
   two a split at most; they are put together by file and parsed like the others.

Nothing but the splits that begin inside a field is broadcast, and what is grouped are flags and
pieces, never whole files. A quote that is never closed makes the rest of its file one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robustq.functions.materialize import materialize
from robustq.sources.io import PAIRS_SCHEMA, TSV_OPTIONS

_FLAGS = "file string, block bigint, outside boolean, inside boolean"
_PIECES = "file string, block bigint, part int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the end of one from an earlier split; a record's begin


def ends_inside(line: str, inside: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Whether a quoted field is open after ``line``, which begins inside one or at a field."""
    i, n = 0, len(line)
    while True:
        if inside:
            i = line.find(quote, i)
            if i < 0:
                return True
            if line.startswith(quote, i + 1):
                i += 2
                continue
            inside, i = False, i + 1
        elif line.startswith(quote, i):
            inside, i = True, i + 1
            continue
        i = line.find(sep, i)
        if i < 0 or i > n:
            return False
        i += 1


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, value) in the order of each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(rb: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, block), lines) of a batch, consecutive lines of one split together."""
    files, blocks, values = (c.to_pylist() for c in rb.columns[:3])
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], blocks[i]) != (files[at], blocks[at]):
            yield (files[at], blocks[at]), values[at:i]
            at = i


def _flags(lines: DataFrame) -> DataFrame:
    def run(batches):
        now, state = None, (False, True)
        for rb in batches:
            for key, values in _runs(rb):
                if key != now:
                    if now is not None:
                        yield _batch(_FLAGS_ARROW, [(*now, *state)])
                    now, state = key, (False, True)
                for v in values:
                    if '"' in v:
                        state = tuple(ends_inside(v, s) for s in state)
        if now is not None:
            yield _batch(_FLAGS_ARROW, [(*now, *state)])
    return lines.mapInArrow(run, _FLAGS)


_FLAGS_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()),
                          ("inside", pa.bool_())])
_PIECES_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _begin_inside(flags: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside a field: the flags of each file folded in order (a file has one
    row per split here)."""
    def fold(acc, s):
        return F.struct(
            F.when(acc["now"], F.concat(acc["found"], F.array(s["block"]))).otherwise(acc["found"]).alias("found"),
            F.when(acc["now"], s["inside"]).otherwise(s["outside"]).alias("now"))
    start = F.struct(F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("now"))
    per = flags.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "outside", "inside"))).alias("s"))
    rows = per.select("file", F.explode(F.aggregate("s", start, fold, lambda a: a["found"])).alias("block")).collect()
    return {(r["file"], r["block"]) for r in rows}


def _records(lines: DataFrame, begin: set[tuple[str, int]]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast(begin)

    def run(batches):
        now, inside, part, held, rows, size = None, False, WHOLE, [], [], 0

        def close():
            """What is open at the end of a split: the begin of a record, or still an earlier one's."""
            if held:
                rows.append((*now, HEAD if part == HEAD else TAIL, "\n".join(held)))
                held.clear()
        for rb in batches:
            for key, values in _runs(rb):
                if key != now:
                    close()
                    now, inside = key, key in shared.value
                    part = HEAD if inside else WHOLE
                for v in values:
                    inside = ends_inside(v, inside) if '"' in v else inside
                    held.append(v)
                    size += len(v) + 64
                    if not inside:
                        rows.append((*now, part, "\n".join(held)))
                        held.clear()
                        part = WHOLE
                if size > 1 << 20 and rows:
                    yield _batch(_PIECES_ARROW, rows)
                    rows.clear()
                    size = 0
        close()
        if rows:
            yield _batch(_PIECES_ARROW, rows)
    return lines.mapInArrow(run, _PIECES)


def read_quoted_pairs(spark: SparkSession, path, schema: T.StructType = PAIRS_SCHEMA) -> DataFrame:
    """Rows of quoted TSV files with a header each; columns not in ``schema`` are ignored by
    name. Fields may hold line breaks; a file is read by as many tasks as it has splits."""
    lines = _lines(spark, path)
    begin = _begin_inside(_flags(lines))
    pieces = _records(lines, begin)
    whole = pieces.filter(F.col("part") == WHOLE).select("file", "block", "text")
    # pieces of records that cross splits: every begin opens a record, in the order of the file
    w = Window.partitionBy("file").orderBy("block", "part")
    cross = materialize(pieces.filter(F.col("part") != WHOLE))
    cross = (cross.withColumn("record", F.sum((F.col("part") == TAIL).cast("int")).over(w))
             .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
             .select("file", F.get("p", 0)["block"].alias("block"),
                     F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    names, header = _header(lines)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in TSV_OPTIONS.items() if k != "header"}
    rows = whole.unionByName(cross).filter(F.col("text") != F.lit(header)) \
        .select(F.from_csv("text", ", ".join(f"`{n}` string" for n in names),
                           options | {"multiLine": "true", "mode": "PERMISSIVE"}).alias("r"))
    return rows.select(*[F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def _header(lines: DataFrame) -> tuple[list[str], str]:
    """Column names and the header line, which every file begins with."""
    first = lines.filter(F.col("block") == 0).select("value").first()
    line = first["value"] if first else ""
    names = [n[1:-1].replace('""', '"') if n.startswith('"') else n for n in line.split("\t")]
    return [n or f"_c{i}" for i, n in enumerate(names)], line
