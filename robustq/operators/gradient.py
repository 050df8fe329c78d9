"""Loss gradients of trigger slots (G3) and replacement candidates for many slots at once.

The model reads a sequence of vectors e_s, one per slot, through per-slot gates:

    pooled = sum over s of gate_s * e_s        (componentwise)
    logits = weights . pooled + bias,   loss = cross entropy of the label

so that the gradient at slot s is gate_s * weights^T (softmax(logits) - onehot(label)). Its mean
over a batch, summed over the batches and divided by their number, is what a first-order search
flips tokens by.

Pooling is one aggregation per sequence. The gradient is one pass over the pooled rows in Arrow
batches: each task adds up one slots x dims matrix and the partial matrices are summed by Spark,
so the traffic is that of the model, not of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.functions.hashing import hkey
from robustq.operators.training import softmax_rows

# parameter: vectors multiplied with the queries at a time
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class SlotModel:
    weights: np.ndarray   # classes x dims
    gates: np.ndarray     # slots x dims
    bias: np.ndarray      # classes
    classes: tuple

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights.T + self.bias

    def losses(self, pooled: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = softmax_rows(self.logits(pooled))
        return -np.log(p[np.arange(len(y)), y])

    def pooled_gradient(self, pooled: np.ndarray, y: np.ndarray) -> np.ndarray:
        """d loss / d pooled of every row."""
        p = softmax_rows(self.logits(pooled))
        p[np.arange(len(y)), y] -= 1.0
        return p @ self.weights


def wave_gates(slots: int, dims: int) -> np.ndarray:
    """The gates of the V8 fixture: (1 + cos(slot * (dim + 1)) / 2) / slots."""
    return (1 + 0.5 * np.cos(np.outer(np.arange(slots), np.arange(1, dims + 1)))) / slots


def pool_sequences(seq: DataFrame, gates: np.ndarray, label: str = "label", emb: str = "embedding") -> DataFrame:
    """(ex, label, pooled array<double>) of (ex, pos, embedding, label) rows, the label that of
    position 0: one aggregation with a partial sum per component, no explode. Positions beyond
    the gates do not count."""
    slots, dims = gates.shape
    inside = F.col("pos").between(0, slots - 1)
    sums = []
    for j in range(dims):
        gate = F.get(F.array(*[F.lit(float(g)) for g in gates[:, j]]), F.col("pos"))
        sums.append(F.sum(F.get(F.col(emb), j).cast("double") * gate).alias(f"p{j}"))
    d = seq.filter(inside).groupBy("ex").agg(
        F.max(F.when(F.col("pos") == 0, F.col(label))).alias("label"), *sums)
    return d.select("ex", "label", F.array(*[F.coalesce(F.col(f"p{j}"), F.lit(0.0)) for j in range(dims)])
                    .alias("pooled"))


def batch_weights(rows: DataFrame, bsz: int, steps: int | None = None, key: str = "ex",
                  epoch: int = 0) -> DataFrame:
    """``rows`` with the weight of each in the accumulated gradient: batches of ``bsz`` in the order
    of md5(epoch:key) (B13), the mean of each batch, divided by the number of steps. Without
    ``steps`` all batches count; with it only the first, divided by ``steps`` even when fewer
    exist. Only the rows of the last, shorter batch are looked for, by a top-n."""
    order = [hkey(F.lit(str(epoch)), key), F.col(key)]
    n = rows.count()
    if steps is not None and n > steps * bsz:
        return rows.orderBy(*order).limit(steps * bsz).withColumn("weight", F.lit(1.0 / bsz / steps))
    parts = steps or max(1, -(-n // bsz))
    short = n % bsz
    if not short:
        return rows.withColumn("weight", F.lit(1.0 / bsz / parts))
    last = rows.orderBy(*[o.desc() for o in order]).limit(short).select(key, F.lit(1.0 / short / parts).alias("_w"))
    return rows.join(F.broadcast(last), key, "left") \
        .withColumn("weight", F.coalesce("_w", F.lit(1.0 / bsz / parts))).drop("_w")  # < bsz rows


def slot_gradients(pooled: DataFrame, model: SlotModel) -> DataFrame:
    """(slot, d, g): the weighted sum over (label, pooled, weight) rows of the loss gradient at
    every slot. Rows whose label is no class have no loss and do not count."""
    of = {c: i for i, c in enumerate(model.classes)}

    def run(batches):
        total = np.zeros_like(model.gates)
        for rb in batches:
            y = np.array([of.get(v, -1) for v in rb.column(0).to_pylist()])
            if not (y >= 0).any():
                continue
            x = np.asarray(rb.column(1).flatten()).reshape(rb.num_rows, -1)[y >= 0]
            w = rb.column(2).to_numpy()[y >= 0]
            total += model.gates * (w @ model.pooled_gradient(x, y[y >= 0]))
        slots, dims = total.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(slots), dims), pa.int32()),
             pa.array(np.tile(np.arange(dims), slots), pa.int32()), pa.array(total.ravel())],
            names=["slot", "d", "g"])

    parts = pooled.select("label", "pooled", "weight").mapInArrow(run, "slot int, d int, g double")
    return parts.groupBy("slot", "d").agg(F.sum("g").alias("g"))


def hotflip_all(grad: DataFrame, vectors: DataFrame, k: int, increase_loss: bool = False,
                exclude: Column | None = None, by: Sequence[str] = ("slot",), id_col: str = "vec_id",
                emb: str = "embedding") -> DataFrame:
    """(*by, rank, id, score): G4 for every query vector of ``grad`` (*by, d, g) in one scan of the
    vector table. A task multiplies blocks of vectors with all queries (a bounded matrix: slots x
    seeds of them) and keeps the ``k`` best per query; the tasks' lists are merged by a ranked
    filter. ``exclude``: a condition on the vector rows. Ties: the smaller id."""
    by = list(by)
    rows = grad.select(*by, "d", "g").orderBy(*by, "d").collect()  # queries x dims
    names = sorted({tuple(r[c] for c in by) for r in rows})
    at = {q: i for i, q in enumerate(names)}
    dims = max((r["d"] for r in rows), default=-1) + 1
    queries = np.zeros((len(names), dims))
    for r in rows:
        queries[at[tuple(r[c] for c in by)], r["d"]] = r["g"]
    queries *= 1.0 if increase_loss else -1.0
    v = vectors.filter(~exclude) if exclude is not None else vectors
    v = v.select(F.col(id_col).cast("bigint").alias("id"), F.transform(emb, lambda x: x.cast("double")).alias("e"))

    def run(batches):
        ids = np.zeros((len(names), 0), np.int64)
        best = np.zeros((len(names), 0))
        for rb in batches:
            for start in range(0, rb.num_rows, BLOCK_ROWS):
                b = rb.slice(start, BLOCK_ROWS)
                e = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                s = np.concatenate((best, queries @ e.T), axis=1)
                new = np.broadcast_to(b.column(0).to_numpy(), (len(names), b.num_rows))
                i = np.concatenate((ids, new), axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best, ids = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        n = best.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(names)), n), pa.int32()), pa.array(ids.ravel()),
                 pa.array(best.ravel())], names=["q", "id", "score"])

    if not names:
        return grad.select(*by).limit(0).selectExpr(*by, "0 AS rank", f"0L AS {id_col}", "0.0D AS score")
    top = v.mapInArrow(run, "q int, id bigint, score double")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")  # k rows a task and query
    top = top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    key = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(by, q)]) for q in names])
    return top.withColumn("_q", F.get(key, F.col("q"))) \
        .select(*[F.col(f"_q.{c}").alias(c) for c in by], "rank", F.col("id").alias(id_col), "score")
