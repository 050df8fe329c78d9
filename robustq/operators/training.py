"""Mini-batch training of a linear softmax classifier on Spark.

The rows are dealt once into shards of about ``shard_rows`` rows by a hash of their key and
written to shared storage, each shard in one partition. One Spark job trains ``sync_every``
epochs: a task takes a shard (bounded by ``shard_rows``) into memory, shuffles it anew for every
epoch by md5(epoch:key) - with one shard these are exactly the batches of
``prepare.epoch_batches`` - and takes one Adam step per batch. After every epoch the shards'
weights and optimiser state are averaged by their rows; the last average is where all shards
continue. What a job reads is every training row once, what it sends to the driver is a few
numbers per weight and epoch.

The dev rows are scored with the averaged weights of every epoch in one pass per job, and the
first epoch with the strictly largest accuracy is kept (from 0, as F7). With ``state_dir`` every
job appends its state there; a killed run started again with the same settings goes on after the
last state that was committed and ends with the same weights.

Rows whose label is not one of ``classes`` (null included) fail the job. Without training rows
the weights stay zero and no epoch is run.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from robustq.functions.materialize import materialize

# parameters
SHARD_ROWS = 1 << 16
SYNC_EVERY = 10
# fixed values: Adam's defaults
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8

_STATE = ("settings string, epoch int, step bigint, numbers array<double>, best_accuracy double, "
          "best_epoch int, best array<double>, losses array<double>, accuracies array<double>")


@dataclass
class Adam:
    """Weights (classes x (dims + 1), the intercept last) with first and second moments."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    @staticmethod
    def zeros(k: int, width: int) -> Adam:
        return Adam(*(np.zeros((k, width)) for _ in range(3)))

    @staticmethod
    def of(flat: np.ndarray, k: int, width: int, step: int) -> Adam:
        return Adam(*flat.reshape(3, k, width).copy(), step)

    def flat(self) -> np.ndarray:
        return np.stack((self.w, self.m, self.v)).ravel()

    def update(self, grad: np.ndarray, rate: float, decay: float) -> None:
        g = grad + decay * self.w if decay else grad
        self.step += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        mh, vh = self.m / (1 - BETA1 ** self.step), self.v / (1 - BETA2 ** self.step)
        self.w = self.w - rate * mh / (np.sqrt(vh) + EPS)


def softmax_rows(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def batch_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean cross-entropy gradient and loss of one batch (x with a last column of ones, y class
    indexes)."""
    p = softmax_rows(x @ w.T)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())
    p[np.arange(len(y)), y] -= 1.0
    return p.T @ x / len(y), loss


def epoch_order(keys: Sequence, epoch: int) -> np.ndarray:
    """Row order of an epoch: md5(epoch:key), ties by the key's text."""
    named = [(hashlib.md5(f"{epoch}:{k}".encode()).hexdigest(), str(k), i) for i, k in enumerate(keys)]
    return np.array([i for _, _, i in sorted(named)], np.int64)


def train_epoch(state: Adam, keys: Sequence, x: np.ndarray, y: np.ndarray, epoch: int, batch: int,
                rate: float, decay: float) -> float:
    """One epoch over one shard, in place; the mean of the batch losses."""
    order, losses = epoch_order(keys, epoch), []
    for at in range(0, len(order), batch):
        rows = order[at:at + batch]
        g, loss = batch_gradient(state.w, x[rows], y[rows])
        state.update(g, rate, decay)
        losses.append(loss)
    return float(np.mean(losses))


@dataclass
class Trained:
    classes: list
    weights: np.ndarray          # of the last epoch
    best: np.ndarray             # of the best epoch on the dev rows (the last one without any)
    best_epoch: int
    losses: list[float] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)


def _prepared(rows: DataFrame, classes: Sequence, key: str, x: str, y: str) -> DataFrame:
    """(key string, x array<double> with a last 1.0, y class index)."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y).cast(_kind(classes))) - 1
    known = F.when(F.coalesce(index, F.lit(-1)) < 0, F.raise_error(F.concat(
        F.lit("label of no class: "), F.coalesce(F.col(y).cast("string"), F.lit("null")))).cast("int")) \
        .otherwise(index.cast("int"))
    return rows.select(F.col(key).cast("string").alias("key"),
                       F.concat(F.transform(F.col(x), lambda v: v.cast("double")), F.array(F.lit(1.0))).alias("x"),
                       known.alias("y"))


def _kind(classes: Sequence) -> str:
    return "string" if isinstance(classes[0], str) else "int"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _run_shards(data: DataFrame, state: Adam, epochs: Sequence[int], cfg: dict) -> dict[int, tuple]:
    """{epoch: (averaged numbers, mean loss, rows)} of one job."""
    k, width = state.w.shape
    start, step = state.flat(), state.step

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def train(shard):
            keys = [v for b in shard for v in b.column(1).to_pylist()]
            x = np.concatenate([_matrix(b.column(2)) for b in shard])
            y = np.concatenate([b.column(3).to_numpy() for b in shard])
            one = Adam.of(start, k, width, step)
            for e in epochs:
                loss = train_epoch(one, keys, x, y, e, cfg["batch"], cfg["rate"], cfg["decay"])
                # weighted by rows: numbers, loss, steps taken, then the rows themselves
                part = np.concatenate((one.flat(), [loss, one.step, 1.0])) * len(y)
                sums[e] = sums[e] + part if e in sums else part

        held, now = [], None
        for rb in batches:
            shards = rb.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), rb.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != now and held:
                    train(held)
                    held = []
                now = shards[a]
                held.append(rb.slice(a, b - a))
        if held:
            train(held)
        for e, s in sums.items():
            n = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([e] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(s)],
                names=["epoch", "at", "s"])

    got = data.mapInArrow(run, "epoch int, at int, s double").groupBy("epoch", "at").agg(F.sum("s").alias("s"))
    by: dict[int, np.ndarray] = {}
    for r in got.collect():  # a few numbers per weight and epoch
        by.setdefault(r["epoch"], np.zeros(3 * k * width + 3))[r["at"]] = r["s"]
    return {e: (v[:-3] / v[-1], v[-3] / v[-1], int(round(v[-2] / v[-1]))) for e, v in by.items()}


def accuracy_of(rows: DataFrame, weights: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """(correct, rows) for every weight matrix, in one pass over (x, y) rows."""
    def run(batches):
        total = np.zeros((len(weights), 2), np.int64)
        for rb in batches:
            if rb.num_rows:
                x, y = _matrix(rb.column(0)), rb.column(1).to_numpy()
                for i, w in enumerate(weights):
                    total[i] += (int(((x @ w.T).argmax(1) == y).sum()), len(y))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(weights)), pa.int32()), pa.array(total[:, 0]),
                                          pa.array(total[:, 1])], names=["i", "ok", "n"])

    got = rows.select("x", "y").mapInArrow(run, "i int, ok bigint, n bigint") \
        .groupBy("i").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect()
    out = [(0, 0)] * len(weights)
    for r in got:
        out[r["i"]] = (int(r["ok"]), int(r["n"]))
    return out


def _last_state(spark, state_dir: str | None, settings: str):
    if state_dir is None:
        return None
    try:
        saved = spark.read.schema(_STATE).parquet(state_dir)
        return saved.where(F.col("settings") == settings).orderBy(F.col("epoch").desc()).first()
    except AnalysisException:  # nothing written yet
        return None


def train_softmax(rows: DataFrame, classes: Sequence, dims: int, epochs: int = 10, batch: int = 32,
                  rate: float = 1e-3, decay: float = 0.0, dev: DataFrame | None = None, key: str = "id",
                  x: str = "x", y: str = "y", shard_rows: int = SHARD_ROWS, sync_every: int = SYNC_EVERY,
                  state_dir: str | None = None) -> Trained:
    """Train on ``rows`` (key, x, y) for ``epochs`` epochs; see the module's text."""
    spark, k, width = rows.sparkSession, len(classes), dims + 1
    data = _prepared(rows, classes, key, x, y)
    n = data.count()
    shards = max(1, math.ceil(n / shard_rows))
    data = data.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "x", "y")
    dealt = data.repartition(shards, "shard") if shards > 1 else data.repartition(1)
    data = materialize(dealt.sortWithinPartitions("shard", "key"))
    dev_rows = materialize(_prepared(dev, classes, key, x, y).select("x", "y")) if dev is not None else None

    cfg = {"batch": batch, "rate": rate, "decay": decay, "shards": shards, "rows": n, "dims": dims,
           "classes": list(classes), "sync": sync_every}
    settings = json.dumps(cfg, sort_keys=True)
    state, done = Adam.zeros(k, width), 0
    out = Trained(list(classes), state.w, state.w, -1)
    best_accuracy = 0.0
    last = _last_state(spark, state_dir, settings)
    if last is not None:
        state, done = Adam.of(np.array(last["numbers"]), k, width, last["step"]), last["epoch"] + 1
        out.losses, out.accuracies = list(last["losses"]), list(last["accuracies"])
        best_accuracy, out.best_epoch = last["best_accuracy"], last["best_epoch"]
        out.best = np.array(last["best"]).reshape(k, width)
    while n and done < epochs:
        todo = list(range(done, min(epochs, done - done % sync_every + sync_every)))
        got = _run_shards(data, state, todo, cfg)
        after = [Adam.of(got[e][0], k, width, got[e][2]) for e in todo]
        out.losses += [float(got[e][1]) for e in todo]
        if dev_rows is not None:
            for e, a, (ok, m) in zip(todo, after, accuracy_of(dev_rows, [a.w for a in after])):
                out.accuracies.append(ok / (m + 1e-13))
                if out.accuracies[-1] > best_accuracy:
                    best_accuracy, out.best_epoch, out.best = out.accuracies[-1], e, a.w
        state, done = after[-1], todo[-1] + 1
        if state_dir is not None:
            row = (settings, done - 1, state.step, state.flat().tolist(), best_accuracy, out.best_epoch,
                   out.best.ravel().tolist(), out.losses, out.accuracies)
            spark.createDataFrame([row], _STATE).coalesce(1).write.mode("append").parquet(state_dir)
    out.weights = state.w
    if dev_rows is None or out.best_epoch < 0:  # nothing to choose by, or no row right in any epoch
        out.best, out.best_epoch = state.w, done - 1
    return out


def predicted_class(weights: Sequence, x: str = "x") -> Column:
    """Class index with the largest logit (ties: the lowest), as a column expression over ``x``."""
    from robustq.functions.bind import bind
    from robustq.operators.search import dot
    lits = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    full = F.concat(F.transform(F.col(x), lambda v: v.cast("double")), F.array(F.lit(1.0)))
    logits = bind(full, lambda v: F.transform(lits, lambda w: dot(w, v)))
    return bind(logits, lambda lg: (F.array_position(lg, F.array_max(lg)) - 1).cast("int"))
