"""Embedding whitening by TSQR: exact sums, a QR of each partition, R factors merged in a tree, SVD of the last R.

1. Every entry c becomes the whole number ``floor(64 * c) + 1000000``; equal vectors of
   these are one row of the fit list, which is written once.
2. Tasks add up the fit list in whole numbers; the sums of all are exact.
3. Every partition centres its rows, ``(n * x - S) / n`` with an exact numerator, and folds
   blocks of them into one R factor. ``FAN`` factors at a time are stacked and factored
   again, round by round, until one is left for each length of vectors.
4. The right singular vectors of that R are the eigenvectors of the covariance and its
   squared singular values, over n, the eigenvalues; the covariance of the vectors is never formed.
5. Every row of the table is projected where it lies; no vector is shuffled for it. A
   second pass over the fit list measures how far the whitened columns' covariance is
   from the identity, merging (n, mean, products about the mean) of partitions pairwise.

Only an R factor and sums a length of vectors reach the driver.

Vectors that are null or hold null or non-finite entries are dropped, and so are empty ones and
those with an entry that has no place in 64 bits. Vectors of each length have a fit list and components of
their own (copies of any number are one row of it). A null id is kept, null in the result; rows
that repeat stay. Vectors with fewer than 16 entries have as many components as entries. A
component without variance (eigenvalue within rounding of zero: fewer vectors than
components, constant entries) has a null ``whitened`` and takes no part in ``identity_error``, which is null
where no component is left. ``deviation`` is null where it exceeds 64 bits, and ``deviation_text`` has it in full.
No rows: no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, keyed, mapped, unkeyed, written

TIMES, PLUS, COMPONENTS = 64, 1_000_000, 16
BLOCK, FAN = 4096, 16


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, d, x) of the vectors that stay: x has the whole numbers."""

    def each(batch):
        d, xs, ids = [], [], []
        for k, v in enumerate(batch.column(1)):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            a = v.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                a = np.floor(a * TIMES)
            if np.isfinite(a).all() and np.abs(a).max() < 2.0**62:
                d.append(len(a))
                xs.append(a.astype(np.int64) + PLUS)
                ids.append(k)
        return {"_id": batch.column(0).take(pa.array(ids, pa.int64())), "d": d, "x": pa.array(xs, pa.list_(pa.int64()))}

    return mapped(keyed(vectors, id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>")), each, "_id long, d int, x array<long>")


def _blocks(batches, *cols: str):
    """(length, x of whole numbers, the other columns' values) of the rows of each batch, by length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column("d").to_numpy()
        for size in np.unique(d):
            at = pa.array(np.flatnonzero(d == size))
            x = batch.column("x").take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            yield int(size), x, *[batch.column(c).take(at) for c in cols]


def _times(n: int, x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """n * x - total exactly: 64-bit numbers where they are sure to fit, Python's otherwise."""
    if n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(t)) for t in total) < 2**62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


@dataclass
class Fit:
    """Of the vectors of one length: rows and sums of the fit list, and its components."""

    n: int
    total: np.ndarray
    axes: np.ndarray | None = None
    deviations: np.ndarray | None = None  # square roots of the eigenvalues, nan where there is no variance
    explained: np.ndarray | None = None
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (_times(self.n, x, self.total) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / self.deviations

    def solve(self, r: np.ndarray) -> None:
        _, s, v = np.linalg.svd(r, full_matrices=True)
        s = np.concatenate([s, np.zeros(len(v) - len(s))])
        k = min(COMPONENTS, len(v))
        axes = v[:k].T
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])  # the largest entry is positive
        least = s[0] * max(len(v), self.n) * np.finfo(float).eps
        alive = (s > least) & (s > 0)
        self.deviations = np.where(alive, s, np.nan)[:k] / np.sqrt(self.n)
        self.explained = s[:k] ** 2 / (s**2).sum() if s.any() else np.full(k, np.nan)


def _sums(fit: DataFrame) -> dict[int, Fit]:
    def run(batches):
        n, total = {}, {}
        for d, x in _blocks(batches):
            n[d] = n.get(d, 0) + len(x)
            part = [int(c) for c in x.astype(object).sum(0)] if np.abs(x).max() >= 2**62 // len(x) else x.sum(0).tolist()
            total[d] = [a + b for a, b in zip(total.get(d, [0] * d), part, strict=True)]
        flat = [(d, k, n[d], str(t)) for d in n for k, t in enumerate(total[d])]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in flat], kind) for i, (c, kind) in enumerate((("d", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("total", pa.string())))})

    parts = fit.mapInArrow(run, "d int, k int, n long, total string")
    out: dict[int, Fit] = {}
    for d, k, n, total in parts.groupBy("d", "k").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect():  # a row an entry
        out.setdefault(d, Fit(n, np.zeros(d, object))).total[k] = int(total)
    return out


def _factored(fit: DataFrame, fits) -> dict[int, np.ndarray]:
    """The R factor of the centred fit list of each length."""

    def fold(r, block):
        return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")

    def partition(batches):
        r, waiting = {}, {}
        for d, x in _blocks(batches):
            waiting.setdefault(d, []).append(fits.value[d].centred(x))
            if sum(map(len, waiting[d])) >= BLOCK:
                r[d] = fold(r.get(d), np.vstack(waiting.pop(d)))
        for d, block in waiting.items():
            r[d] = fold(r.get(d), np.vstack(block))
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(r), pa.int32()), "node": pa.array([node] * len(r), pa.int64()), "r": pa.array([m.astype(float).tobytes() for m in r.values()], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        d, node = table["d"][0].as_py(), table["node"][0].as_py()
        r = None
        order = np.argsort(table["child"].to_numpy())  # sums in one order, whichever comes first
        for m in table["r"].take(pa.array(order)).to_pylist():
            r = fold(r, np.frombuffer(m).reshape(-1, d))
        return pa.table({"d": pa.array([d], pa.int32()), "node": pa.array([node], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    now = written(fit.mapInArrow(partition, "d int, node long, r binary"), "r-factors")
    while now.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] > 0:
        up = now.select("d", F.col("node").alias("child"), F.expr(f"node div {FAN}").alias("node"), "r")
        new = written(up.groupBy("d", "node").applyInArrow(merged, "d int, node long, r binary"), "r-factors")
        dropped(now)
        now = new
    return {r.d: np.frombuffer(r.r).reshape(-1, r.d) for r in now.collect()}  # one a length


def _errors(fit: DataFrame, fits) -> dict[int, float]:
    """Largest absolute entry of the whitened columns' covariance minus the identity."""

    def moments(n, mean, m2, other):
        k, mu, m = other
        apart = mu - mean
        return n + k, mean + apart * (k / (n + k)), m2 + m + np.outer(apart, apart) * (n * k / (n + k))

    def partition(batches):
        state = {}
        for d, x in _blocks(batches):
            w = fits.value[d].whitened(x)
            w = w[:, ~np.isnan(fits.value[d].deviations)]
            mean = w.mean(0)
            own = (len(w), mean, (w - mean).T @ (w - mean))
            state[d] = moments(*state[d], own) if d in state else own
        node = TaskContext.get().partitionId()
        yield packed(node, state)

    def packed(node, state):
        return pa.RecordBatch.from_pydict({"d": pa.array(list(state), pa.int32()), "node": pa.array([node] * len(state), pa.int64()), "n": pa.array([s[0] for s in state.values()], pa.int64()), "mean": pa.array([s[1].tobytes() for s in state.values()], pa.binary()), "m2": pa.array([s[2].tobytes() for s in state.values()], pa.binary())})

    def unpacked(row):
        mean = np.frombuffer(row["mean"])
        return row["n"], mean, np.frombuffer(row["m2"]).reshape(len(mean), len(mean))

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["child"])
        state = unpacked(rows[0])
        for row in rows[1:]:
            state = moments(*state, unpacked(row))
        return pa.Table.from_batches([packed(rows[0]["node"], {rows[0]["d"]: state})])

    schema = "d int, node long, n long, mean binary, m2 binary"
    now = written(fit.mapInArrow(partition, schema), "moments")
    while now.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] > 0:
        up = now.select("d", F.col("node").alias("child"), F.expr(f"node div {FAN}").alias("node"), "n", "mean", "m2")
        new = written(up.groupBy("d", "node").applyInArrow(merged, schema), "moments")
        dropped(now)
        now = new
    out = {}
    for row in now.collect():  # one a length
        n, _, m2 = unpacked(row)
        out[row["d"]] = float(np.abs(m2 / n - np.eye(len(m2))).max()) if len(m2) else None
    return out


def fitted(rows: DataFrame) -> dict[int, Fit]:
    """The fit of each length of vectors among rows (d, x)."""
    spark = rows.sparkSession
    fit = written(rows.select("d", "x").distinct(), "fit-list")
    fits = _sums(fit)
    shared = spark.sparkContext.broadcast(fits)
    for d, r in _factored(fit, shared).items():
        fits[d].solve(r)
    shared = spark.sparkContext.broadcast(fits)
    for d, error in _errors(fit, shared).items():
        fits[d].error = error
    dropped(fit)
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, component, n, deviation, deviation_text, whitened, explained, identity_error), a row for each vector and component."""
    rows = whole(vectors, id_col, vec_col)
    fits = vectors.sparkSession.sparkContext.broadcast(fitted(rows))
    schema = "_id long, component int, n long, deviation long, deviation_text string, whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in schema.split(", ")]
    null = lambda x: pa.array(x, from_pandas=True)  # noqa: E731  nan is null

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                for d, x, ids in _blocks([part], "_id"):
                    fit = fits.value[d]
                    apart = _times(fit.n, x, fit.total)
                    if apart.dtype != object and d * int(np.abs(apart).max()) ** 2 >= 2**62:
                        apart = apart.astype(object)
                    exact = [int(v) for v in (apart * apart).sum(1)]
                    k, m = fit.axes.shape[1], len(x)
                    far = np.repeat(np.arange(m), k)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(far)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fit.n)),
                        pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(far)),
                        pa.array([str(v) for v in exact]).take(pa.array(far)),
                        null(fit.whitened(x).ravel()),
                        null(np.tile(fit.explained, m)),
                        pa.array([fit.error] * (m * k), pa.float64()),
                    ], names)

    return rows.mapInArrow(run, schema)


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(unkeyed().alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text")
