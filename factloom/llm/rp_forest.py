"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact rerank.

1. Equal vectors become one class that carries its k + 1 smallest ids, so copies of any
   number are one point and ties still go to the smallest ids.
2. From a bounded sample (``SAMPLE`` classes of the smallest hashes, fewer of long
   vectors) the driver grows ``TREES`` trees for each length of vectors: a level splits
   every node at its sample's median along one random direction; a tree's directions
   are orthonormal, so the squares of the margins that a path crosses bound its distance.
3. A query's leaves come from one priority queue over all trees, nearest cell first.
   How many it takes is measured on the sample: so many that ``TARGET`` of the nearest
   neighbours within the sample are found (neighbours in the whole table are nearer and
   found earlier). On clustered vectors these are a few leaves, on vectors without any
   structure a large part of them.
4. Every class lies in one leaf of each tree. Leaves and the queries that ask for them
   meet; a leaf's rows are reranked by their exact distance, and per query the best
   k + 1 are kept that are no farther than its (k + 2)nd neighbour among the sample's rows
   in the same leaves.
5. The best of all leaves are a row a query class; each query drops its own row.

Leaves of more than ``TILE`` entries or ``ASKED`` queries are dealt in tiles; what is
collected for that are the leaves of more rows than that (at most a tree's share of rows
over ``TILE``). Leaves are as many as the sample fits, so in a larger table they
are fuller and a query's work grows with the table; no task does.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Only
vectors of one length are compared. Rows that share id and vector are one row; rows that
share only the id are rows of their own. Null ids are one id, the smallest, null in the
result, and no query. Distances that over- or underflow are computed on scaled vectors. No rows: no result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, mapped, unkeyed, written

K, TREES = 10, 4
SAMPLE, SAMPLE_BYTES, LEAST, TARGET = 20_000, 1 << 27, 64, 0.95
TILE, ASKED = 5000, 5000


def points(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(_id, d, h1, h2, v) of the vectors that take part, and the type of what v's bytes hold."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, out = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    def each(batch):
        d, h1, h2, v, ids = [], [], [], [], []
        for k, x in enumerate(batch.column(1)):
            a = x.values.to_numpy(zero_copy_only=False).astype(kind) if x.is_valid and len(x.values) and not x.values.null_count else None
            if a is None or not np.isfinite(a).all() or not a.any():
                continue
            raw = (a + 0.0).astype(kind).tobytes()
            both = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8")
            d.append(len(a))
            h1.append(int(both[0]))
            h2.append(int(both[1]))
            v.append(raw)
            ids.append(k)
        return {"_id": batch.column(0).take(pa.array(ids, pa.int64())), "d": d, "h1": h1, "h2": h2, "v": pa.array(v, pa.binary())}

    return mapped(keyed(vectors, id_col, v=vec_col).withColumn("v", F.col("v").cast(out)), each, "_id long, d int, h1 long, h2 long, v binary"), kind


def euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every q from every x in double precision; scaled where squares would over- or underflow."""
    out = np.empty((len(q), len(x)))
    step = max(1, 2_000_000 // max(1, x.shape[1] * len(q)))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for i in range(0, len(x), step):
            apart = q[:, None, :] - x[None, i : i + step, :]
            near = np.sqrt((apart**2).sum(2))
            odd = ~((near > 1e-150) & (near < 1e150))
            if odd.any():
                a, b = np.nonzero(odd)
                by = np.where(np.isfinite(apart[a, b]).all(1), 1.0, 2.0)[:, None]  # halves differ by finite numbers
                part = np.abs(q[a] / by - x[i + b] / by)
                top = part.max(1)
                near[a, b] = by[:, 0] * top * np.sqrt(((part / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))
            out[:, i : i + step] = near
    return out


class Forest:
    """Trees for vectors of one length; ``visits`` leaves are asked for each query."""

    def __init__(self, sample: np.ndarray, k: int = K, trees: int = TREES, target: float = TARGET, least: int = LEAST, seed: int = 11):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.depth = max(0, int(np.log2(max(1, n) / least)))
        self.axes = min(d, max(1, self.depth))
        self.scale = float(np.abs(sample).max()) if n else 1.0
        self.directions = [np.linalg.qr(rng.normal(size=(d, self.axes)))[0] for _ in range(trees if self.depth else 1)]
        self.cuts = [self._grown(self._along(sample, r)) for r in self.directions]
        self.places = self.leaves(sample)
        self.visits = self._calibrated(sample, k, target)

    def _along(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((x / self.scale) @ r)

    def _grown(self, p: np.ndarray) -> list[np.ndarray]:
        """The cut of each node, level by level: the median of the sample's rows there, at an empty node the level's."""
        node, out = np.zeros(len(p), int), []
        for level in range(self.depth):
            along = p[:, level % self.axes]
            order = np.lexsort((along, node))
            at = np.searchsorted(node[order], np.arange(2**level + 1))
            mid = np.minimum((at[:-1] + at[1:]) // 2, len(p) - 1)
            cut = np.where(at[1:] > at[:-1], along[order[mid]], np.median(along))
            out.append(cut)
            node = 2 * node + (along > cut[node])
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.directions)), np.int32)
        for t, r in enumerate(self.directions):
            p = self._along(x, r)
            for level, cut in enumerate(self.cuts[t]):
                out[:, t] = 2 * out[:, t] + (p[:, level % self.axes] > cut[out[:, t]])
        return out

    def search(self, x: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the one priority queue."""
        along = [self._along(x[None], r)[0] for r in self.directions]
        heap, out = [(0.0, t, 0, 0) for t in range(len(along))], []
        while heap and len(out) < visits:
            bound, t, level, node = heapq.heappop(heap)
            p, cuts = along[t], self.cuts[t]
            while level < self.depth:
                margin = p[level % self.axes] - cuts[level][node]
                right = int(margin > 0)
                # A direction that was used before adds nothing to its larger margin.
                far = bound + margin * margin if level < self.axes else max(bound, margin * margin)
                level += 1
                heapq.heappush(heap, (far, t, level, 2 * node + 1 - right))
                node = 2 * node + right
            out.append((t, node))
        return out

    def among(self, asked: list[tuple[int, int]]) -> np.ndarray:
        """Which of the sample's rows lie in one of these leaves."""
        some = np.zeros((len(self.directions), 1 << self.depth), bool)
        some[tuple(np.array(asked).T)] = True
        return some[np.arange(len(some)), self.places].any(1)

    def _calibrated(self, sample: np.ndarray, k: int, target: float, asked: int = 400) -> int:
        every = len(self.directions) << self.depth
        if not self.depth:
            return every
        found = []
        for i in range(0, len(sample), max(1, len(sample) // asked)):
            near = euclidean(sample[i : i + 1], sample)[0]
            near[i] = np.inf
            order = np.zeros((len(self.directions), 1 << self.depth), int)
            for turn, (t, leaf) in enumerate(self.search(sample[i], every)):
                order[t, leaf] = turn
            best = self.places[np.argpartition(near, min(k, len(near) - 1))[:k]]
            found.append(order[np.arange(order.shape[0]), best].min(1))
        return int(np.quantile(np.concatenate(found), target)) + 1


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, _id, score) of the rows of vectors where the condition on ``_id`` holds, among all others."""
    spark = vectors.sparkSession
    found, kind = points(vectors, id_col, vec_col)
    rows = written(found, "points")
    size = np.dtype(kind).itemsize
    order = Window.partitionBy("h1", "h2").orderBy("_id")
    few = rows.select("h1", "h2", "_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.first("d").alias("d"), F.first("v").alias("v"))
    classes = written(one.join(ids, ["h1", "h2"]), "point-classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(1))).first()
    take = max(1, min(sample, SAMPLE_BYTES // (8 * longest)))
    low = -(2**63) + min(2**64 - 1, take * 2**64 // max(1, n))
    drawn = classes.where(F.col("h1") <= low).orderBy("h1", "h2").limit(2 * take).select("d", "v").toArrow()
    lengths: dict[int, list[np.ndarray]] = {}
    for d, v in zip(drawn["d"].to_pylist(), drawn["v"].to_pylist(), strict=True):
        lengths.setdefault(d, []).append(np.frombuffer(v, kind).astype(float))
    own = {d: np.stack(x) for d, x in lengths.items()}
    shared = spark.sparkContext.broadcast({d: (Forest(x, k, target=target), x) for d, x in own.items()})

    def by_length(batch, width):
        """(row numbers, vectors) for each length of a batch."""
        d = batch.column(width).to_numpy()
        raw = batch.column(width + 1)
        for one_d in np.unique(d):
            at = np.flatnonzero(d == one_d)
            yield int(one_d), at, np.frombuffer(b"".join(raw[int(i)].as_py() for i in at), kind).reshape(len(at), -1).astype(float)

    def entries(batch):
        take, tree, leaf = [], [], []
        for d, at, x in by_length(batch, 3):
            places = shared.value[d][0].leaves(x) if d in shared.value else np.zeros((len(x), 1), np.int32)
            take.append(np.repeat(at, places.shape[1]))
            tree.append(np.tile(np.arange(places.shape[1]), len(at)))
            leaf.append(places.ravel())
        out = batch.take(pa.array(np.concatenate(take))) if take else batch.slice(0, 0)
        cat = lambda x: np.concatenate(x).astype(np.int32) if x else []
        return {"tree": cat(tree), "leaf": cat(leaf)} | {c: out.column(i) for i, c in enumerate(("h1", "h2", "ids", "d", "v"))}

    def asking(batch):
        take, tree, leaf, limit = [], [], [], []
        for d, at, x in by_length(batch, 2):
            forest, some = shared.value.get(d, (None, np.zeros((0, d))))
            for i, q in zip(at, x, strict=True):
                go = forest.search(q, forest.visits) if forest else [(0, 0)]
                near = np.sort(euclidean(q[None], some[forest.among(go)])[0])[: k + 2] if forest else some
                take += [int(i)] * len(go)
                tree += [t for t, _ in go]
                leaf += [x for _, x in go]
                limit += [float(near[-1]) if len(near) == k + 2 else np.inf] * len(go)
        out = batch.take(pa.array(take, pa.int64()))
        return {"tree": tree, "leaf": leaf, "far": limit} | {c: out.column(i) for i, c in enumerate(("h1", "h2", "d", "v"))}

    asked_rows = rows.where(queries)
    placed = mapped(classes.select("h1", "h2", "ids", "d", "v"), entries, "tree int, leaf int, h1 long, h2 long, ids array<long>, d int, v binary")
    probing = mapped(asked_rows.groupBy("h1", "h2").agg(F.first("d").alias("d"), F.first("v").alias("v")), asking, "tree int, leaf int, far double, h1 long, h2 long, d int, v binary", 200)
    probing = written(probing, "leaves-asked")

    leaf = ["d", "tree", "leaf"]
    full = lambda df, most: {tuple(r[:3]): -(-r[3] // most) for r in df.groupBy(*leaf).count().where(F.col("count") > most).collect()}
    spread = spark.sparkContext.broadcast((full(placed.select(*leaf), TILE), full(probing.select(*leaf), ASKED)))

    def tiled(role):
        """Deals a leaf's entries over its tiles, one of each asked part, and queries the other way round."""

        def run(batch):
            tiles, parts = spread.value
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            if not tiles and not parts:
                return {"part": [0] * batch.num_rows, "role": [role] * batch.num_rows} | col
            keys = zip(*(col[c].to_pylist() for c in leaf), strict=True)
            take, part = [], []
            for i, (key, h) in enumerate(zip(keys, col["h2"].to_pylist(), strict=True)):
                nt, na = tiles.get(key, 1), parts.get(key, 1)
                for p in ([(h % nt) * na + a for a in range(na)] if role == 0 else [t * na + h % na for t in range(nt)]):
                    take.append(i)
                    part.append(p)
            out = batch.take(pa.array(take, pa.int64()))
            return {"part": part, "role": [role] * len(part)} | {c: out.column(i) for i, c in enumerate(batch.schema.names)}

        return run

    schema = "part int, role int, tree int, leaf int, h1 long, h2 long, ids array<long>, d int, v binary, far double"
    names = ["tree", "leaf", "h1", "h2", "ids", "d", "v", "far"]
    dealt = mapped(placed.withColumn("far", F.lit(None).cast("double")).select(*names), tiled(0), schema).unionByName(
        mapped(probing.withColumn("ids", F.lit(None).cast("array<long>")).select(*names), tiled(1), schema)
    )

    def reranked(table: pa.Table) -> pa.Table:
        return _leaf(table.combine_chunks(), kind, k)

    best = dealt.groupBy(*leaf, "part").applyInArrow(reranked, "h1 long, h2 long, score double, _id long, c1 long, c2 long")
    per = best.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "_id", "c1", "c2"))), 1, k + 1).alias("best"))
    asked_ids = asked_rows.select("h1", "h2", F.col("_id").alias("query_id")).distinct()
    # A query's own row is the one entry of its class that has its id.
    mine = lambda c: (c["c1"] == F.col("h1")) & (c["c2"] == F.col("h2")) & (c["_id"] == F.col("query_id"))
    others = asked_ids.join(per, ["h1", "h2"]).select("query_id", F.slice(F.filter("best", lambda c: ~mine(c)), 1, k).alias("best"))
    out = others.select("query_id", F.posexplode("best").alias("rank", "one"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one._id").alias("_id"), F.col("one.score").alias("score"))


def _leaf(t: pa.Table, kind: str, k: int) -> pa.Table:
    """Per query of a leaf's tile the nearest k + 1 ids of its entries, none farther than the query's limit."""
    role = t["role"].to_numpy()
    db, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    rows: list[tuple] = []
    if len(db) and len(asked):
        v = t["v"].combine_chunks()
        x = lambda at: np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1).astype(float)
        h1, h2, far = (t[c].to_numpy() for c in ("h1", "h2", "far"))
        ids, stored = t["ids"].take(pa.array(db)).to_pylist(), x(db)
        step = max(1, 4_000_000 // len(db))
        for i in range(0, len(asked), step):
            at = asked[i : i + step]
            near = euclidean(x(at), stored)
            for q, d in zip(at, near, strict=True):
                some = np.flatnonzero(d <= far[q])
                if len(some) > k + 1:  # with all that are as far as the last one kept
                    some = some[d[some] <= np.partition(d[some], k)[k]]
                best = sorted((float(d[j]), i, int(h1[db[j]]), int(h2[db[j]])) for j in some for i in ids[j])[: k + 1]
                rows += [(int(h1[q]), int(h2[q]), *b) for b in best]
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()))
    return pa.Table.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, kinds, strict=True)], schema=pa.schema(kinds))


def op11_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("_id") % 100 == 0)
    return out.select("query_id", "rank", unkeyed().alias("vec_id"), "score")
