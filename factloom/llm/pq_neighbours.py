"""Embedding near-dedup by product quantisation: inverted lists, table-lookup distances, exact rerank.

1. Equal vectors become one class, so copies of any number are one point.
2. From a bounded sample (about ``SAMPLE`` classes of the smallest hashes) the driver fits
   coarse centroids and, per subspace, a codebook of the residuals.
3. Every class is indexed in the list of its nearest centroid: its residual as one
   code a subspace, and the norm of what the codes leave out.
4. Every class probes the ``PROBES`` nearest lists. A query's table of inner products
   with the codebooks gives each entry's approximate cosine by lookups; by the norm
   left out, an entry is passed over only if its exact cosine must be under the
   threshold. The others are verified by their cosine in double precision.
   A link is found if either end probes the other's list; it counts once for both.
5. Links are counted, not emitted: a list's task adds up numbers of links, and keeps
   only edges that connect what it has not connected yet.

A list is cut into tiles of at most ``TILE`` entries and ``QUERIES`` queries, whole
lists never being in one task. Sizes of lists are all that is collected of the index.

Vectors of each length have an index of their own, as only vectors of one length have
a cosine. Null, zero or non-finite vectors link with nothing; finite ones of any size do, as they are scaled first. Rows that share id and vector are one vector, and each gets its row. Null
ids are one id, the smallest, null in the result. No rows: no result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, mapped, unkeyed, written
from .components import connected

THRESHOLD = 0.95
SAMPLE, LISTS, PROBES = 20_000, 4096, 24
SUBSPACES, CODES = 16, 64
TILE, QUERIES = 2000, 20_000


def kmeans(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Centroids, from the rows that stand first; an empty one stays where it was."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(turns if len(x) else 0):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 2000], c).argmin(1) for i in range(0, len(x), 2000)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(rest[:, p], min(codes, 256)) for p in self.parts]

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals in lists at, and the norms of what they leave out."""
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        near = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - near) ** 2).sum(1))

    def cosines(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries with the entries of list at, from one table a query."""
        out = np.repeat((q @ self.coarse[at])[:, None], len(codes), axis=1)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (q[:, p] @ b.T)[:, codes[:, k]]
        return out

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = distances(x, self.coarse)
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n]


def _flat(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None]


def signed_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, d, h1, h2, v): v null and d 0 for a vector that links with nothing."""
    rows = keyed(vectors, id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))

    def each(batch):
        d, h1, h2, ok = [], [], [], []
        for x in batch.column(1):
            a = np.array(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid and x.values.null_count == 0 and len(x.values) else None
            good = a is not None and bool(np.isfinite(a).all()) and bool(a.any())
            raw = xxhash.xxh3_128_digest((a + 0.0).tobytes()) if good else bytes(16)
            both = np.frombuffer(raw, "<i8")
            d.append(len(a) if good else 0)
            h1.append(int(both[0]))
            h2.append(int(both[1]))
            ok.append(a if good else None)
        return {"_id": batch.column(0), "d": d, "h1": h1, "h2": h2, "v": pa.array(ok, pa.list_(pa.float64()))}

    return mapped(rows, each, "_id long, d int, h1 long, h2 long, v array<double>")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(_id, n_links, component_id) for each row of vectors."""
    spark = vectors.sparkSession
    rows = written(signed_rows(vectors, id_col, vec_col), "vectors")
    lengths = sorted(r[0] for r in rows.where("d > 0").select("d").distinct().collect())  # of vectors, not their number
    found = [_of_length(spark, rows, d, threshold, probes) for d in lengths]
    if not found:
        return rows.select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = rows.select("_id", "d", "h1", "h2").join(reduce(DataFrame.unionByName, found), ["d", "h1", "h2"], "left")
    return out.select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"))


def _of_length(spark: SparkSession, rows: DataFrame, d: int, threshold: float, probes: int) -> DataFrame:
    """(d, h1, h2, n_links, component_id) of the classes of vectors of length d, from an index of their own."""
    classes = rows.where(F.col("d") == d).groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count_distinct("_id").alias("copies"), F.first("v").alias("v"))
    # A class is known by its place in no order at all, but one that reruns give again.
    classes = written(classes.withColumn("k", F.xxhash64("h1", "h2")), "vector-classes")
    n = classes.count()
    low = -(2**63) + min(2**64 - 1, SAMPLE * 2**64 // n)  # about SAMPLE classes, those of the smallest hashes
    sample = classes.where(F.col("k") <= low).select("k", "v").toArrow().sort_by("k")["v"].combine_chunks()
    sample = _unit(_flat(sample).reshape(-1, d))
    index = Index(sample, min(LISTS, max(1, int(np.sqrt(n)))))
    shared = spark.sparkContext.broadcast(index)

    def placed(batch):
        x = _unit(_flat(batch.column(2)).reshape(-1, d))
        ix = shared.value
        at = nearest(x, ix.coarse)
        codes, left = ix.encode(x, at)
        return {"k": batch.column(0), "copies": batch.column(1), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64())), "at": at.astype(np.int32), "codes": [c.tobytes() for c in codes], "out": left, "probes": ix.probes(x, probes).astype(np.int32).tolist()}

    entries = written(mapped(classes.select("k", "copies", "v"), placed, "k long, copies long, x array<double>, at int, codes binary, out double, probes array<int>"), "inverted-lists")
    lists = len(index.coarse)
    own, asked = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in entries.groupBy("at").count().collect():  # a row a list
        own[r[0]] = r[1]
    for r in entries.select(F.explode("probes").alias("p")).groupBy("p").count().collect():
        asked[r[0]] = r[1]
    nd, nq = np.maximum(1, -(-own // TILE)), np.maximum(1, -(-asked // QUERIES))

    def tiles(batch):
        k = batch.column(0).to_numpy()
        at = batch.column(3).to_numpy()
        ask = batch.column(6).to_pylist()
        take, where, part, role = [], [], [], []
        for r in range(len(k)):
            a = int(at[r])
            mine = int(k[r] % nd[a])
            for q in range(nq[a]):
                take.append(r)
                where.append(a)
                part.append(mine * int(nq[a]) + q)
                role.append(0)
            for p in ask[r]:
                q = int((k[r] // 7919) % nq[p])
                for t in range(nd[p]):
                    take.append(r)
                    where.append(p)
                    part.append(t * int(nq[p]) + q)
                    role.append(1)
        out = batch.take(pa.array(take, pa.int64())) if take else batch.slice(0, 0)
        return {"list": where, "part": part, "role": role} | {n: out.column(i) for i, n in enumerate(("k", "copies", "x", "at", "codes", "out", "probes"))}

    dealt = mapped(entries, tiles, "list int, part int, role int, k long, copies long, x array<double>, at int, codes binary, out double, probes array<int>")

    def joined(table: pa.Table) -> pa.Table:
        return _tile(table.combine_chunks(), shared.value, threshold)

    found = written(dealt.groupBy("list", "part").applyInArrow(joined, "k long, links long, other long"), "vector-links")
    comp = connected(found.where("other is not null").select(F.col("k").alias("a"), F.col("other").alias("b")))
    counts = found.where("links is not null").groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "k", "left").join(comp, classes["k"] == comp["node"], "left").select("h1", "h2", "rep", F.coalesce("comp", "k").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return named.join(least, "comp").select(F.lit(d).alias("d"), "h1", "h2", "n_links", "component_id")


def _tile(t: pa.Table, index: Index, threshold: float) -> pa.Table:
    """Numbers of links (k, links) and connecting edges (k, other) of one tile of one list."""
    schema = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    role = t["role"].to_numpy()
    k, copies, at, left = (t[c].to_numpy() for c in ("k", "copies", "at", "out"))
    db, qs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(db) or not len(qs):
        return schema.empty_table()
    size = index.coarse.shape[1]
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    width = len(index.parts)
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(-1, width)
    probes = t["probes"].combine_chunks().flatten().to_numpy().reshape(len(k), -1)
    where = int(t["list"][0].as_py())
    links = np.zeros(len(k), np.int64)
    places = {int(v): i for i, v in enumerate(np.unique(k))}
    label = np.arange(len(places))
    place = np.array([places[int(v)] for v in k])
    names = np.unique(k)
    edges = []
    step = max(1, 2_000_000 // max(1, len(db)))
    for i in range(0, len(qs), step):
        q = qs[i : i + step]
        near = index.cosines(x[q], where, codes[db]) + left[db][None, :] >= threshold - 1e-9
        a, b = np.nonzero(near)
        if not len(a):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", x[q[a[j : j + 200_000]]], x[db[b[j : j + 200_000]]]) for j in range(0, len(a), 200_000)])
        good = (exact >= threshold) & (k[q[a]] != k[db[b]])
        a, b = q[a[good]], db[b[good]]
        if not len(a):
            continue
        np.add.at(links, a, copies[b])
        # The entry finds the query itself if it probes the query's list; if not, it is credited here.
        alone = ~(probes[b] == at[a][:, None]).any(axis=1)
        np.add.at(links, b[alone], copies[a[alone]])
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(a)], strict=True):
            roots = np.unique(label[np.append(place[b[s:e]], place[a[s]])])
            for r in roots[1:]:
                edges.append((int(names[roots[0]]), int(names[r])))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    some = np.flatnonzero(links)
    ks = [*k[some].tolist(), *(x for x, _ in edges)]
    return pa.Table.from_arrays([pa.array(ks, pa.int64()), pa.array([*links[some].tolist(), *[None] * len(edges)], pa.int64()), pa.array([*[None] * len(some), *(y for _, y in edges)], pa.int64())], schema=schema)


def op3_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(unkeyed().alias("vec_id"), "n_links", unkeyed("component_id").alias("component_id"), (F.col("_id") == F.col("component_id")).alias("kept"))
