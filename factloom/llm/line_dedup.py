"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased, held as a 128-bit hash; lines whose key has under ``min_chars`` code
points have none. The index holds three tables, all partitioned, none collected:

* ``postings`` (_id, _t, k1, k2): once for each document, text (a hash of it) and key;
* ``refs`` (k1, k2, n, top): exact number of documents and largest id of each key;
* ``filters`` (shard, filter): a cuckoo filter over the keys of each shard.

``insert`` sends the new documents' keys, counted before the shuffle, to their
shard's filter. Keys that the filter lacks are new, and become reference counts
as they are; only the others are looked up in the exact table, and those that it
lacks (the filter was wrong) get a fingerprint of their own too. ``delete`` takes a
document's postings back: counts fall, the largest id is found again for the keys
touched, and keys that no document holds leave their filter. A filter that is full is
built anew from its shard's exact keys, and an index that has outgrown its shards is dealt into more of them. So inserting and then deleting documents gives
the counts that there were before, and filters of the same keys.

A key of at least ``min_docs`` documents loses its lines everywhere but in the
largest id that holds it. Null text: one empty line. Rows that repeat an id count
as one document, and each is cut alike. Null ids: one document, smaller than others.
A frequent line is one row a map task in the counts; where its postings meet the
reference count, adaptive execution splits them, as the other side has one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_arrow, keyed, mapped, texts, unkeyed, with_text_key, written
from .cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys a shard: its filter takes about 2.5 MB.
SHARD_KEYS = 1_000_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a lower-cased line, or None for a short one."""
    line = line.strip()
    if len(line) < min_chars or (len(line) < 4 * min_chars and not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _t, k1, k2), once for each row and key; docs has _id, text and _t."""

    def each(batch):
        ids, hashes, keys = [], [], []
        for i, t, text in zip(batch.column(0).to_numpy(), batch.column(2).to_numpy(), texts(batch), strict=True):
            found = {key_of(x, min_chars) for x in text.lower().split(b"\n")}
            found.discard(None)
            keys.extend(found)
            ids.append(np.full(len(found), i, np.int64))
            hashes.append(np.full(len(found), t, np.int64))
        halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return {"_id": np.concatenate(ids) if ids else [], "_t": np.concatenate(hashes) if ids else [], "k1": halves[:, 0], "k2": halves[:, 1]}

    return mapped(docs, each, "_id long, _t long, k1 long, k2 long")


def _sharded(counts: DataFrame, shards: int) -> DataFrame:
    return counts.withColumn("shard", F.pmod(F.col("k1"), F.lit(shards)).cast("int"))


class LineIndex:
    """Postings, exact reference counts and shard filters; every change gives a new index."""

    def __init__(self, postings: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int):
        self.postings, self.refs, self.filters = postings, refs, filters
        self.shards, self.min_chars, self.min_docs = shards, min_chars, min_docs

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 16, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        none = lambda ddl: spark.createDataFrame([], ddl)
        return cls(none("_id long, _t long, k1 long, k2 long"), none("k1 long, k2 long, n long, top long"), none("shard int, filter binary"), shards, min_chars, min_docs)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineIndex:
        """An index of docs; shards are sized by the number of its postings unless more documents are to come."""
        postings = written(line_keys(with_text_key(keyed(docs, id_col, text=text_col)), min_chars), "line-postings")
        shards = shards or max(16, postings.count() // SHARD_KEYS)
        return cls.empty(docs.sparkSession, shards, min_chars, min_docs)._add(postings, fresh=True)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """docs' ids must not be in the index yet; delete() an old version first."""
        return self._add(written(line_keys(with_text_key(keyed(docs, id_col, text=text_col)), self.min_chars), "line-postings"))._grown()

    def _grown(self) -> LineIndex:
        """With more shards and filters of their own, once shards hold twice the keys that one is sized for."""
        n = self.refs.count()
        if n <= 2 * SHARD_KEYS * self.shards:
            return self
        shards = -(-n // SHARD_KEYS)
        filters = written(_sharded(self.refs, shards).select("shard", "k1").groupBy("shard").applyInArrow(_build, "shard int, filter binary"), "line-filters")
        return LineIndex(self.postings, self.refs, filters, shards, self.min_chars, self.min_docs)

    def _add(self, postings: DataFrame, fresh: bool = False) -> LineIndex:
        pairs = postings.select("_id", "k1", "k2").distinct()
        counts = _sharded(pairs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("_id").alias("top")), self.shards)
        stepped = written(counts.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_insert, _STEP), "line-step")
        keys, filters = _parts(stepped)
        new = keys.where(~F.col("known")).select("k1", "k2", "n", "top")
        if fresh:
            refs = new
        else:
            more = keys.where("known").select("k1", "k2", F.col("n").alias("dn"), F.col("top").alias("dtop"))
            old, rest = self._touched(keys.select("shard"))
            both = old.join(more, ["k1", "k2"], "full_outer")  # a filter may take a new key for a known one
            refs = both.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), F.greatest("top", "dtop").alias("top")).unionByName(new)
            refs, postings = written(refs, "line-refs").unionByName(rest), self.postings.unionByName(postings)
            # delete() takes out one fingerprint a key, so new keys that the filter took for known ones need theirs.
            missed = _sharded(more.join(self.refs, ["k1", "k2"], "left_anti").select("k1", "k2"), self.shards)
            filters = written(missed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_put_missed, "shard int, filter binary"), "line-filters")
            full = filters.where(F.length("filter") == 0).select("shard")
            rebuilt = _sharded(refs, self.shards).join(full, "shard").select("shard", "k1").groupBy("shard").applyInArrow(_build, "shard int, filter binary")
            filters = written(filters.where(F.length("filter") > 0).unionByName(rebuilt), "line-filters")
        untouched = self.filters.join(filters, "shard", "left_anti")
        return LineIndex(postings, refs, filters if fresh else filters.unionByName(untouched), self.shards, self.min_chars, self.min_docs)

    def _touched(self, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The reference counts of these shards, and those of the others, which a change leaves as they are."""
        rows, some = _sharded(self.refs, self.shards), F.broadcast(shards.distinct())  # a row a shard
        return tuple(rows.join(some, "shard", how).select("k1", "k2", "n", "top") for how in ("left_semi", "left_anti"))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids; ids that it lacks change nothing."""
        gone = keyed(ids, id_col).distinct()
        left = written(self.postings.join(gone, "_id", "left_anti"), "line-postings")
        touched = written(self.postings.join(gone, "_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
        now = left.select("_id", "k1", "k2").join(touched, ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("_id").alias("top"))
        old, rest = self._touched(_sharded(touched, self.shards).select("shard"))
        refs = written(old.join(touched, ["k1", "k2"], "left_anti").select("k1", "k2", "n", "top").unionByName(now), "line-refs").unionByName(rest)
        dead = _sharded(touched.join(now, ["k1", "k2"], "left_anti"), self.shards)
        filters = written(dead.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_remove, "shard int, filter binary"), "line-filters")
        return LineIndex(left, refs, filters, self.shards, self.min_chars, self.min_docs)

    def cuts(self) -> DataFrame:
        """(_id, _t, keys): for each text of a document, the 16-byte keys whose lines it loses, end to end."""
        often = self.refs.where(F.col("n") >= self.min_docs).select("k1", "k2", "top")
        hits = self.postings.distinct().join(often, ["k1", "k2"]).where("_id < top")
        return hits.groupBy("_id", "_t").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
        """(_id, n_lines, n_dropped, text) and columns to keep (internal name -> column), a row for each row of docs, which stand in the index as they are."""
        keep = keep or {}
        rows = with_text_key(keyed(docs, id_col, text=text_col, **keep))
        joined = rows.join(self.cuts().hint("shuffle_hash"), ["_id", "_t"], "left")
        low = self.min_chars

        def each(batch):
            lines, cut, kept = [], [], []
            keys = batch.column(batch.schema.get_field_index("keys"))
            for k, text in enumerate(texts(batch)):
                found = text.split(b"\n")
                gone = 0
                if keys[k].is_valid:
                    flat = keys[k].values.flatten()
                    drop = {a + b for a, b in zip(*(_eights(x) for x in flat), strict=True)}
                    left = [x for x in found if key_of(x.lower(), low) not in drop]
                    gone = len(found) - len(left)
                    text = b"\n".join(left)
                lines.append(len(found))
                cut.append(gone)
                kept.append(text)
            same = {k: batch.column(batch.schema.get_field_index(k)) for k in ("_id", *keep)}
            return same | {"n_lines": lines, "n_dropped": cut, "text": pa.array(kept, pa.binary()).cast(pa.string())}

        extra = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
        return mapped(joined, each, f"_id long, n_lines long, n_dropped long, text string{extra}")


def _eights(x: pa.Array) -> list[bytes]:
    raw = x.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


_STEP = "shard int, k1 long, k2 long, n long, top long, known boolean, filter binary"


def _parts(stepped: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stepped.where("filter is null").drop("filter"), stepped.where("filter is not null").select("shard", "filter")


def _insert(counts: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard: says which keys its filter may hold already, and puts the others in."""
    keys = counts["k1"].to_numpy()
    raw = filters["filter"][0].as_py() if filters.num_rows else None
    old = CuckooFilter.frombytes(raw) if raw is not None else CuckooFilter(1)
    known = old.has(keys) if raw is not None else np.zeros(len(keys), bool)
    fresh = keys[~known]
    shard = counts["shard"][0].as_py() if counts.num_rows else filters["shard"][0].as_py()
    out = old
    if len(fresh):
        if old.count() == 0:
            out = CuckooFilter.of(fresh)
        else:
            out = CuckooFilter.frombytes(old.tobytes())
            if old.count() + len(fresh) > 0.95 * old.table.size or not out.bulk(fresh):
                out = None  # full: built anew from the exact keys
    n = counts.num_rows
    schema = pa.schema([("shard", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("top", pa.int64()), ("known", pa.bool_()), ("filter", pa.binary())])
    rows = [np.full(n + 1, shard, np.int32)] + [pa.chunked_array([*counts[c].cast(pa.int64()).chunks, pa.array([None], pa.int64())]) for c in ("k1", "k2", "n", "top")]
    rows += [pa.array([*known.tolist(), None], pa.bool_()), pa.array([None] * n + [out.tobytes() if out is not None else b""], pa.binary())]
    return pa.Table.from_arrays([as_arrow(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)


def _put_missed(missed: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard's filter (empty: to be built anew) with the keys that it wrongly took for known ones."""
    raw = filters["filter"][0].as_py()
    if missed.num_rows and raw:
        out = CuckooFilter.frombytes(raw)
        fits = out.count() + missed.num_rows <= 0.95 * out.table.size and out.bulk(missed["k1"].to_numpy())
        raw = out.tobytes() if fits else b""
    return pa.table({"shard": filters["shard"].combine_chunks().slice(0, 1).cast(pa.int32()), "filter": pa.array([raw], pa.binary())})


def _build(keys: pa.Table) -> pa.Table:
    """One shard's filter from its exact keys."""
    return pa.table({"shard": keys["shard"].combine_chunks().slice(0, 1).cast(pa.int32()), "filter": pa.array([CuckooFilter.of(keys["k1"].to_numpy()).tobytes()], pa.binary())})


def _remove(dead: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard without the keys that no document holds any more."""
    if not filters.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
    out = CuckooFilter.frombytes(filters["filter"][0].as_py())
    if dead.num_rows:
        out.remove(dead["k1"].to_numpy())
    return pa.table({"shard": filters["shard"].combine_chunks().slice(0, 1).cast(pa.int32()), "filter": pa.array([out.tobytes()], pa.binary())})


def _shards(docs: DataFrame) -> int:
    """Shards for an index of all docs: a line and key for each newline at most."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    return max(16, lines // SHARD_KEYS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built from half of the documents, and the others are inserted: their keys ask the filters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    late = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    out = LineIndex.build(docs.where(~late), shards=_shards(docs)).insert(docs.where(late)).apply(docs)
    return out.select(unkeyed().alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, x, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.x, coalesce(l.doc_id < k.top, false) AS gone FROM l LEFT JOIN k USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
