"""What the training-data operators share: row keys, shared storage, words, hashes.

Conventions for all operators of this subpackage:

* only the named id and text columns are read, so other columns, whatever their
  names, neither clash with internal ones nor reach the result;
* a null text is an empty text;
* a null id is an id of its own, smaller than any other; rows that share an id
  are one document where documents are counted, and each still gets its row;
* an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_KEY = -(2**63)


def keyed(df: DataFrame, id_col: str, **cols: str) -> DataFrame:
    """``_id`` and the given columns under internal names; null ids become NULL_KEY."""
    c = lambda name: F.col(f"`{name}`")
    return df.select(F.coalesce(c(id_col).cast("long"), F.lit(NULL_KEY)).alias("_id"), *[c(v).alias(k) for k, v in cols.items()])


def with_text_key(rows: DataFrame) -> DataFrame:
    """rows (_id, text, ...) with ``_t``, a hash of the text: id and hash together tell rows that share an id apart, so
    joins back to rows go by both, and an id of very many rows (null among them) is no hot key."""
    return rows.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))


def unkeyed(col: Column | str = "_id") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != F.lit(NULL_KEY), col)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A folder of our own is set only where the session names none and runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"/tmp/checkpoints/factloom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made and that nothing reads any more."""
    path = getattr(df, "_factloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(batch: pa.RecordBatch, col: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text of a batch, a null one as b''."""
    for x in batch.column(batch.schema.get_field_index(col)):
        buf = x.as_buffer() if x.is_valid else None
        yield buf.to_pybytes() if buf is not None else b""


def mapped(df: DataFrame, each, schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with each(batch) -> dict of columns or None, typed by schema; batches have at most so many rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    typed = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in (whole.slice(k, rows) for whole in batches for k in range(0, max(1, whole.num_rows), rows)):
            out = each(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in typed], schema=typed)

    return df.mapInArrow(run, schema)


def as_arrow(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    if isinstance(x, np.ndarray) and x.dtype == np.uint64:
        x = x.view(np.int64)
    return pa.array(x, type=kind)


_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes of text that are hashed in one go; a longer text is one go of its own.
SLICE = 1 << 20
#: Bytes of short texts that are hashed in one go, so that what is made of them stays in the processor's cache.
HASHED = 1 << 17


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes methods know only ASCII, as wanted."""
    return text.lower().split()


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as far as asked for so far."""

    base = 0x5851F42D4C957F2F
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, by in (("up", cls.base), ("down", pow(cls.base, -1, 1 << 64))):
                out = np.ones(max(n, SLICE), np.uint64)
                out[1:] = by
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up[:n], cls.down[:n]


#: A random number for each byte, the same for A-Z as for a-z.
_VALUE = np.array([int(xxhash.xxh3_64_intdigest(bytes([k]).lower())) | 1 for k in range(256)], np.uint64)


def _places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word of the texts data[bounds[k]:bounds[k+1]]."""
    solid = (data != 32) & (data - np.uint8(9) > np.uint8(4))
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins = solid & cut[:-1]
    begins[1:] |= solid[1:] > solid[:-1]
    ends = solid & cut[1:]
    ends[:-1] |= solid[:-1] > solid[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[bounds[k]:bounds[k+1]], and the bounds of each text's words.

    A word's hash is a polynomial in its bytes' numbers, from running sums over all bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    first, last = _places(data, bounds)
    up, down = _Powers.to(n)
    value = _VALUE[data] * up
    total = np.cumsum(value, dtype=np.uint64)
    return mixed((total[last] - total[first] + value[first]) * down[first]), np.searchsorted(first, bounds)


def word_hashes(text: bytes) -> np.ndarray:
    return _hashed(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def hashed_rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle hashes) of each text of a string column in order; see shingles()."""
    for data, bounds in _sliced(col):
        h, at = _hashed(data, bounds)
        runs = shingles(h) if len(h) >= 5 else h[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield h[a:b], runs[a : b - 4] if b - a >= 5 else shingles(h[a:b])


def _sliced(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of some texts of a string column in order, and the texts' bounds in them."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(col):
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + HASHED, "right")) - 1)
        m = min(m, len(col))
        yield data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]
        k = m


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def words_at(col: pa.Array, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the words of a string column's texts, counted through from 0, those of the sorted places, some at a time: their
    bytes with A-Z lower-cased, a blank behind each, and their sizes with the blank."""
    seen = 0
    for data, bounds in _sliced(col):
        if not len(data):
            continue
        first, last = _places(data, bounds)
        own = which[slice(*np.searchsorted(which, (seen, seen + len(first))))] - seen
        seen += len(first)
        if len(own):
            size = last[own] - first[own] + 2
            ends = np.cumsum(size)
            found = _LOWER[data[np.minimum(np.repeat(first[own] - ends + size, size) + np.arange(ends[-1]), len(data) - 1)]]
            found[ends - 1] = 32
            yield found, size


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique without its overhead on short arrays."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; of the whole sequence where there are fewer; none without words."""
    n = len(h)
    if not n:
        return h
    mul = _MUL if size == 5 else mixed(np.arange(1, size + 1, dtype=np.uint64) * _MUL[0]) | np.uint64(1)
    if n < size:
        return mixed(np.array([(h * mul[:n]).sum() + np.uint64(n)], np.uint64))
    out = h[: n - size + 1] * mul[0]
    for i in range(1, size):
        out = out + h[i : n - size + 1 + i] * mul[i]
    return mixed(out)
