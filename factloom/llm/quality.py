"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are numbers of the whole text alone: never labels, lang, source or id.
The trees are fitted on the driver from at most ``sample`` labelled rows, those of
the smallest id hashes among rows that are not held out; only their statistics
reach the driver. Scoring is one pass over the documents without a shuffle.

Null or empty texts get the score of all-zero statistics. Labels that are null are
left out; where a document has several, their mean decides; null ids are held out
and never learnt from. With no label of one class the score is the share of class 1.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .common import as_arrow, keyed, mapped, texts, unkeyed

#: Most labelled rows that a fit takes; the rest of the labels is not needed.
SAMPLE = 20_000
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 sentence mark, 7 symbol, 8 beyond ASCII
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:!?'\"()-"), (7, b"#$%&*+/<=>@[\\]^_`{|}~"), (8, bytes(range(128, 256)))):
    _KIND[list(_chars)] = _k
WIDTH = 30


def stats(text: bytes) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 9)
    n = len(text)
    out[:9] = kinds / n
    p = counts[counts > 0] / n
    out[9] = -(p * np.log2(p)).sum()
    out[10] = np.log1p(n)
    lines = text.split(b"\n")
    out[11] = len(lines) / n
    out[12] = 1 - len(set(lines)) / len(lines)
    words = text.split()
    if words:
        m = len(words)
        lens = np.fromiter(map(len, words), np.int64, m)
        tally = Counter(words)
        low = tally if kinds[2] == 0 else Counter(text.lower().split())
        often = sorted(low.values(), reverse=True)
        out[13] = np.log1p(m)
        out[14], out[15], out[16] = lens.mean(), lens.std(), lens.max()
        out[17] = len(low) / m
        out[18] = len(low) / np.sqrt(m)
        out[19] = often[0] / m
        out[20] = sum(often[:10]) / m
        out[21] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
        out[22] = len(set(zip(words, words[1:], strict=False))) / m
        ends = Counter(w[-1] for w in words)
        out[23] = sum(v for k, v in ends.items() if _KIND[k] in (6, 7)) / m
        out[24] = max((v for k, v in ends.items() if _KIND[k] in (6, 7)), default=0) / m
        out[25] = (lens == 1).sum() / m
        out[26] = (lens > 15).sum() / m
        out[27] = (counts[33] + counts[63]) / m
        out[28] = sum(v for w, v in tally.items() if w.isupper()) / m
        out[29] = (counts[46] + counts[33] + counts[63]) / m
    return out


def held_out(id_col: str | Column, mod: int = 5) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> gbdt.Trees:
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out("_id"))
    rows = rows.groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    few = docs.sparkSession.createDataFrame(picked.toArrow()) if sample else picked

    def each(batch):
        return {"_id": batch.column(0), "y": batch.column(2), "x": [stats(t).tolist() for t in texts(batch)]}

    joined = keyed(docs, id_col, text=text_col).join(F.broadcast(few), "_id").select("_id", "text", "y")
    got = mapped(joined, each, "_id long, y int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, WIDTH)
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T[:3], got["_id"].to_numpy()))  # the same trees whatever order the rows come in
    return gbdt.fit(x[order], y[order])


def score(docs: DataFrame, trees: gbdt.Trees, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """(_id, score) and columns to keep (internal name -> column), a row for each row of docs."""
    keep = keep or {}
    rows = keyed(docs, id_col, text=text_col, **keep)

    def each(batch):
        x = np.stack([stats(t) for t in texts(batch)]) if batch.num_rows else np.zeros((0, WIDTH))
        p = np.concatenate([trees.predict(x[i : i + 1000]) for i in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
        return {"_id": batch.column(0), "score": p} | {k: as_arrow(batch.column(batch.schema.get_field_index(k)), batch.schema.field(k).type) for k in keep}

    extra = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return mapped(rows, each, f"_id long, score double{extra}")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    doc_id = unkeyed()
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
