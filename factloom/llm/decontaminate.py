"""Benchmark decontamination: size-partitioned MinHash containment search.

Sets are five-word shingles (A-Z lower-cased; a text with fewer words is one
shingle, one without words an empty set). An item is found in a document that
holds at least 80% of the item's shingles. Items are short and documents long, so
the Jaccard similarity of the two says little; containment is searched from the
item's side instead. Items are partitioned by set size into powers of two; in each
partition an item is sketched by its k smallest shingle hashes (bottom-k MinHash),
where k = n - ceil(0.8 n) + 1 is the least number of which a document with enough
of the item must hold one: no item above the threshold can be missed. A document
visits the partitions whose items it can contain, and candidates are verified by
exact containment of the shingles as words, not hashes.

Items are broadcast in blocks of about ``block_bytes`` of text with its sketches (less
than twice that), one pass over the documents a block, so what is broadcast is bounded
whatever the benchmark's size; the shingles of an item are made when it is a candidate.
Items of an id stand in one block. Documents are never shuffled; rows that repeat a
document each have their results. Empty items and documents match nothing; rows that
repeat an item count once; null ids are ids of their own.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, hashed_rows, keyed, mapped, shingles, texts, unkeyed, word_hashes, words

WORDS, SHARE = 5, (80, 100)
BLOCK_BYTES = 16_000_000


def word_shingles(found: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


class ItemIndex:
    """One block of items: per size partition, sorted sketch hashes and whose they are."""

    def __init__(self, items: list[tuple[int, bytes]], share: tuple[int, int] = SHARE):
        self.items = [(i, text) for i, text in items if words(text)]
        parts = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            sketch = distinct(shingles(word_hashes(text)))
            n = len(word_shingles(words(text)))
            need = -(-share[0] * n // share[1])
            parts[n.bit_length()].append((need, k, sketch[: n - need + 1]))
        self.parts = []
        for rows in parts.values():
            hashes, owner = np.concatenate([x[2] for x in rows]), np.repeat([x[1] for x in rows], [len(x[2]) for x in rows])
            order = np.argsort(hashes, kind="stable")
            self.parts.append((min(x[0] for x in rows), hashes[order], owner[order]))
        self.share = share

    def candidates(self, sh: np.ndarray) -> set[int]:
        out: set[int] = set()
        for least, hashes, owner in self.parts:
            if len(sh) >= least:
                at = np.searchsorted(hashes, sh)
                at[at == len(hashes)] = 0
                for h in np.unique(sh[hashes[at] == sh]):
                    out.update(owner[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, "right")].tolist())
        return out

    def found(self, text: bytes, sh: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, how many of them the text holds) for the items found in a text of these shingle hashes."""
        near = self.candidates(sh)
        if not near:
            return []
        own = word_shingles(words(text))
        hits = ((self.items[k][0], len(s := word_shingles(words(self.items[k][1]))), len(s & own)) for k in near)
        return [x for x in hits if self.share[1] * x[2] >= self.share[0] * x[1]]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: tuple[int, int] = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_id, _item, n_item, n_shared) for each document row and item found in it."""
    rows = keyed(docs, id_col, text=text_col)
    parts = [mapped(rows, _finder(index), "_id long, _item long, n_item long, n_shared long") for index in _blocks(items, item_id, item_text, share, block_bytes)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: tuple[int, int] = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item, each judged by itself, whatever its id: one pass a block, no shuffle."""
    for index in _blocks(items, item_id, item_text, share, block_bytes):

        def held(batches, index=index):
            for batch in batches:
                col = batch.column(batch.schema.get_field_index(text_col))
                good = [not index.value.found(text, sh) for text, (_, sh) in zip(texts(batch, text_col), hashed_rows(col), strict=True)]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(held, docs.schema)
    return docs


def _blocks(items: DataFrame, item_id: str, item_text: str, share: tuple[int, int], block_bytes: int):
    """Broadcast indexes of the items, one for each block of them."""
    short = keyed(items, item_id, text=item_text).where("text is not null").distinct()
    total = short.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        block = short.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b)
        found = block.toArrow()  # in one job; an iterator would start one for each partition
        own = sorted(zip(found["_id"].to_pylist(), (x.encode() for x in found["text"].to_pylist()), strict=True))
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(own, share))


def _finder(index):
    def each(batch):
        each = zip(batch.column(0).to_pylist(), texts(batch), hashed_rows(batch.column(1)), strict=True)
        rows = [(i, *hit) for i, text, (_, sh) in each for hit in sorted(set(index.value.found(text, sh)))]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return dict(zip(("_id", "_item", "n_item", "n_shared"), map(list, cols), strict=True))

    return each


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = leaks(docs, items)
    return out.select(unkeyed().alias("doc_id"), unkeyed("_item").alias("item_id"), "n_item", "n_shared")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Distinct five-word shingles of a list w of words, as strings.
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, {_SHINGLES} AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
u AS (SELECT item_id, len(l) AS n_item, unnest(l) AS s FROM i)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN u USING (s)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
