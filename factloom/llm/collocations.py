"""Phrase collocations: exact counts in arrays by slots of a minimal perfect hash over Apriori-safe candidates.

1. Every task hashes its phrases of 1 to 5 words into ``2^BUCKETS`` saturating counters a
   length, two independent arrays of them; the arrays of all tasks are summed in a tree. A
   phrase can be frequent only if both its buckets are, and so are its first and its last words
   but one: the resulting bit maps are broadcast. Larger corpora have more buckets (up to ``2^WIDEST``), a bucket for
   every ``LOAD`` bytes, so that rare phrases don't fill them. Counters that are more than ``ROUND`` in all are filled in rounds,
   some lengths or a range of the buckets at a time, and longer phrases are counted only where the maps of shorter ones let them through.
2. The distinct phrases that pass are the candidates; a frequent phrase is always among
   them. Tasks give them as arrays of keys (128 bits a phrase), a bounded number at a time, united in a tree.
3. For each block of about ``BLOCK`` candidates the driver makes a minimal perfect hash of its keys,
   which are stored at the slots and compared at every lookup, and broadcasts it. Tasks count occurrences by
   slot with bincount, and note by slot the smallest of 2^16 marks of the texts that hold it; pieces of these
   arrays are summed (or their least taken) in a tree. A last pass spells frequent phrases where the text has that mark.
4. The lengths l and r of a phrase's cuts are read by the slots of its parts; the lowest
   score counts, in decimals of 38 digits. Phrases inside one that is as frequent are
   dropped: it is enough to look at phrases that are one word longer, as what lies between
   is as frequent too.

Phrases stay within pieces of text, so long texts are cut between pieces, never in a
phrase; a slice is ``SLICE`` bytes or one piece. Whole texts of all documents are counted, whatever
their ids. A corpus of more than ``BLOCK`` candidates is read once more for each further
block, so these reads grow with the number of candidates.

A null text is empty, a null language "und". Ids play no part: rows that repeat count as often as they
stand there. No text: no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _MUL, SLICE, _Powers, dropped, mapped, mixed, written
from .mph import PerfectHash

LEAST, LONGEST, TOP = 100, 5, 2000
BUCKETS, BLOCK, PIECE, FAN, SHARDS, SALTS = 22, 4_000_000, 1 << 16, 16, 256, 32
MARKS = 1 << 16
WIDEST, LOAD, ROUND, HELD = 26, 420, 10 << 23, 1 << 20

#: floor(1000 * a * n / (l * r)) in decimals of 38 digits.
SCORE = "cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"

_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_VALUES = [np.array([xxhash.xxh3_64_intdigest(bytes([k]), seed) | 1 for k in range(256)], np.uint64) for seed in (1, 2)]


class Grams:
    """The phrases of some texts: (lang, text) with a seed a language in each of two hashes."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray):
        self.data = b"\n".join(texts).lower()
        data = np.frombuffer(self.data, np.uint8)
        kind = _KIND[data]
        solid = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        self.first, self.last = edge[::2], edge[1::2] - 1
        self.piece = np.cumsum(kind == 2)[self.first] if len(self.first) else self.first
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.first, "right")
        self.marks = np.array([xxhash.xxh3_64_intdigest(t) % MARKS for t in texts], np.uint16)
        up, down = _Powers.to(len(data))
        self.words, self.seeds = [], seeds[:, self.text] if len(texts) else seeds
        for value in _VALUES:
            each = value[data] * up
            total = np.cumsum(each, dtype=np.uint64)
            self.words.append(mixed((total[self.last] - total[self.first] + each[self.first]) * down[self.first]) if len(self.first) else total)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, where they start, both hashes) of the phrases of each length."""
        n = len(self.first)
        sums = [s.copy() for s in self.seeds]
        at = np.arange(n)
        for k in range(1, LONGEST + 1):
            m = n - k + 1
            if m <= 0:
                return
            sums = [s[:m] + w[k - 1 :] * _MUL[k - 1] for s, w in zip(sums, self.words, strict=True)]
            inside = np.flatnonzero(self.piece[:m] == self.piece[k - 1 :])
            yield k, at[inside], mixed(sums[0][inside] + np.uint64(k)), mixed(sums[1][inside] ^ np.uint64(k))

    def spelled(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[a : b + 1] for a, b in zip(self.first[at : at + k].tolist(), self.last[at : at + k].tolist(), strict=True))


def seeded(lang: str) -> tuple[int, int]:
    raw = lang.encode()
    return xxhash.xxh3_64_intdigest(raw, 3), xxhash.xxh3_64_intdigest(raw, 4)


def sliced(text: bytes) -> Iterator[bytes]:
    """Parts of at most SLICE bytes, cut between pieces; a longer piece is a part of its own."""
    while len(text) > SLICE:
        cut = max(text.rfind(bytes([c]), 0, SLICE) for c in np.flatnonzero(_KIND == 2).tolist())
        if cut < 0:
            cut = min((p for c in np.flatnonzero(_KIND == 2).tolist() if (p := text.find(bytes([c]), SLICE)) >= 0), default=len(text))
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


def gathered(batches) -> Iterator[tuple[Grams, list[str]]]:
    """Phrases of slices of the texts of all batches (lang, text), and each slice's languages."""
    texts, langs, size = [], [], 0

    def made():
        return Grams(texts, np.array([seeded(x) for x in langs], np.uint64).T.reshape(2, -1)), langs

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            buf = raw.as_buffer() if raw.is_valid else None
            for part in sliced(buf.to_pybytes() if buf is not None else b""):
                if size + len(part) > SLICE and texts:
                    yield made()
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part) + 1
    if texts:
        yield made()


def _bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).view(bool)


def passing(grams: Grams, maps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """grams without phrases that can't be frequent by their own buckets or their parts'; maps: of the first lengths or of all."""
    shift = np.uint64(64 - bits)
    before = None
    for k, at, h1, h2 in grams:
        if before is not None:
            ok = before[at] & before[at + 1]
            at, h1, h2 = at[ok], h1[ok], h2[ok]
        for a in (0, 1) if k <= len(maps) else ():
            ok = _bit(maps[k - 1, a], ((h1, h2)[a] >> shift).astype(np.int64))
            at, h1, h2 = at[ok], h1[ok], h2[ok]
        before = np.zeros(len(grams.first) + 1, bool)
        before[at] = True
        yield k, at, h1, h2


def _tree(pieces: DataFrame, name: str, merge) -> DataFrame:
    """(block, piece, node, data) of all nodes merged in a tree, FAN at a time: merge(list of data) -> data."""

    def merged(table: pa.Table) -> pa.Table:
        out = merge(table["data"].to_pylist())
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "piece": table["piece"][:1].cast(pa.int32()), "node": table["node"][:1].cast(pa.int64()), "data": pa.array([out], pa.binary())})

    now = pieces
    while now.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] > 0:
        up = now.select("block", "piece", F.expr(f"node div {FAN}").alias("node"), "data")
        new = written(up.groupBy("block", "piece", "node").applyInArrow(merged, ARRAYS), name)
        dropped(now)
        now = new
    return now


def summed(pieces: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """Arrays added up, to at most ``most`` an entry where given."""

    def merge(parts):
        total = np.zeros(PIECE, np.int64)
        for raw in parts:
            total += _unpacked(raw, kind)
        return _packed((np.minimum(total, most) if most else total).astype(kind))

    return _tree(pieces, "sums", merge)


def least_of(pieces: DataFrame, kind: str) -> DataFrame:
    return _tree(pieces, "least", lambda parts: _packed(np.minimum.reduce([_unpacked(raw, kind) for raw in parts])))


def united(pieces: DataFrame) -> DataFrame:
    """Sets of keys united; a set is its first halves, then its second halves, in order."""
    return _tree(pieces, "keys", lambda parts: _set(*(np.concatenate(x) for x in zip(*map(_halves, parts), strict=True))))


def _halves(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(2, -1)


def _set(h1: np.ndarray, h2: np.ndarray) -> bytes:
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1[new].tobytes() + h2[new].tobytes()


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, kind: str, n: int = PIECE) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _pieces(block: int, x: np.ndarray, node: int, empty: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """Pieces of PIECE entries; what is missing is empty."""
    for k in range(0, len(x), PIECE):
        part = x[k : k + PIECE]
        if (part != empty).any():
            yield block, k // PIECE, node, _packed(np.pad(part, (0, PIECE - len(part)), constant_values=empty))


def _joined(pieces: DataFrame, kind: str, n: int, empty: int = 0) -> np.ndarray:
    out = np.full(n, empty, kind)
    for r in pieces.collect():  # of a bounded block
        part = _unpacked(r.data, kind)[: n - r.piece * PIECE]
        out[r.piece * PIECE : r.piece * PIECE + len(part)] = part
    return out


def _batch(rows, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


ARRAYS = "block int, piece int, node long, data binary"
_ARRAYS = {"block": pa.int32(), "piece": pa.int32(), "node": pa.int64(), "data": pa.binary()}


def bits_for(docs: DataFrame, least: int = BUCKETS) -> int:
    """How many bits number the buckets of a length, by the size of all texts; docs: lang, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, min(WIDEST, int(np.ceil(np.log2(max(1, size / LOAD))))))


def rounds(bits: int, most: int) -> list[tuple[range, int, int]]:
    """(lengths, first bucket, end) of what is counted at a time, at most so many counters; shorter phrases come first."""
    top = 1 << bits
    at_once = most // (2 * top)
    if at_once:
        return [(range(k, min(k + at_once, LONGEST + 1)), 0, top) for k in range(1, LONGEST + 1, at_once)]
    step = max(PIECE, most // 2 // PIECE * PIECE)
    return [(range(k, k + 1), low, min(low + step, top)) for k in range(1, LONGEST + 1) for low in range(0, top, step)]


def _buckets(maps, lengths: range, low: int, high: int, bits: int, limit: int):
    """Counters of one round as arrays, and the words of each language; maps: of all shorter phrases."""
    shift = np.uint64(64 - bits)

    def run(batches):
        counts = np.zeros((2 * len(lengths), high - low), np.uint8)
        held: list[list[np.ndarray]] = [[] for _ in counts]

        words: dict[str, int] = {}

        def flush(k):
            x = np.sort(np.concatenate(held[k]))
            cut = np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]])
            n = np.diff(cut, append=len(x))
            counts[k, x[cut]] = np.minimum(counts[k, x[cut]] + np.minimum(n, limit), limit)
            held[k] = []

        for grams, langs in gathered(batches):
            for t, n in zip(*np.unique(grams.text, return_counts=True), strict=True):
                words[langs[t]] = words.get(langs[t], 0) + int(n)
            for k, _, h1, h2 in passing(grams, maps.value, bits):
                if k >= lengths.stop:
                    break
                for a, h in enumerate((h1, h2)) if k in lengths else ():
                    row, at = 2 * (k - lengths.start) + a, (h >> shift).astype(np.uint32)
                    held[row].append(at if high - low == 1 << bits else at[(at >= low) & (at < high)] - np.uint32(low))
                    if sum(map(len, held[row])) > HELD:
                        flush(row)
        for k in range(len(counts)):
            if held[k]:
                flush(k)
        node = TaskContext.get().partitionId()
        more = _ARRAYS | {"lang": pa.string(), "n": pa.int64()}
        for k, row in enumerate(counts):
            yield _batch([(b, low // PIECE + piece, *r, None, None) for b, piece, *r in _pieces(2 * lengths.start - 2 + k, row, node)], more)
        if lengths.start == 1 and low == 0:
            yield _batch([(None, None, None, None, *r) for r in words.items()], more)

    return run


def bucket_maps(docs: DataFrame, least: int, bits: int, most: int = ROUND) -> tuple[np.ndarray, DataFrame]:
    """Which buckets of each length and hash have at least so many phrases; and (lang, n), the words of each language."""
    spark, limit, words = docs.sparkSession, min(255, least), None
    out = np.zeros((LONGEST, 2, (1 << bits) // 8), np.uint8)

    def bits_of(batch):
        rows = [np.packbits(_unpacked(x, "u1") >= limit).tobytes() for x in batch.column(2).to_pylist()]
        return {"block": batch.column(0), "piece": batch.column(1), "data": pa.array(rows, pa.binary())}

    for lengths, low, high in rounds(bits, most):
        maps = spark.sparkContext.broadcast(out[: lengths.start - 1])
        # Counts saturate at the limit, and so do their sums.
        both = written(docs.mapInArrow(_buckets(maps, lengths, low, high, bits, limit), f"{ARRAYS}, lang string, n long"), "buckets")
        total = summed(both.where("lang is null").drop("lang", "n"), "u1", limit)
        for r in mapped(total.select("block", "piece", "data"), bits_of, "block int, piece int, data binary").toLocalIterator():  # of a bounded size
            out[r.block // 2, r.block % 2, r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(r.data, np.uint8)
        words = both.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")) if words is None else words
        maps.unpersist()
    return out, words


class Slots:
    """Candidates' keys, with a perfect hash for each block of them, and counts by slot. keys: of united()."""

    def __init__(self, keys: DataFrame, block: int):
        self.spark, self.keys = keys.sparkSession, keys
        self.blocks: list[list[int]] = [[]]
        held = 0
        for piece, n in keys.select("piece", (F.length("data") / 16).cast("long")).orderBy("piece").collect():  # a row a shard
            if held + n > block and self.blocks[-1]:
                self.blocks.append([])
                held = 0
            self.blocks[-1].append(piece)
            held += n
        self.counts: list[np.ndarray | DataFrame] = []

    def table(self, b: int) -> PerfectHash:
        """Of the keys of one block, so of a bounded number; slots don't depend on their order."""
        rows = self.keys.where(F.col("piece").isin(self.blocks[b])).select("data").collect() if self.blocks[b] else []
        return PerfectHash(*(np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*(_halves(r.data) for r in rows), strict=True) if rows else ([], []))))

    def read(self, rows: DataFrame, each, schema: str, name: str) -> DataFrame:
        """each(batch, table, counts) of all rows with every block in turn, one block at a time being broadcast."""
        parts = []
        for b in range(len(self.blocks)):
            table = self.table(b)
            shared = self.spark.sparkContext.broadcast((table, _joined(self.counts[b], "i8", len(table))))
            parts.append(written(mapped(rows, lambda batch, shared=shared: each(batch, *shared.value), schema, 20_000), name))
            shared.unpersist()
        return reduce(DataFrame.unionByName, parts)


def _keys(batch, *at: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy().view(np.uint64) for i in at]


def _sorted_pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs; one may be left twice if others share its first half."""
    h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h1)
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1[new], h2[new]


def counted(docs: DataFrame, least: int = LEAST, bits: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Slots]:
    """(h1, h2, k, lang, phrase, f) of all phrases of 1 to 5 words that stand at least so often in a language's texts,
    (lang, n) of the words of each language, and the counts by slot; docs: lang, text."""
    spark = docs.sparkSession
    bits = bits_for(docs) if bits is None else bits
    found, words = bucket_maps(docs, least, bits)
    maps = spark.sparkContext.broadcast(found)

    def distinct(batches):
        held, n, sets = [], 0, 0

        def shards():
            h1, h2 = held[0]
            shard = (h2 % np.uint64(SHARDS)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            # A task's sets stand in one group of the tree, so they are united first.
            node = TaskContext.get().partitionId() * FAN + sets % FAN
            some = ((k, order[cut[k] : cut[k + 1]]) for k in range(SHARDS))
            return _batch([(0, k, node, _set(h1[at], h2[at])) for k, at in some if len(at)], _ARRAYS)

        for grams, _ in gathered(batches):
            for _, _, h1, h2 in passing(grams, maps.value, bits):
                held.append((h1, h2))
                n += len(h1)
            if n > HELD:
                held = [_sorted_pairs(held)]
                n = 0
                if len(held[0][0]) > HELD:
                    yield shards()
                    held, sets = [], sets + 1
        if held:
            held = [_sorted_pairs(held)]
            yield shards()

    slots = Slots(united(written(docs.mapInArrow(distinct, ARRAYS), "candidates")), block)
    phrases = []
    for b in range(len(slots.blocks)):
        table = slots.table(b)
        shared = spark.sparkContext.broadcast(table)
        both = written(docs.mapInArrow(_counting(shared, maps, bits), ARRAYS), "counts")
        slots.counts.append(summed(both.where("block = 0"), "i8"))
        marks = _joined(least_of(both.where("block = 1"), "u2"), "u2", len(table), MARKS - 1)
        read = spark.sparkContext.broadcast((table, _joined(slots.counts[b], "i8", len(table)), marks))
        schema = "h1 long, h2 long, k int, lang string, phrase string, f long"
        spelled = docs.mapInArrow(_spelling(read, maps, bits, least), schema).groupBy("h1", "h2")
        phrases.append(written(spelled.agg(*[F.first(c).alias(c) for c in ("k", "lang", "phrase", "f")]), "phrases"))
        shared.unpersist()
        read.unpersist()
    return reduce(DataFrame.unionByName, phrases), words, slots


def _counting(shared, maps, bits: int):
    """Counts (block 0) and least marks (block 1) by slot."""

    def run(batches):
        table = shared.value
        counts, marks, held, n = np.zeros(len(table), np.int64), np.full(len(table), MARKS - 1, np.uint16), [], 0
        for grams, _ in gathered(batches):
            for _, at, h1, h2 in passing(grams, maps.value, bits):
                slots = table.slots(h1, h2)
                known = slots >= 0
                held.append(slots[known])
                n += len(held[-1])
                np.minimum.at(marks, held[-1], grams.marks[grams.text[at[known]]])
            if n > 1 << 21:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n = [], 0
        if n:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        node = TaskContext.get().partitionId()
        yield _batch([*_pieces(0, counts, node), *_pieces(1, marks, node, MARKS - 1)], _ARRAYS)

    return run


def _spelling(read, maps, bits: int, least: int):
    """Frequent phrases as their texts with the least mark have them, once a task."""
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "k": pa.int32(), "lang": pa.string(), "phrase": pa.string(), "f": pa.int64()}

    def run(batches):
        table, counts, marks = read.value
        open_ = counts >= least
        for grams, langs in gathered(batches):
            rows = []
            for k, at, h1, h2 in passing(grams, maps.value, bits):
                slots = table.slots(h1, h2)
                some = np.flatnonzero((slots >= 0) & open_[slots])
                some = some[marks[slots[some]] == grams.marks[grams.text[at[some]]]]
                _, first = np.unique(slots[some], return_index=True)
                some = some[first]
                open_[slots[some]] = False
                rows += [(a, b, k, langs[t], grams.spelled(i, k).decode(), f) for a, b, t, i, f in zip(h1[some].view(np.int64).tolist(), h2[some].view(np.int64).tolist(), grams.text[at[some]].tolist(), at[some].tolist(), counts[slots[some]].tolist(), strict=True)]
            yield _batch(rows, kinds)

    return run


def with_parts(frequent: DataFrame) -> DataFrame:
    """(h1, h2, lang, phrase, a, cuts) of phrases of 2 words and more: each cut with both keys of its first and its last words."""

    def each(batch):
        langs, phrases = batch.column(2).to_pylist(), [p.encode() for p in batch.column(3).to_pylist()]
        grams = Grams(phrases, np.array([seeded(x) for x in langs], np.uint64).T.reshape(2, -1))
        begins = np.searchsorted(grams.text, np.arange(len(phrases))).tolist()
        by = {(k, i): (a, b) for k, at, h1, h2 in grams for i, a, b in zip(at.tolist(), h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True)}
        cuts = [[(c, *by[c, s], *by[n - c, s + c]) for c in range(1, n)] for s, n in zip(begins, batch.column(4).to_pylist(), strict=True)]
        return {"cuts": [[dict(zip(("cut", "l1", "l2", "r1", "r2"), c, strict=True)) for c in x] for x in cuts]} | {c: batch.column(i) for i, c in enumerate(("h1", "h2", "lang", "phrase"))} | {"a": batch.column(5)}

    return mapped(frequent.where("k > 1").select("h1", "h2", "lang", "phrase", "k", "f"), each, "h1 long, h2 long, lang string, phrase string, a long, cuts array<struct<cut:int,l1:long,l2:long,r1:long,r2:long>>")


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language."""
    docs = documents.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    frequent, words, slots = counted(docs, least, bits, block)
    phrases = written(with_parts(frequent), "phrase-parts")
    # Every phrase names the two that are a word shorter; they are dropped where it is as frequent.
    ends = F.array(F.struct(F.col("cuts")[0]["r1"].alias("h1"), F.col("cuts")[0]["r2"].alias("h2")), F.struct(F.element_at("cuts", -1)["l1"].alias("h1"), F.element_at("cuts", -1)["l2"].alias("h2")))
    most = phrases.where(F.size("cuts") > 1).select("a", F.explode(ends).alias("s")).groupBy("s.h1", "s.h2").agg(F.max("a").alias("most"))
    kept = written(phrases.join(most, ["h1", "h2"], "left").where("most is null or most < a").drop("most"), "phrases-kept")

    def read(batch, table, counts):
        look = np.append(counts, 0)
        return {"l": look[table.slots(*_keys(batch, 3, 4))], "r": look[table.slots(*_keys(batch, 5, 6))]} | {c: batch.column(i) for i, c in enumerate(("h1", "h2", "cut"))}

    asked = kept.select("h1", "h2", F.explode("cuts").alias("c")).select("h1", "h2", "c.*")
    cuts = slots.read(asked, read, "h1 long, h2 long, cut int, l long, r long", "cuts").groupBy("h1", "h2", "cut").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    # The words of a language stand under salts, as one language may have most phrases.
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = kept.select("h1", "h2", "lang", "phrase", "a", F.pmod("h1", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["lang", "salt"])
    lowest = cuts.join(own, ["h1", "h2"]).withColumn("score", F.expr(SCORE)).groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n", "salt")], F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    out = lowest.select("lang", "phrase", "a", "n", "salt", F.col("low.score").alias("score"), F.col("low.l").alias("l"), F.col("low.r").alias("r"))
    for keys in (["lang", "salt"], ["lang"]):  # the first of each salt hold the first of all
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) AS ks(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
subs AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, c.f
    FROM cand c, range(2, 5) AS ms(m), range(1, 5) AS js(i) WHERE m < c.k AND i + m - 1 <= c.k)
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, j, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c JOIN range(1, 5) AS js(j) ON j < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
ranked AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN subs s ON s.lang = low.lang AND s.phrase = low.phrase
  WHERE o = 1 AND (s.most IS NULL OR 100 * s.most < 100 * a))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
