"""Exact substring dedup with run-length BWT indexes and streamed matching statistics.

Every whole text counts as UTF-8 bytes; a byte goes if a string of ``length`` bytes
covers it that also starts earlier (in a smaller id, or before in the same document).

1. Equal texts are one class. All but its smallest id go whole (from ``length`` bytes
   on); only that one is looked at from here on.
2. Anchors: of every window of ``length`` bytes the K-gram with the smallest hash
   (winnowing). Equal strings of that length have an equal anchor at an equal place,
   so where no anchor repeats nothing does. Only hashes and places are shuffled.
3. Anchors whose documents have the same smallest hash form a group; each document's
   regions around a group's anchors, joined where they overlap, meet in the group. A frequent anchor is
   a group of its own, and salted where anchors are counted. All strings that repeat
   are together in some group. Equal regions are one, the later ones going whole.
4. Regions, in corpus order and cut into pieces that overlap, are indexed: the suffix
   order gives the BWT, kept as runs with a run's head, symbol and LF target. Of the
   intervals of rows that share ``length`` bytes, those that hold a run's end, or where
   images of several intervals meet, have their earliest place sampled; any other is the
   image of a whole interval within a run, and its earliest place is the one before.
   Pieces are then streamed from their ends through the runs by LF steps, carrying the
   matching statistic and the earliest place of the match from sample to sample; where
   that is before the piece's own place, the bytes are marked.
5. Marks are joined by document, and cut out of its text.

Null text: empty. Rows that repeat id and text are one document and get equal rows;
rows that share an id with other texts are documents in the order of their hashes.
Null ids are one id, smaller than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _Powers, keyed, mapped, mixed, SLICE, texts, unkeyed, with_text_key, written

LENGTH, K = 100, 40
PIECE, INDEX_BYTES = 400, 1_000_000
#: Times in one batch of rows from which an anchor is frequent, and the parts that it is salted into.
FREQUENT, SALTS = 16, 64
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([k, 1])) | 1 for k in range(256)], np.uint64)


def _sliding(x: np.ndarray, width: int, by) -> np.ndarray:
    """by (minimum or maximum) over x[i : i + width], for each i that has all of them."""
    size = 1
    while 2 * size <= width:
        x = by(x[: len(x) - size], x[size:])
        size *= 2
    return by(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the texts data[bounds[i]:bounds[i+1]]; places count from the start of data."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _Powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up, out=total[1:])
    h = mixed((total[k:] - total[:-k]) * down[: n - k + 1])
    w = length - k + 1
    least = _sliding(h, w, np.minimum)  # of the window of length bytes from i on
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    least = np.where(room[: len(least)] >= length, least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)  # over the windows that hold the K-gram
    at = np.flatnonzero((best == h) & (best > 0))
    return at, h[at]


def _sliced(batch: pa.RecordBatch, col: int):
    """(first row, texts' bounds, bytes) of slices of whole texts."""
    c = batch.column(col).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(c):
        m = min(len(c), max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1))
        yield k, offsets[k : m + 1] - offsets[k], data[offsets[k] : offsets[m]]
        k = m


def _halves(text: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(text), "<i8")
    return int(a), int(b)


def _repeated(batches):
    """Of rows (a, h, pos, often) sorted by a and salt: those of anchors at more than one place, with their group g."""
    held = None
    names = ["a", "h", "pos", "g"]

    def chosen(a, h, pos, often):
        if not len(a):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], names=names)
        order = np.lexsort((pos, h, a))
        a, h, pos, often = (x[order] for x in (a, h, pos, often))
        new = np.r_[True, a[1:] != a[:-1]]
        own = np.r_[True, (h[1:] != h[:-1]) | (pos[1:] != pos[:-1])] | new
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        places = np.add.reduceat(own.astype(np.int64), start)
        hot = np.maximum.reduceat(often, start) > 0
        group = np.where(hot, a[start], np.minimum.reduceat(np.where(pos >= 0, h, np.iinfo(np.int64).max), start))
        keep = own & ((places > 1) | hot)[run] & (pos >= 0)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(h[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(group[run][keep])], names=names)

    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        a = cols[0]
        done = int(np.searchsorted(a, a[-1])) if len(a) else 0
        held = [x[done:] for x in cols]
        yield chosen(*(x[:done] for x in cols))
    if held is not None:
        yield chosen(*held)


class RunIndex:
    """Run-length BWT of pieces of bytes, with the earliest places sampled at intervals that hold run ends.

    What is kept after building grows with the runs, not the bytes: run heads, symbols and LF targets, and the samples."""

    def __init__(self, pieces: list[bytes], places: np.ndarray, length: int = LENGTH):
        """places: where each piece starts in the corpus, as numbers in corpus order that rise by 1 a byte."""
        self.length = length
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.sizes = sizes
        n = int((sizes + 1).sum())
        ends = self.starts + sizes
        sym = np.zeros(n + 7, np.uint64)
        sym[:n] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
        sym[ends] = 0
        rank, ready = self._ranks(sym, n, ends), 7
        half, open_ = None, np.arange(n)
        while half is None or len(open_):
            if 2 * ready >= length and half is None:
                half = (ready, rank)
            rank, open_ = self._doubled(rank, open_, ready)
            ready *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        # Rows whose suffixes share length bytes: equal in both halves of them.
        size, r = half or (ready, rank)
        back = order + (length - size)
        a, b = r[order], np.where(back < n, r[np.minimum(back, n - 1)], -1)
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        first = np.flatnonzero(fresh)
        size = np.diff(np.r_[first, n])
        self.places = places
        place = (np.repeat(places - self.starts, sizes + 1) + np.arange(n))[order]
        earliest = np.minimum.reduceat(place, first)
        # Runs of the BWT; a separator is a symbol of its own, 0.
        bwt = np.where(order > 0, sym[order - 1], 0).astype(np.int64)
        self.head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.char = bwt[self.head]
        run = np.diff(np.r_[self.head, n])
        # An interval needs no sample of its own if it is the LF image of a whole interval within one run: the earliest
        # place is then one less. Those that hold the end of a run, or lie where such an image meets others, are sampled.
        after = (np.cumsum(fresh) - 1)[rank[np.minimum(order + 1, n - 1)]]
        low, high = np.minimum.reduceat(after, first), np.maximum.reduceat(after, first)
        sampled = (low != high) | (size[low] != size) | (order[first] == n - 1)
        self.sampled = first[sampled]
        self.sampled_end = (first + size)[sampled]
        self.samples = earliest[sampled]
        by_char = np.argsort(self.char, kind="stable")
        self.lf = np.empty(len(self.head), np.int64)
        self.lf[by_char] = np.cumsum(run[by_char]) - run[by_char]

    @staticmethod
    def _ranks(sym: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
        """Ranks by 7 symbols, a separator and what follows it counting as the number of its piece."""
        to_end = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = key << np.uint64(9) | np.where(to_end >= k, sym[k : n + k], np.uint64(0))
        order = np.argsort(key, kind="stable")  # ties stand in text order, which is the order of their pieces
        s = key[order]
        near = to_end[order] < 7
        new = np.r_[True, (s[1:] != s[:-1]) | near[1:] | near[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return rank

    @staticmethod
    def _doubled(rank: np.ndarray, open_: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by twice as many symbols, and the rows that may share theirs; only such rows (open_) are sorted anew."""
        n = len(rank)
        own = rank[open_]
        tied = np.bincount(own, minlength=n)[own] > 1
        open_, own = open_[tied], own[tied]
        if not len(open_):
            return rank, open_
        after = np.where(open_ + by < n, rank[np.minimum(open_ + by, n - 1)], -1) + 1
        key = own * np.int64(n + 1) + after
        order = np.argsort(key)
        at, r, key = open_[order], own[order], key[order]
        first = np.r_[True, r[1:] != r[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(at))
        base = np.maximum.accumulate(np.where(first, index, 0))
        place = np.maximum.accumulate(np.where(new, index, 0))
        out = rank.copy()
        out[at] = r + (place - base)
        alone = new & np.r_[new[1:], True]
        return out, at[~alone]

    def statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams all pieces from their ends at once; at each step (pieces, places in the text, matching statistics, earliest places).

        A statistic is the length of a match with the earliest place known, from ``length`` on: a step to an image of
        a whole interval lengthens it and moves its place back by one; at a sampled interval it begins anew."""
        live = np.arange(len(self.sizes))
        row = live.copy()  # separators have the first rows, in the order of the pieces
        at = self.starts + self.sizes
        ends = at.copy()
        match = np.zeros(len(live), np.int64)
        held = np.zeros(len(live), np.int64)
        while len(live):
            go = at > self.starts[live]
            live, row, at, match, held = (x[go] for x in (live, row, at, match, held))
            run = np.searchsorted(self.head, row, "right") - 1
            row = self.lf[run] + row - self.head[run]
            at = at - 1
            full = np.flatnonzero(ends[live] - at >= self.length)
            if not len(full):
                continue
            own = self.places[live[full]] + at[full] - self.starts[live[full]]
            k = np.searchsorted(self.sampled, row[full], "right") - 1
            new = (k >= 0) & (row[full] < self.sampled_end[k])
            # Before its first sample a piece's windows are alone in their intervals.
            held[full] = np.where(new, self.samples[k], np.where(match[full] > 0, held[full] - 1, own))
            match[full] = np.where(new | (match[full] == 0), self.length, match[full] + 1)
            yield live[full], at[full], match[full], held[full]

    def marks(self) -> np.ndarray:
        """For each byte of the text (separators too): whether length bytes from here on start earlier."""
        out = np.zeros(int((self.sizes + 1).sum()), bool)
        for piece, at, _, earliest in self.statistics():
            out[at] = earliest < self.places[piece] + at - self.starts[piece]
        return out


def _spans(batches, length: int = LENGTH):
    """Of regions (g, _id, h, start, bytes) sorted by group and corpus order: marked spans (_id, h, s, e)."""
    ready: list[tuple[int, int, int, bytes]] = []
    out: list[tuple[int, int, int, int]] = []

    def indexed():
        pieces, whose = [], []
        for i, h, start, raw in ready:
            for k in range(0, max(1, len(raw) - length + 1), PIECE):
                pieces.append(raw[k : k + PIECE + length - 1])
                whose.append((i, h, start + k))
        if len(pieces) > 1:
            docs = {d: k for k, d in enumerate(sorted({w[:2] for w in whose}))}
            index = RunIndex(pieces, np.array([(docs[w[:2]] << 32) + w[2] for w in whose], np.int64), length)
            hit = np.flatnonzero(index.marks())
            if len(hit):
                piece = np.searchsorted(index.starts, hit, "right") - 1
                cut = np.r_[True, (piece[1:] != piece[:-1]) | (hit[1:] - hit[:-1] > length)]
                first = np.flatnonzero(cut)
                last = np.r_[first[1:], len(hit)] - 1
                for a, b in zip(first, last, strict=True):
                    i, h, start = whose[piece[a]]
                    base = int(index.starts[piece[a]])
                    out.append((i, h, start + int(hit[a]) - base, start + int(hit[b]) - base + length))
        ready.clear()

    def flush():
        cols = list(zip(*out, strict=True)) or [[]] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_id", "h", "s", "e"])
        out.clear()
        return batch

    group, seen, size = None, {}, 0
    for batch in batches:
        for g, i, h, start, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if g != group:
                if size >= INDEX_BYTES:
                    indexed()
                    size = 0
                    if out:
                        yield flush()
                group, seen = g, {}
            key = raw if len(raw) < 64 else xxhash.xxh3_128_digest(raw)
            if key in seen:
                if seen[key] != (i, h, start):  # a repeated row is no earlier place
                    out.append((i, h, start, start + len(raw)))
                continue
            seen[key] = (i, h, start)
            ready.append((i, h, start, raw))
            size += len(raw)
    indexed()
    yield flush()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(_id, n_bytes, n_removed, n_spans, kept_sha256, text) for each row of docs; text is what is kept, as bytes."""
    rows = with_text_key(keyed(docs, id_col, text=text_col))

    def summed(batch):
        out = {"_id": batch.column(0), "_t": batch.column(2), "n": [], "h": [], "h2": [], "sha": []}
        for t in texts(batch):
            a, b = _halves(t)
            for k, v in (("n", len(t)), ("h", a), ("h2", b), ("sha", hashlib.sha256(t).hexdigest())):
                out[k].append(v)
        return out

    sums = written(mapped(rows, summed, "_id long, _t long, n long, h long, h2 long, sha string"), "text-hashes")
    classes = sums.groupBy("h", "h2").agg(F.min("_id").alias("rep"), F.first("_t").alias("_t"))

    def anchored(batch):
        a_, h_, p_, o_ = [], [], [], []
        own = np.array([_halves(t)[0] for t in texts(batch)], np.int64)
        for first, bounds, data in _sliced(batch, 1):
            at, a = anchors(data, bounds, length)
            doc = np.searchsorted(bounds, at, "right") - 1
            a_.append(a.view(np.int64))
            h_.append(own[first + doc])
            p_.append((at - bounds[doc]).astype(np.int32))
        a, h, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_, h_, p_))
        v, inverse, count = np.unique(a, return_inverse=True, return_counts=True)
        hot = v[count >= FREQUENT]
        o = (count >= FREQUENT)[inverse].astype(np.int32)
        # A frequent anchor also tells its unsalted rows, from other batches, that it is one.
        return {"a": np.r_[a, hot], "h": np.r_[h, np.zeros(len(hot), np.int64)], "pos": np.r_[p, np.full(len(hot), -1)], "often": np.r_[o, np.ones(len(hot), np.int32)]}

    found = mapped(rows, anchored, "a long, h long, pos int, often int")
    salt = F.when((F.col("often") > 0) & (F.col("pos") >= 0), F.pmod("h", F.lit(SALTS)) + 1).otherwise(0)
    found = found.repartition("a", salt).sortWithinPartitions("a")
    found = written(found.mapInArrow(_repeated, "a long, h long, pos int, g long"), "anchors")
    places = found.groupBy("h", "g").agg(F.collect_set("pos").alias("pos"))  # of one text, so bounded by it
    places = places.join(classes, "h").groupBy(F.col("rep").alias("_id"), "_t", "h").agg(F.collect_list(F.struct("g", "pos")).alias("groups"))

    def regions(batches):
        seen: set[tuple[int, int]] = set()  # a row that repeats id and text is one
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                yield pa.RecordBatch.from_pydict(cut_out(whole.slice(k, 500), seen), schema=pa.schema([("g", pa.int64()), ("_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("raw", pa.binary())]))

    def cut_out(batch, seen):
        out = {k: [] for k in ("g", "_id", "h", "start", "raw")}
        for i, h, groups, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts(batch), strict=True):
            if groups is None or (i, h) in seen or _halves(text)[0] != h:
                continue
            seen.add((i, h))
            for group in groups:
                pos = np.sort(np.array(group["pos"], np.int64))
                lo, hi = np.maximum(pos + K - length, 0), np.minimum(pos + length, len(text))
                cut = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                for a, b in zip(lo[cut].tolist(), hi[np.r_[cut[1:], len(pos)] - 1].tolist(), strict=True):
                    if b - a >= length:
                        for k, v in (("g", group["g"]), ("_id", i), ("h", h), ("start", a), ("raw", text[a:b])):
                            out[k].append(v)
        return out

    cut = rows.join(places.hint("shuffle_hash"), ["_id", "_t"]).select("_id", "text", "h", "groups")
    parts = cut.mapInArrow(regions, "g long, _id long, h long, start int, raw binary")
    parts = parts.repartition("g").sortWithinPartitions("g", "_id", "h", "start")
    spans = parts.mapInArrow(lambda b: _spans(b, length), "_id long, h long, s int, e int")
    spans = spans.groupBy("_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    # What happens to each class: copies go whole, the smallest id loses its spans.
    facts = sums.join(classes, ["h", "h2"]).select("_id", sums["_t"], "n", "h", "sha", (F.col("_id") > F.col("rep")).alias("copy"))
    facts = facts.distinct()
    facts = facts.join(spans, ["_id", "h"], "left").groupBy("_id", "_t").agg(F.collect_list(F.struct("h", "copy", "spans", "sha")).alias("facts"))  # one, but for texts of one _t

    def kept(batch):
        out = {k: [] for k in ("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
        for i, text, facts in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
            f = facts[0] if len(facts) == 1 else next(x for x in facts if x["h"] == _halves(text)[0])
            n, runs, sha = len(text), 0, f["sha"]
            if f["copy"] and n >= length:
                text, runs, sha = b"", 1, hashlib.sha256(b"").hexdigest()
            elif f["spans"] and not f["copy"]:
                left, end = [], 0
                for s, e in sorted((x["s"], x["e"]) for x in f["spans"]):
                    if not runs or s > end:
                        left.append(text[end:s])
                        runs += 1
                    end = max(end, e)
                text = b"".join([*left, text[end:]])
                sha = hashlib.sha256(text).hexdigest()
            for k, v in (("_id", i), ("n_bytes", n), ("n_removed", n - len(text)), ("n_spans", runs), ("kept_sha256", sha), ("text", text)):
                out[k].append(v)
        return out

    final = rows.join(facts.hint("shuffle_hash"), ["_id", "_t"]).select("_id", "text", "facts")
    return mapped(final, kept, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(unkeyed().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
