"""Language-model scoring by logistic context mixing of hashed-context bit predictors.

A text is a sequence of words (A-Z lower-cased) and an end. Every word is coded by
bits, and every bit is predicted by mixing. The ``LEAD`` most frequent words, the end
and an escape have Huffman codes; behind the escape the first ``HASH_BITS`` bits of the
word's hash follow, most significant first, so the code tree covers every word there
can be and has a fixed size. A word's share among the training words that begin with
the same hash bits completes its probability; the share of words seen once goes to new
words instead, which are spelled in bytes by mixed bits of their own (a new word's
repeats in a text are picked from the text's new words).

Each bit is a node of the code tree, predicted in three contexts: none, the last word,
the last two words. A context and node share a slot of a hashed table of bit counts,
whose size follows the number of training tokens up to 2^MAX_BITS slots. The
predictions are stretched, weighted and squashed; gates chosen by how much the two
longer contexts have seen pick the weights. Every document starts from the same weights
and learns its own: after each block of ``BLOCK`` bits the weights step down the
gradient of that block at the weights that predicted it. The mixed prediction is
refined by an adaptive map from gate and prediction to what came true, which each
document goes on counting in. No bit's prediction uses the bit or later ones, so the
product of all is a probability of the text, given as log10 and as bits per byte.

Training is over all documents that are not held out: word counts are summed by word;
each task adds up its own tables of bit counts, and pieces of the tables are summed
across tasks. What is broadcast has a bound whatever the corpus: the tables, and the
words of at least the 2^-22th part of all tokens (so at most 2^22); counts of the others
are joined. The weights' and the map's starting values come from all training bits, each
bit's own count taken out: a second pass counts bits by what the three contexts predict
for them (in ``LEVELS``) and have seen, a table of a fixed size, and Newton steps fit the
weights to those counts. Spelling is counted, and its weights fitted, over the distinct
grams (a byte with those before it) of the words that are spelt, which are summed as rows.

Null text: empty, its end alone. A very long text is worked through in slices of
``SLICE_TOKENS`` words that carry contexts, weights and map on. Every row is scored by
itself; rows that repeat an id are trained on as often. Null ids are held out. No
training rows: even odds for all. Ties among the most frequent words go by hash.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, hashed_rows, keyed, mapped, mixed, texts, unkeyed, words, words_at, written
from .quality import held_out

LEAD, HASH_BITS = 254, 8
#: Words with a smaller share of all tokens than 2^-KNOWN_SHARE are joined, not broadcast.
KNOWN_SHARE = 22
MIN_BITS, MAX_BITS, PIECE = 16, 21, 1 << 16
#: Parts into which the tasks' tables are dealt before they are summed, so that no task reads those of all.
SALTS = 16
BLOCK, RATE = 512, 0.008
#: What the map's starting values weigh against a document's own counts.
PRIOR = 64.0
#: Share of repeats among a text's new words.
AGAIN = 0.2
END = np.uint64(0xE0D0E0D0E0D0E0D0)
_K, _K32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)
SLICE_TOKENS = 50_000
#: Spelling is learnt from words of at most so many occurrences, or not of the broadcast ones, like those that it is for.
SELDOM = 20
#: Tables: code nodes alone, with the last word, with the last two; spelling nodes in contexts of 0 to 5 bytes, and their bits.
SPELL, SPELL_BITS = (3, 4, 5, 6, 7, 8), (10, 17, 19, 19, 19, 19)
#: Which of the spelling tables' counts pick a spelt bit's weights.
SPELL_GATES = (3, 4)
#: What a bit counts before it is seen: words rarely follow, letters often must.
UNSEEN, UNSEEN_SPELT = 0.15, 0.1
GATES, CELLS = 16, 33
#: Predictions by which training bits are counted together: in so many levels, so many to 1.
LEVELS, STEPS = 49, 3
JOINT = LEVELS * (4 * LEVELS) ** 2
#: Number of the grams among the tables' pieces, the pieces they are dealt into, Newton steps over them.
GRAMS, GRAM_PIECES, SPELL_TURNS = 3 + len(SPELL), 64, 6


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits): the path of symbol s is nodes and bits [offsets[s]:offsets[s+1]]."""
    heap = [(c, s, None) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    n, made = len(counts), 0
    up: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, x in enumerate((a, b)):
            up[x[1]] = (made, bit)
        heapq.heappush(heap, (a[0] + b[0], n + made, None))
        made += 1
    paths = []
    for s in range(n):
        path, at = [], s
        while at in up:
            node, bit = up[at]
            path.append((made - 1 - node, bit))  # the root is node 0
            at = n + node
        paths.append(path[::-1])
    offsets = np.r_[0, np.cumsum([len(p) for p in paths])]
    flat = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
    return offsets, flat[:, 0], flat[:, 1].astype(bool)


class Code:
    """The broadcast part of the vocabulary: hashes and counts of frequent words, and the code of all words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, lead: np.ndarray, buckets: np.ndarray, total: int, kinds: int, once: int):
        """hashes and counts in any order; lead: places of the words with a code of their own, by falling count;
        buckets: tokens of all words by the first HASH_BITS of their hash; total, kinds and words seen once over all training tokens."""
        self.total, self.kinds = total, kinds
        ends = int(counts[hashes == END].sum())
        self.escaped = max(1, total - int(counts[lead].sum()) - ends)
        self.new = min(0.5, max(1e-6, once / self.escaped))
        self.end, self.fresh = len(lead) + 1, len(lead) + 2  # from fresh on: an escape and the hash bits behind it
        self.bits = int(np.clip(np.ceil(np.log2(total + 1)) + 3, MIN_BITS, MAX_BITS))
        offsets, nodes, values = huffman([int(c) + 1 for c in counts[lead]] + [self.escaped, ends + 1])
        size = 1 << HASH_BITS
        shift = np.arange(HASH_BITS - 1, -1, -1)
        b = np.arange(size)[:, None]
        esc = slice(offsets[len(lead)], offsets[len(lead) + 1])
        self.escape_bits = int(esc.stop - esc.start)
        tail_nodes = len(lead) + 1 + ((b | size) >> (shift + 1))
        tail = lambda x, y, kind: np.concatenate([np.broadcast_to(x, (size, len(x))), y.astype(kind)], axis=1).ravel()
        self.nodes = np.concatenate([nodes, tail(nodes[esc], tail_nodes, np.int64)])
        self.values = np.concatenate([values, tail(values[esc], b >> shift & 1, bool)])
        self.offsets = np.concatenate([offsets, offsets[-1] + (np.arange(size) + 1) * (len(nodes[esc]) + HASH_BITS)])
        self.sizes, self.keys = np.diff(self.offsets), self.nodes.astype(np.uint32) * _K32
        own = np.r_[lead, np.flatnonzero(hashes == END)].astype(np.int64)
        self.rest = buckets.astype(np.int64).copy()  # tokens behind an escape, by hash bits
        np.subtract.at(self.rest, (hashes[own] >> np.uint64(64 - HASH_BITS)).astype(np.int64), counts[own])
        self.rest = np.maximum(self.rest, 1)
        symbol = np.full(len(hashes), -1)
        symbol[lead] = np.arange(len(lead))
        symbol[hashes == END] = self.end
        self._known(hashes, counts, symbol)

    def _known(self, hashes: np.ndarray, counts: np.ndarray, symbol: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.symbols = hashes[order], counts[order], symbol[order]
        # Where the hashes with each value of their first bits begin: a word is found in a step or two.
        self.top = np.uint64(64 - max(8, int(np.ceil(np.log2(len(hashes) + 1))) + 2))
        self.begin = np.searchsorted(self.hashes >> self.top, np.arange((1 << (64 - int(self.top))) + 1, dtype=np.uint64)).astype(np.int32)
        self.run = int(np.diff(self.begin).max())

    def short(self) -> Code:
        """The same code with the counts of the words alone that have a symbol of their own."""
        out, own = copy.copy(self), self.symbols >= 0
        out._known(self.hashes[own], self.counts[own], self.symbols[own])
        return out

    def table_sizes(self) -> list[int]:
        nodes = len(self.offsets) + (1 << HASH_BITS)
        return [nodes, 1 << self.bits, 1 << self.bits] + [1 << b for b in SPELL_BITS]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and counts of word hashes; count 0 where a word is not among the broadcast ones."""
        behind = self.fresh + (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        own, count = np.where(h == END, self.end, -1), np.zeros(len(h), np.int64)
        begin, left, key = self.begin.take((h >> self.top).astype(np.int64)).astype(np.int64), np.arange(len(h)), h
        for k in range(self.run if len(self.hashes) else 0):
            at = np.minimum(begin + k, len(self.hashes) - 1)
            hit = self.hashes.take(at) == key
            to, at = left[hit], at[hit]
            own[to], count[to] = self.symbols.take(at), self.counts.take(at)
            begin, left, key = (x[~hit] for x in (begin, left, key))
        return np.where(own >= 0, own, behind), count

    def steps(self, sym: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(number of bits of each symbol, places of the bits in the paths, slots in tables 1 and 2); one and two are context hashes of the last and the last two words."""
        size = self.sizes.take(sym)
        start = np.cumsum(size) - size
        at = np.repeat(self.offsets.take(sym) - start, size)
        at += np.arange(len(at))
        key = self.keys.take(at)
        return size, at, [_slot(np.repeat(ctx, size) + key, self.bits) for ctx in (one, two)]

    def path(self, sym: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(number of bits of each symbol, bits, slots in tables 0-2)."""
        size, at, slots = self.steps(sym, one, two)
        return size, self.values.take(at), [self.nodes.take(at), *slots]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= _K32
    h ^= h >> np.uint32(13)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def grams(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each byte of words (a blank behind each, sizes with the blank), with the bytes before it in its word, as one number."""
    begin = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(data)) - begin
    data = data.astype(np.uint64)
    out = data.copy()
    for k in range(1, len(SPELL)):
        out[k:] |= np.where(place[k:] >= k, data[:-k], np.uint64(0)) << np.uint64(8 * k)
    return out


def gram_paths(g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bits, slots in the tables of SPELL) of grams, 8 a gram."""
    shift = np.arange(7, -1, -1)
    byte = (g & np.uint64(255)).astype(np.int64)
    node = ((byte[:, None] | 256) >> (shift + 1)).ravel().astype(np.uint32) * _K32
    bit = (byte[:, None] >> shift & 1).astype(bool).ravel()
    slots, ctx = [], np.zeros(len(g), np.uint64)
    for k in range(len(SPELL)):
        if k:
            ctx = ctx * np.uint64(257) + (g >> np.uint64(8 * k) & np.uint64(255)) + np.uint64(1)
        h = np.repeat(mixed((ctx + np.uint64(k << 58)) * _K).astype(np.uint32), 8) + node
        slots.append(_slot(h, SPELL_BITS[k]))
    return bit, slots


def spelled(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first bit of each word, bits, slots in the tables of SPELL) of words and the blank that ends each."""
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    return (np.cumsum(size) - size) * 8, *gram_paths(grams(np.frombuffer(b" ".join(found) + b" ", np.uint8), size))


def _merged(g: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts."""
    g, c = np.concatenate(g), np.concatenate(c)
    order = np.argsort(g)
    g, c = g[order], c[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    return g[start], np.add.reduceat(c, start) if len(start) else c


class Slice:
    """Words of some texts, or a part of one long text: rows and their bounds in h; symbols, counts and context hashes of h."""

    def __init__(self, code: Code, rows: list[int], parts: list[np.ndarray], goes_on: bool, before: np.ndarray):
        self.rows, self.goes_on = rows, goes_on  # goes_on: the first row began in the slice before
        self.h = h = np.concatenate(parts)
        self.length = np.fromiter(map(len, parts), np.int64, len(parts))
        self.doc = np.repeat(np.arange(len(parts)), self.length)
        self.sym, self.count = code.look_up(h)
        first = np.cumsum(self.length) - self.length
        place = np.arange(len(h)) - np.repeat(first, self.length)
        pad = np.concatenate([before, h])
        last, two = pad[1:-1], pad[:-2]
        if not goes_on:
            last = np.where(place < 1, np.uint64(1), last)
            two = np.where(place < 2, np.uint64(1), two)
        elif len(parts) > 1:
            raise AssertionError("a part of a long text stands alone")
        self.one = mixed(last * _K).astype(np.uint32)
        self.two = mixed(mixed(two * _K) + last).astype(np.uint32)


class Sequences:
    """Words of a batch of texts, in slices of whole texts or of parts of a long one."""

    def __init__(self, col: pa.Array, code: Code):
        self.code, self.col = code, col
        self.hashes = [h for h, _ in hashed_rows(col)]

    def slices(self):
        k, n, none = 0, len(self.hashes), np.ones(2, np.uint64)
        while k < n:
            if len(self.hashes[k]) >= SLICE_TOKENS:
                whole = np.append(self.hashes[k], END)
                for a in range(0, len(whole), SLICE_TOKENS):
                    yield Slice(self.code, [k], [whole[a : a + SLICE_TOKENS]], a > 0, whole[a - 2 : a] if a else none)
                k += 1
                continue
            m, size = k, 0
            while m < n and (m == k or size + len(self.hashes[m]) < SLICE_TOKENS):
                size += len(self.hashes[m]) + 1
                m += 1
            yield Slice(self.code, list(range(k, m)), [np.append(self.hashes[r], END) for r in range(k, m)], False, none)
            k = m

    def words(self, rows, wanted: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Of the hashes wanted (sorted, distinct) those that texts of the rows hold, sorted, and a word of each."""
        found: dict[int, bytes] = {}
        for r in rows if len(wanted) else ():
            r = int(r)
            h = self.hashes[r]
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == h)
            if len(hit):
                ws = words(self.col[r].as_py().encode())
                found.update(zip(h[hit].tolist(), [ws[k] for k in hit.tolist()], strict=True))
        keys = sorted(found)
        return np.array(keys, np.uint64), [found[k] for k in keys]


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _seen(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, (1, 8, 64)).astype(np.uint16)


def _cell(gate: np.ndarray, dot: np.ndarray) -> np.ndarray:
    return gate * CELLS + _level(dot)


def _level(dot: np.ndarray) -> np.ndarray:
    return np.clip((dot + 8) * 2, 0, CELLS - 1).astype(np.int64)


def _stretched(n: np.ndarray, ones: np.ndarray, table: int) -> np.ndarray:
    few = UNSEEN_SPELT if table in SPELL else UNSEEN
    return np.clip(stretch((ones + few) / (n + 2 * few)), -7.9, 7.9)


def _packed(n: np.ndarray, ones: np.ndarray, table: int) -> np.ndarray:
    """Stretched predictions in 16ths and how much they have seen, in one number."""
    return np.rint(_stretched(n, ones, table) * 16).astype(np.int8).view(np.uint8).astype(np.uint16) | _seen(n) << np.uint16(8)


class State:
    """What documents have learnt: weights and map of each, as rows of GATES a document."""

    def __init__(self, model: Model, docs: int):
        self.w = [np.tile(model.weights[:, k], docs).astype(np.float32) for k in range(model.weights.shape[1])]
        ones = PRIOR * model.refine.ravel()
        self.seen = np.tile(np.stack([PRIOR - ones, ones], axis=1).ravel(), docs).astype(np.float32)  # zeros and ones of each cell

    def last(self) -> State:
        """That of the last document alone."""
        out = object.__new__(State)
        out.w, out.seen = [x[-GATES:].copy() for x in self.w], self.seen[-2 * GATES * CELLS :].copy()
        return out


class Model:
    """Each slot's stretched prediction in 16ths and how much it has seen, in one number; starting weights and map."""

    def __init__(self, n: list[np.ndarray], ones: list[np.ndarray]):
        self.slots = [_packed(a, b, t) for t, (a, b) in enumerate(zip(n, ones, strict=True))]
        self.rate = RATE
        self.weights = np.tile(np.array([0.3, 0.4, 0.4, 0.0], np.float32), (GATES, 1))
        self.spell = np.tile(np.array([0.2] * len(SPELL) + [0.0], np.float32), (GATES, 1))
        self.refine = np.tile(squash((np.arange(CELLS) + 0.5) / 2 - 8), (GATES, 1)).astype(np.float32)

    def inputs(self, slots: list[np.ndarray], tables=(0, 1, 2), gates=(1, 2)) -> tuple[list[np.ndarray], np.ndarray]:
        """Predictions of each table and a constant; the gate of each bit."""
        got = [self.slots[t].take(s) for t, s in zip(tables, slots, strict=True)]
        x = [g.astype(np.uint8).view(np.int8) * np.float32(1 / 16) for g in got]
        seen = [g >> np.uint16(8) for g in (got[k] for k in gates)]
        return [*x, np.full(len(x[0]), 0.3, np.float32)], (seen[0] * np.uint16(4) + seen[1]).astype(np.int64)

    def predict(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, doc: np.ndarray, place: np.ndarray, state: State) -> np.ndarray:
        """Probabilities of ones, and state led on; doc numbers the bits' documents from 0, place is a bit's place in its document's slice."""
        out = np.empty(len(bit), np.float32)
        if not len(bit):
            return out
        # Runs of one document and turn, ranked by turn; within each, bits of one gate together: they share weights.
        turn = place // BLOCK
        start = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]) | (doc[1:] != doc[:-1])])
        by = np.argsort(turn[start], kind="stable")
        kind = np.uint16 if len(by) * GATES <= 1 << 16 else np.int64
        rank = np.empty(len(by), kind)
        rank[by] = np.arange(len(by)) * GATES
        key = np.repeat(rank, np.diff(np.r_[start, len(bit)])) + gate.astype(kind)
        order = np.argsort(key, kind="stable")
        key = key.take(order)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        edge = np.r_[first, len(key)]
        at = start[by[key[first] // GATES]]
        own = doc[at] * GATES + key[first] % GATES
        cut = np.searchsorted(turn[at], np.arange(int(turn.max()) + 2))
        const = x[-1][0]
        x, y = [a.take(order) for a in x[:-1]], bit.take(order)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = edge[a], edge[b]
            g, n, near = own[a:b], np.diff(edge[a : b + 1]), first[a:b] - lo
            xs, ys = [v[lo:hi] for v in x], y[lo:hi]
            w = [v[g] for v in state.w]
            dot = np.repeat(w[-1] * const, n)
            for v, c in zip(xs, w, strict=False):
                dot += v * np.repeat(c, n)
            p = squash(dot)
            cell = 2 * (np.repeat(g * CELLS, n) + _level(dot))
            ones = state.seen.take(cell + 1)
            out[order[lo:hi]] = (p + ones / (state.seen.take(cell) + ones)) / 2
            err = np.float32(self.rate) * (ys - p)
            for v, c, old in zip(xs, state.w, w, strict=False):
                c[g] = old + np.add.reduceat(err * v, near)
            state.w[-1][g] = w[-1] + const * np.add.reduceat(err, near)
            np.add.at(state.seen, cell + ys, np.ones(len(cell), np.float32))
        return np.clip(out, 1e-5, 1 - 1e-5)

    def spell_prob(self, found: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling."""
        out = np.zeros(len(found))
        for k in range(0, len(found), 20_000):
            some = found[k : k + 20_000]
            cut, bit, slots = spelled(some)
            x, gate = self.inputs(slots, SPELL, SPELL_GATES)
            p = np.clip(squash(sum(a * self.spell[gate, i] for i, a in enumerate(x))), 1e-5, 1 - 1e-5)
            out[k : k + len(some)] = np.add.reduceat(np.log10(np.where(bit, p, 1 - p)), cut)
        return out


def _step(w: np.ndarray, start: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """A Newton step of weights that are held near those that they start from."""
    hold = 2.0 * np.eye(len(w))
    return np.clip(w - np.linalg.solve(curve + hold, slope + hold @ (w - start)), -3, 3)


def fit_weights(x: np.ndarray, gate: np.ndarray, n: np.ndarray, ones: np.ndarray, w: np.ndarray, turns: int = 12) -> np.ndarray:
    """Newton steps on log loss for each gate's weights; n bits, ones of them 1, have each column of x. A gate with few bits keeps its own."""
    w = w.copy()
    for g in range(len(w)):
        own = gate == g
        if n[own].sum() < 50:
            continue
        a, all_, hits = x[:, own].astype(float), n[own].astype(float), ones[own].astype(float)
        start = v = w[g].astype(float)
        for _ in range(turns):
            p = squash(v @ a)
            v, before = _step(v, start, a @ (all_ * p - hits), (a * (all_ * p * (1 - p))) @ a.T), v
            if np.abs(v - before).max() < 1e-6:
                break
        w[g] = v
    return w


def others_said(n: np.ndarray, ones: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """What a slot's other bits predict, at 2 * slot + bit, that bit's own count taken out: stretched, and how much they are."""
    left = np.repeat(np.maximum(n - 1, 0), 2)
    hits = np.clip(np.stack([ones, ones - 1], axis=1).ravel(), 0, left)
    return _stretched(left, hits, table), _seen(left)


def fitted(pieces: DataFrame, sizes: list[int]) -> tuple[Model, list[np.ndarray], list[np.ndarray]]:
    """The model of counted bits and, for tables 0-2 and for those of spelling, what others said at 2 * slot + bit:
    the first in LEVELS with how much they are (in tables 1 and 2) in a byte, the second like the model's slots."""
    model = Model(*([np.zeros(s, np.int32) for s in sizes] for _ in range(2)))
    joint = [np.zeros(2 * s, np.uint8) for s in sizes[:3]]
    spell = [np.zeros(2 * sizes[t], np.uint16) for t in SPELL]
    for r in pieces.toLocalIterator():  # tables of a bounded size
        t, a = r["t"], r["piece"] * PIECE
        n, ones = (_wide(r[k], r["at"], r["size"]) for k in ("n", "ones"))
        model.slots[t][a : a + len(n)] = _packed(n, ones, t)
        x, seen = others_said(n, ones, t)
        both = slice(2 * a, 2 * (a + len(n)))
        if t in SPELL:
            spell[t - SPELL[0]][both] = np.rint(x * 16).astype(np.int8).view(np.uint8).astype(np.uint16) | seen << np.uint16(8)
        else:
            joint[t][both] = np.rint(x * STEPS).astype(np.int64) + LEVELS // 2 + (LEVELS * seen if t else 0)
    return model, joint, spell


def tuned(model: Model, n: np.ndarray, ones: np.ndarray) -> None:
    """Starting weights and map from the counts of _joint(): of all training bits by what others said."""
    at = np.flatnonzero(n)
    if not len(at):
        return
    n, ones = n[at], ones[at]
    a, b, c = at // (4 * LEVELS) ** 2, at // (4 * LEVELS) % (4 * LEVELS), at % (4 * LEVELS)
    x = np.stack([*((k % LEVELS - LEVELS // 2) / STEPS for k in (a, b, c)), np.full(len(at), 0.3)]).astype(np.float32)
    gate = b // LEVELS * 4 + c // LEVELS
    model.weights = fit_weights(x, gate, n, ones, model.weights).astype(np.float32)
    cell = _cell(gate, (x.T * model.weights[gate]).sum(axis=1))
    hits, all_ = np.bincount(cell, ones, GATES * CELLS), np.bincount(cell, n, GATES * CELLS)
    model.refine = ((hits + 20 * model.refine.ravel()) / (all_ + 20)).reshape(GATES, CELLS).astype(np.float32)


def tuned_spelling(model: Model, said: list[np.ndarray], rows: DataFrame) -> None:
    """Weights of spelling from all counted grams (n, ones: grams and their counts), a pass over these a Newton step."""
    tables, size = rows.sparkSession.sparkContext.broadcast(said), len(SPELL) + 1
    start = w = model.spell.astype(float)
    for _ in range(SPELL_TURNS):

        def sums(batches, w=w):
            slope, curve, bits = np.zeros((GATES, size)), np.zeros((GATES, size, size)), np.zeros(GATES)
            for raw, c in ((a, b) for batch in batches for a, b in zip(batch.column(0), batch.column(1), strict=True)):
                g, c = np.frombuffer(raw.as_buffer(), np.uint64), _wide(c.as_py(), None, 0)
                for k in range(0, len(g), 50_000):
                    bit, slots = gram_paths(g[k : k + 50_000])
                    times = np.repeat(c[k : k + 50_000], 8).astype(np.float32)
                    got = [table.take(2 * s + bit) for table, s in zip(tables.value, slots, strict=True)]
                    x = np.stack([*(v.astype(np.uint8).view(np.int8) * np.float32(1 / 16) for v in got), np.full(len(bit), 0.3, np.float32)])
                    gate = (got[SPELL_GATES[0]] >> np.uint16(8)) * np.uint16(4) + (got[SPELL_GATES[1]] >> np.uint16(8))
                    for own in range(GATES):
                        which = np.flatnonzero(gate == own)
                        a, m, y = x[:, which], times[which], bit[which]
                        p = squash(w[own].astype(np.float32) @ a)
                        slope[own] += a @ (m * (p - y))
                        curve[own] += (a * (m * p * (1 - p))) @ a.T
                        bits[own] += m.sum()
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([slope.ravel(), curve.ravel(), bits]).tobytes()], pa.binary())], names=["sums"])

        total = np.zeros(GATES * (size + size * size + 1))
        for r in rows.mapInArrow(sums, "sums binary").toLocalIterator():  # a short row a task
            total += np.frombuffer(r[0])
        slope, curve, bits = total[: GATES * size].reshape(GATES, size), total[GATES * size : -GATES].reshape(GATES, size, size), total[-GATES:]
        w, before = np.stack([_step(w[g], start[g], slope[g], curve[g]) if bits[g] >= 50 else w[g] for g in range(GATES)]), w
        if np.abs(w - before).max() < 0.01:
            break
    model.spell = w.astype(np.float32)
    tables.destroy()


def _counted(rows: DataFrame) -> DataFrame:
    def each(batch):
        found = [h for h, _ in hashed_rows(batch.column(0))]
        h, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return {"h": np.r_[h, END].astype(np.uint64), "c": np.r_[c, len(found)]}

    return mapped(rows, each, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0")


def _tables(rows: DataFrame, shared) -> DataFrame:
    """(t, piece, n, ones): pieces of the tables of bit counts and, as t GRAMS, of the spelt words' grams and their
    counts, summed over all rows."""

    def add(batches):
        code = shared.value
        sizes = code.table_sizes()
        both = [np.zeros(2 * size, np.int32) for size in sizes]  # of zeros and of ones, side by side
        one, values, symbols = np.ones(1 << 22, np.int32), code.values.astype(np.int64), np.zeros(len(code.sizes), np.int64)
        g, c, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            seq = Sequences(batch.column(0), code)
            rare, place = [], 0
            for part in seq.slices():
                symbols += np.bincount(part.sym, minlength=len(symbols))
                _, at, slots = code.steps(part.sym, part.one, part.two)
                bit = values.take(at)
                for t, s in enumerate(slots, 1):
                    s += s
                    s += bit
                    for k in range(0, len(s), len(one)):
                        np.add.at(both[t], s[k : k + len(one)], one[: len(s) - k])
                ends = part.h == END
                own = np.flatnonzero((part.count <= SELDOM) & ~ends)
                rare.append((part.h[own], place + own - np.cumsum(ends)[own]))  # words alone are counted through
                place += len(part.h) - int(ends.sum())
            if rare:  # each word once a batch
                h, at = (np.concatenate(x) for x in zip(*rare, strict=True))
                for word in words_at(batch.column(0), np.sort(at[np.unique(h, return_index=True)[1]])):
                    new, times = np.unique(grams(*word), return_counts=True)
                    g, c = [*g, new], [*c, times]
                    if (size := size + len(new)) > 1 << 21:
                        g, c = ([x] for x in _merged(g, c))
                        size = 0
        np.add.at(both[0], 2 * code.nodes + values, np.repeat(symbols, code.sizes).astype(np.int32))
        g, c = _merged(g, c)
        for k in range(0, len(g), 100_000):
            bit, slots = gram_paths(g[k : k + 100_000])
            times = np.repeat(c[k : k + 100_000], 8).astype(np.int32)
            for t, s in zip(SPELL, slots, strict=True):
                np.add.at(both[t], 2 * s + bit, times)
        salt = TaskContext.get().partitionId() % SALTS
        for t in range(len(both)):
            yield from _pieces(t, both[t][::2] + both[t][1::2], both[t][1::2], salt)
        yield from _gram_pieces(g, c, salt)

    return _summed(rows.mapInArrow(add, _PIECES))


def _joint(rows: DataFrame, shared) -> DataFrame:
    """Of all bits of all rows, by what others said of a bit in tables 0-2 (see fitted()), how many there are and how many are 1; in pieces."""

    def add(batches):
        code, tables = shared.value
        both, one = np.zeros(2 * JOINT, np.int32), np.ones(1 << 22, np.int32)
        values = code.values.astype(np.int64)
        first = tables[0].take(2 * code.nodes + values) * np.int64(2 * (4 * LEVELS) ** 2) + values  # what a step adds by itself
        for batch in batches:
            for part in Sequences(batch.column(0), code).slices():
                _, place, slots = code.steps(part.sym, part.one, part.two)
                at, bit = first.take(place), values.take(place)
                for s, table, by in zip(slots, tables[1:], (8 * LEVELS, 2), strict=True):
                    s += s
                    s += bit
                    at += np.multiply(table.take(s), by, dtype=np.int64)
                for k in range(0, len(at), len(one)):
                    np.add.at(both, at[k : k + len(one)], one[: len(at) - k])
        yield from _pieces(0, both[::2] + both[1::2], both[1::2], TaskContext.get().partitionId() % SALTS)

    return _summed(rows.mapInArrow(add, _PIECES))


_PIECES = "t int, piece int, salt int, size int, at binary, n binary, ones binary"


def _summed(parts: DataFrame) -> DataFrame:
    """Pieces of all tasks' tables, added up."""

    def total(batches):
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for t, piece, _, size, at, a, b in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                old = sums.get((t, piece))
                if t == GRAMS:
                    both = [np.frombuffer(a, np.uint64), _wide(b, None, 0)]
                    sums[t, piece] = both if old is None else list(_merged(*zip(old, both, strict=True)))
                    continue
                both = [_wide(a, at, size), _wide(b, at, size)]
                sums[t, piece] = both if old is None else [x + y for x, y in zip(old, both, strict=True)]
        for (t, piece), (a, b) in sums.items():
            yield _piece(t, piece, 0, a, b) if t != GRAMS else _row(t, piece, 0, 0, None, a.tobytes(), _narrow(b))

    first = parts.repartition("t", "piece", "salt").mapInArrow(total, _PIECES)
    return first.repartition("t", "piece").mapInArrow(total, _PIECES)


def _pieces(t: int, n: np.ndarray, ones: np.ndarray, salt: int):
    for piece in range(-(-len(n) // PIECE)):
        a, b = (x[piece * PIECE : (piece + 1) * PIECE] for x in (n, ones))
        if a.any():
            yield _piece(t, piece, salt, a, b)


def _gram_pieces(g: np.ndarray, c: np.ndarray, salt: int):
    own = (mixed(g * _K) % np.uint64(GRAM_PIECES)).astype(np.int64)
    for piece in np.unique(own).tolist():
        yield _row(GRAMS, piece, salt, 0, None, g[own == piece].tobytes(), _narrow(c[own == piece]))


def _piece(t: int, piece: int, salt: int, n: np.ndarray, ones: np.ndarray) -> pa.RecordBatch:
    """Counts of a piece; where few slots have any, only theirs with their places in at."""
    at = np.flatnonzero(n)
    few = 5 * len(at) < 2 * len(n)
    return _row(t, piece, salt, len(n), at.astype(np.uint16).tobytes() if few else None, *(_narrow(x[at] if few else x) for x in (n, ones)))


def _row(t: int, piece: int, salt: int, size: int, *more: bytes | None) -> pa.RecordBatch:
    cols = [pa.array([x], pa.int32()) for x in (t, piece, salt, size)] + [pa.array([x], pa.binary()) for x in more]
    return pa.RecordBatch.from_arrays(cols, names=["t", "piece", "salt", "size", "at", "n", "ones"])


def _narrow(a: np.ndarray) -> bytes:
    """A width in bytes, and the counts in it."""
    for kind in (np.uint8, np.uint16, np.uint32, np.int64):
        if int(a.max(initial=0)) <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + a.astype(kind).tobytes()
    raise AssertionError


def _wide(raw: bytes, at: bytes | None, size: int) -> np.ndarray:
    a = np.frombuffer(raw[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[raw[0]]).astype(np.int64)
    if at is None:
        return a
    out = np.zeros(size, np.int64)
    out[np.frombuffer(at, np.uint16)] = a
    return out


def _whole(pieces: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A table from its pieces."""
    n, ones = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in pieces.toLocalIterator():
        at = slice(r["piece"] * PIECE, (r["piece"] + 1) * PIECE)
        n[at], ones[at] = (_wide(r[k], r["at"], r["size"]) for k in ("n", "ones"))
    return n, ones


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_tokens, n_known, train_tokens, base_score, score, token_score, bits_per_byte) for each row of docs.

    score is that of the text, new words spelled; token_score leaves the spelling out, so a new
    word is one more kind of token, as in base_score: the two are comparable, token by token."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col).withColumn("held", held_out(unkeyed(), 10))
    train = rows.where(~F.col("held"))
    vocab = written(_counted(train.select("text")), "word-counts")
    code = _code(vocab)
    shared_code = spark.sparkContext.broadcast(code)
    bits = written(_tables(train.select("text"), shared_code), "bit-counts")
    shared_code.destroy()
    model, said, said_spelt = fitted(bits.where(F.col("t") != GRAMS), code.table_sizes())
    tuned_spelling(model, said_spelt, bits.where(F.col("t") == GRAMS).select("n", "ones"))
    shared_joint = spark.sparkContext.broadcast((code.short(), said))
    del said, said_spelt
    joint = written(_joint(train.select("text"), shared_joint), "joint-counts")
    shared_joint.destroy()
    tuned(model, *_whole(joint, JOINT))
    shared = spark.sparkContext.broadcast((code, model))
    made = written(mapped(rows, _scorer(shared), _SCORED), "bit-scores")
    # Words that are not broadcast: their counts are joined, and what they add to their rows' scores is summed.
    floor = float(code.total) + 0.1 * (float(code.kinds) + 1)
    log = lambda x: F.lit(float(np.log10(x)))
    some = made.where("h is not null").select("row", "h", "mult", "escapes", "mixed", "spell").join(vocab, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = F.element_at(F.array(*[F.lit(float(x)) for x in code.rest]), (F.shiftrightunsigned("h", 64 - HASH_BITS) + 1).cast("int"))
    known = F.col("mixed") + F.col("mult") * (log(1 - code.new) + F.log10(F.col("c") / rest))
    anew = F.col("escapes") + F.col("mult") * log(code.new) + log(1 - AGAIN) + F.col("spell") + (F.col("mult") - 1) * log(AGAIN)
    is_new, more = F.col("c") == 0, F.col("mult") - 1
    some = some.withColumn("s", F.when(is_new, anew).otherwise(known))
    some = some.groupBy("row").agg(
        F.sum(F.when(is_new, 0).otherwise(F.col("mult"))).alias("k"), F.sum(F.col("mult") * F.log10((F.col("c") + 0.1) / F.lit(floor))).alias("b"), F.sum("s").alias("s"),
        F.sum(F.when(is_new, F.col("escapes") + F.col("mult") * log(code.new)).otherwise(known)).alias("t"),
        F.count_if(is_new).cast("double").alias("new"), F.sum(F.when(is_new, more).otherwise(0)).alias("again"),
    )
    out = made.where("h is null").join(some, "row", "left")
    # A repeat is one of the text's kinds of new words, whose number is told first: k has the probability 1 / ((k + 1) (k + 2)).
    told = F.when(F.col("new") > 0, F.log10(F.col("new") + 1) + F.log10(F.col("new") + 2) + F.col("again") * F.log10(F.greatest(F.col("new"), F.lit(1.0)))).otherwise(log(2.0))
    score = F.col("score") + F.coalesce("s", F.lit(0.0)) - F.coalesce(told, log(2.0))
    return out.select(
        "_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(code.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), score.alias("score"), (F.col("score") + F.coalesce("t", F.lit(0.0))).alias("token_score"), (-score / log(2.0) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _code(vocab: DataFrame) -> Code:
    total, kinds, once = (int(x) for x in vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first())
    lead = vocab.where(F.col("h") != F.lit(int(END.astype(np.int64)))).orderBy(F.desc("c"), "h").limit(LEAD).toArrow()
    known = vocab.where((F.col("c") >= F.lit(-(-total // (1 << KNOWN_SHARE)))) | (F.col("h") == F.lit(int(END.astype(np.int64))))).toArrow()
    at = vocab.groupBy(F.shiftrightunsigned("h", 64 - HASH_BITS).cast("int").alias("b")).agg(F.sum("c").alias("c")).toArrow()
    buckets = np.zeros(1 << HASH_BITS, np.int64)
    buckets[at["b"].to_numpy()] = at["c"].to_numpy()
    (lh, lc), (h, c) = ((x["h"].to_numpy().astype(np.int64).view(np.uint64), x["c"].to_numpy().astype(np.int64)) for x in (lead, known))
    other = ~np.isin(h, lh)
    return Code(np.r_[lh, h[other]].astype(np.uint64), np.r_[lc, c[other]], np.arange(len(lh)), buckets, total, kinds, once)


_SCORED = "row long, _id long, n_tokens long, n_known long, n_bytes long, base double, score double, h long, mult long, escapes double, mixed double, spell double"


def _scorer(shared):
    """A row for each text, and one for each of its words that are not broadcast."""

    def each(batch):
        code, model = shared.value
        ids, m = batch.column(0).to_numpy(), batch.num_rows
        floor = float(code.total) + 0.1 * (float(code.kinds) + 1)
        seq = Sequences(batch.column(1), code)
        tokens, known_n, base, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        others, state = [], None
        for part in seq.slices():
            rows = np.array(part.rows)
            size, bit, slots = code.path(part.sym, part.one, part.two)
            doc = np.repeat(part.doc, size)
            starts = np.searchsorted(doc, np.arange(len(rows)))
            x, gate = model.inputs(slots)
            state = state.last() if part.goes_on else State(model, len(rows))
            p = model.predict(x, gate, bit, doc, np.arange(len(bit)) - starts[doc], state)
            cost, begin = np.log(np.where(bit, p, 1 - p)).astype(float) * np.log10(np.e), np.cumsum(size) - size
            sums = np.r_[0.0, np.cumsum(cost)]
            cost = np.add.reduceat(cost, begin)
            known = part.count > 0
            is_end = part.h == END
            here = known & (part.sym >= code.fresh)
            cost[here] += np.log10((1 - code.new) * part.count[here] / code.rest[part.sym[here] - code.fresh])
            wait = ~known & ~is_end  # counts of these words are joined; what a new one costs instead of its hash bits too
            add = lambda to, weights: np.add.at(to, rows, np.bincount(part.doc, weights, len(rows)).astype(to.dtype))
            add(score, np.where(wait, 0.0, cost))
            add(tokens, np.ones(len(part.h)))
            add(known_n, known.astype(float))
            add(base, np.where(known | is_end, np.log10((part.count + 0.1) / floor), 0.0))
            if wait.any():
                others.append((rows[part.doc[wait]], part.h[wait], cost[wait], sums[begin[wait] + code.escape_bits] - sums[begin[wait]]))
        out = {"row": (np.int64(TaskContext.get().partitionId()) << np.int64(40)) + np.arange(m) + each.seen, "_id": ids, "n_tokens": tokens, "n_known": known_n, "n_bytes": np.array([len(t) for t in texts(batch)], np.int64), "base": base, "score": score}
        each.seen += m
        if not others:
            return out | {k: pa.nulls(m) for k in ("h", "mult", "escapes", "mixed", "spell")}
        r, h, cost, escapes = (np.concatenate(x) for x in zip(*others, strict=True))
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        # Training knows every word of its own rows, so only held-out rows have new ones to spell.
        held = batch.column(2).to_numpy(zero_copy_only=False)
        kept, found = seq.words(np.flatnonzero(held), distinct(h[held[r]]))
        spell, may = np.zeros(len(cut)), held[r[cut]]
        spell[may] = model.spell_prob(found)[np.searchsorted(kept, h[cut][may])] if may.any() else 0.0
        more = {"row": out["row"][r[cut]], "h": h[cut].view(np.int64), "mult": np.diff(np.r_[cut, len(h)]), "escapes": np.add.reduceat(escapes[order], cut), "mixed": np.add.reduceat(cost[order], cut), "spell": spell}
        join = lambda k: pa.concat_arrays([pa.array(out[k]) if k in out else pa.nulls(m, pa.array(more[k]).type), pa.array(more[k]) if k in more else pa.nulls(len(cut), pa.array(out[k]).type)])
        return {k: join(k) for k in ("row", "_id", "n_tokens", "n_known", "n_bytes", "base", "score", "h", "mult", "escapes", "mixed", "spell")}

    each.seen = 0
    return each


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    doc_id = unkeyed()
    return out.select(doc_id.alias("doc_id"), held_out(doc_id, 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "token_score", "bits_per_byte")
