"""Edit-aware token counts: a pre-token segment tree per document.

The tokenizer splits a text into pre-tokens by a pattern, and encodes each by itself,
so a text's count is the sum over its pre-tokens. A document's state is its text and,
in order, the characters and tokens of its pre-tokens. Blocks of pre-tokens are the
leaves of a segment tree whose nodes hold the sums of both.

An edit replaces characters [start, end) by other text. The tree finds the block of
its first character; scanning starts at the last pre-token that ends ``BACK``
characters before the edit, as matching may look that far ahead, and goes on until it
ends a pre-token where the old text had ended one, past the edit: from there on the
old pre-tokens stand. The pre-tokens between are replaced in their blocks, and the
sums above those blocks updated. Blocks that grow too long are dealt anew.

Edits apply in order, each to the text as its predecessor left it; positions beyond
the text are its end. Null text: empty; null edits: none; null in an edit: position 0
or empty text. Every row is a document; rows that repeat an id have states of their own.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_arrow, keyed, mapped, unkeyed

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-token pattern, as its README's PATTERN gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, BACK, CACHE = 64, 4, 200_000


class Counter:
    """Pre-tokens and their token counts under one vocabulary, with a bounded cache."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def tokens(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for x in {x for x in pieces if x not in known}:
                known[x] = len(self.encoding.encode_ordinary(x))
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@functools.lru_cache(maxsize=2)
def counter(ranks: str = RANKS, pattern: str = PATTERN) -> Counter:
    return Counter(ranks, pattern)


class PreTokenTree:
    """One document: text, blocks of (characters, tokens) of its pre-tokens, and the sums above them."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, by: Counter):
        self.text, self.by, self.redone = text, by, 0
        self._deal(chars, tokens)

    @classmethod
    def of(cls, text: str, by: Counter) -> PreTokenTree:
        pieces = by.split(text)
        return cls(text, np.fromiter(map(len, pieces), np.int64, len(pieces)), by.tokens(pieces), by)

    def _deal(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = max(1, -(-len(chars) // BLOCK))
        self.leaves = 1 << (n - 1).bit_length()
        self.blocks = [(chars[k * BLOCK : (k + 1) * BLOCK], tokens[k * BLOCK : (k + 1) * BLOCK]) for k in range(n)]
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        starts = np.arange(n) * BLOCK
        if len(chars):
            self.sums[self.leaves : self.leaves + n] = np.stack([np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)], axis=1)
        at = self.leaves
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(-1, 2, 2).sum(axis=1)
            at //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([b[k] for b in self.blocks]) for k in (0, 1))

    def _find(self, pos: int) -> tuple[int, int]:
        """The block that holds character pos (the last one beyond the end), and the characters before it."""
        at, before = 1, 0
        while at < self.leaves:
            at *= 2
            if pos >= before + self.sums[at, 0]:
                before += int(self.sums[at, 0])
                at += 1
        k = at - self.leaves
        if k >= len(self.blocks):
            k = len(self.blocks) - 1
            before = int(self.sums[1, 0]) - int(self.blocks[k][0].sum())
        return k, before

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        k, before = self._find(max(0, start - BACK))
        while k and before + BACK > start:
            k -= 1
            before -= int(self.blocks[k][0].sum())
        ends = before + np.cumsum(self.blocks[k][0])
        keep = int(np.searchsorted(ends, start - BACK, "right"))  # pre-tokens of block k that stand
        begin = int(ends[keep - 1]) if keep else before
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - size
        # Old ends of pre-tokens from the edit's end on, block by block as the scan gets there.
        last, at_old, old_ends = k, before, np.r_[before, ends]
        pieces, at = [], begin
        done = None
        for m in self.by.pattern.finditer(text, begin):
            old = at - shift
            if pieces and old >= end:
                while old > old_ends[-1] and last + 1 < len(self.blocks):
                    last += 1
                    at_old = int(old_ends[-1])
                    old_ends = np.r_[at_old, at_old + np.cumsum(self.blocks[last][0])]
                hit = int(np.searchsorted(old_ends, old))
                if hit < len(old_ends) and old_ends[hit] == old:
                    done = hit
                    break
            pieces.append(m.group())
            at = m.end()
        if done is None:  # to the end of the text
            last, done = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.redone += len(pieces)
        self.text = text
        chars = np.concatenate([self.blocks[k][0][:keep], np.fromiter(map(len, pieces), np.int64, len(pieces)), self.blocks[last][0][done:]])
        tokens = np.concatenate([self.blocks[k][1][:keep], self.by.tokens(pieces), self.blocks[last][1][done:]])
        span = last - k + 1
        if len(chars) > 4 * BLOCK * span:
            old = [(b[0], b[1]) for b in self.blocks[:k]] + [(chars, tokens)] + [(b[0], b[1]) for b in self.blocks[last + 1 :]]
            self._deal(np.concatenate([x[0] for x in old]), np.concatenate([x[1] for x in old]))
            return
        cuts = np.linspace(0, len(chars), span + 1).astype(int)
        for i in range(span):
            self.blocks[k + i] = (chars[cuts[i] : cuts[i + 1]], tokens[cuts[i] : cuts[i + 1]])
            at = self.leaves + k + i
            self.sums[at] = [self.blocks[k + i][0].sum(), self.blocks[k + i][1].sum()]
        lo, hi = (self.leaves + k) // 2, (self.leaves + last) // 2
        while lo:
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2].reshape(-1, 2, 2).sum(axis=1)
            lo, hi = lo // 2, hi // 2


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(_id, text, chars, tokens): the state of each document; chars and tokens are int32 arrays as bytes."""
    rows = keyed(docs, id_col, text=text_col)

    def each(batch):
        state = [PreTokenTree.of(x or "", counter(ranks)).state() for x in batch.column(1).to_pylist()]
        return {"_id": batch.column(0), "text": batch.column(1).fill_null(""), "chars": [s[0].astype(np.int32).tobytes() for s in state], "tokens": [s[1].astype(np.int32).tobytes() for s in state]}

    return mapped(rows, each, "_id long, text string, chars binary, tokens binary", rows=500)


def edited(states: DataFrame, edits: Column, ranks: str = RANKS) -> DataFrame:
    """states (of trees()) after edits, an array of (start, end, text), with n_tokens, n_after, n_pretokens and n_redone.

    Edits that come as a table are first gathered per document and sorted by their number."""
    rows = states.select("_id", "text", "chars", "tokens", edits.alias("edits"))

    def each(batch):
        out = {k: [] for k in ("text", "chars", "tokens", "n_tokens", "n_after", "n_pretokens", "n_redone")}
        for text, chars, tokens, todo in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            tree = PreTokenTree(text, *(np.frombuffer(x, np.int32).astype(np.int64) for x in (chars, tokens)), counter(ranks))
            out["n_tokens"].append(tree.n_tokens)
            out["n_pretokens"].append(len(chars) // 4)
            for e in todo or []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
            after = tree.state()
            for k, v in (("text", tree.text), ("chars", after[0].astype(np.int32).tobytes()), ("tokens", after[1].astype(np.int32).tobytes()), ("n_after", tree.n_tokens), ("n_redone", tree.redone)):
                out[k].append(v)
        return {"_id": batch.column(0)} | {k: as_arrow(v, pa.binary() if k in ("chars", "tokens") else pa.string() if k == "text" else pa.int64()) for k, v in out.items()}

    return mapped(rows, each, "_id long, text string, chars binary, tokens binary, n_tokens long, n_after long, n_pretokens long, n_redone long", rows=500)


def revision(text: Column) -> Column:
    """The edits of a revision that every document gets: a note put in, a passage cut, the end replaced."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("text"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(edit(third, third, " [corrected 2024]"), edit(half, half + 40, ""), edit(n - 30, n - 20, "'re done.\n"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after a revision, recounted only around its edits."""
    out = edited(trees(spark.read.parquet(f"{sf_dir}/documents.parquet")), revision(F.col("text")))
    return out.select(unkeyed().alias("doc_id"), "n_tokens", "n_after", "n_pretokens", "n_redone", F.length("text").cast("long").alias("n_chars_after"))
