"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered as ``<|turn|>role<|text|>text<|end|>``, one after
the other. In roles and texts a backslash becomes two, and ``<|`` becomes ``<\\|``, so
no text can hold a marker or any other control string of the vocabulary, and read()
undoes it. The markers are added to the tokenizer as special tokens, so no token
straddles a marker and a text.

The rendered text is encoded once, with character offsets. Token spans and the sorted
spans of the assistant's texts are intersected by binary search: a token is under the
loss mask if it overlaps such a span. As parts of one character share its offsets,
the text under the mask is the union of the overlaps.

Rows of a conversation are ordered by turn, then role and text; repeated rows are
turns of their own. Null text or role: empty. Null turn: first. Null ids are one
conversation. A conversation is streamed in segments of whole turns, so one that
holds any share of all rows needs bounded memory; encoding by segments is encoding
the whole, as markers split the text before anything else.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, unkeyed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MARKERS = TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Characters after which a segment of a conversation ends at the next turn.
SEGMENT = 1_000_000


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray]:
    """The formatted turns, and the sorted (start, end) spans of the texts that the loss is on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        parts = (TURN, escaped(role), TEXT, escaped(text), END)
        begin = at + sum(map(len, parts[:3]))
        if role == loss_role and text:
            spans.append((begin, begin + len(parts[3])))
        out.extend(parts)
        at += sum(map(len, parts))
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.split(TEXT)
        turns.append((unescaped(role), unescaped(text[: -len(END)])))
    return turns


def masked(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens (start, end) overlap a span, and the union of the overlaps as sorted (start, end)."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets) or not len(spans):
        return mask, np.zeros((0, 2), np.int64)
    start, end = offsets[:, 0], offsets[:, 1]
    first = np.searchsorted(spans[:, 1], start, "right")  # the first span that ends after the token starts
    last = np.searchsorted(spans[:, 0], end, "left")  # spans from here on start at its end or later
    mask = (first < last) & (end > start)
    over = [(max(start[k], spans[s, 0]), min(end[k], spans[s, 1])) for k in np.flatnonzero(mask & (last - first > 1)) for s in range(first[k], last[k])]
    one = np.flatnonzero(mask & (last - first == 1))
    both = np.stack([np.maximum(start[one], spans[first[one], 0]), np.minimum(end[one], spans[first[one], 1])], axis=1)
    both = np.concatenate([both, np.array(over, np.int64).reshape(-1, 2)])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    reach = np.maximum.accumulate(both[:, 1])
    fresh = np.r_[True, both[1:, 0] > reach[:-1]]
    starts = np.flatnonzero(fresh)
    return mask, np.stack([both[starts, 0], np.maximum.reduceat(both[:, 1], starts)], axis=1)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(m, normalized=False) for m in MARKERS])
    return out


def formatted(conversations: DataFrame, path: str = TOKENIZER, loss_role: str = LOSS_ROLE, segment: int = SEGMENT) -> DataFrame:
    """(_id, part, turns, text, ids, mask, spans): rendered conversations in segments of whole turns, in order within a partition.

    spans are the starts and ends of the text under the mask, end to end."""
    rows = keyed(conversations, "conv_id", turn="turn", role="role", text="text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.repartition("_id").sortWithinPartitions("_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("_id", pa.int64()), ("part", pa.int64()), ("turns", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        last, part, turns, size, ready, held = None, 0, [], 0, [], 0

        def batch_of(ready):
            done = [(i, p, len(t), *render(t, loss_role)) for i, p, t in ready]
            codes = tokenizer(path).encode_batch([x[3] for x in done], add_special_tokens=False)
            masks = [masked(np.array(c.offsets, np.int64).reshape(-1, 2), x[4]) for c, x in zip(codes, done, strict=True)]
            cols = [[x[k] for x in done] for k in range(4)] + [[c.ids for c in codes], [m.tolist() for m, _ in masks], [s.ravel().tolist() for _, s in masks]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if turns and (i != last or size >= segment):
                    ready.append((last, part, turns))
                    part, turns, held, size = part + 1, [], held + size, 0
                    if sum(len(t) for *_, t in ready) >= 500 or held >= segment:
                        yield batch_of(ready)
                        ready, held = [], 0
                if i != last:
                    last, part = i, 0
                turns.append((role, text))
                size += len(text)
        if turns:
            ready.append((last, part, turns))
        if ready:
            yield batch_of(ready)

    return rows.mapInArrow(run, "_id long, part long, turns long, text string, ids array<int>, mask array<boolean>, spans array<long>")


def digests(parts: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, a row a conversation; parts stand in order, as formatted() leaves them."""
    schema = pa.schema([("_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches):
        now = None
        for batch in batches:
            out = []
            cols = [batch.column(k).to_pylist() for k in (0, 3, 5, 6)]
            for i, text, mask, spans in zip(*cols, strict=True):
                if now is None or now[0] != i:
                    if now is not None:
                        out.append(now)
                    now = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in read(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    under = unescaped(text[a:b])
                    now[3] += len(under)
                    now[4].update(under.encode())
                now[5] += len(text)
                now[6] += len(mask)
                now[7] += sum(mask)
            yield _batch(out, schema)
        if now is not None:
            yield _batch([now], schema)

    return parts.mapInArrow(run, "_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = digests(formatted(convs.unionByName(extra)))
    return out.select(unkeyed().alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")
