"""Operators with exact results, against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, decontaminate, line_dedup, mixing, pq_neighbours, suffix_dedup, trie_join
from factloom.llm.components import connected
from factloom.llm.cuckoo import CuckooFilter

DDL = "doc_id long, text string, tok string, _id int, n long"


def table(spark, rows, parts=3):
    """Documents with other columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], DDL).repartition(parts)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "été", "d", "e-f", "g", "h2", "i!"]) + str(rng.randint(0, 40))
    base = [[word() for _ in range(rng.choice([3, 8, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            ws[rng.randrange(len(ws))] = word()
        rows.append((i, rng.choice([" ", "\t"]).join(ws) if rng.random() > 0.1 else rng.choice([None, "", "  \n "])))
    return rows + [(n, rows[1][1]), (None, rows[2][1]), (3, rows[3][1])]


def sets(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def key(i):
    return -(2**63) if i is None else i


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_join(spark, seed):
    rows = corpus(seed)
    own = [(key(i), sets(t)) for i, t in rows]
    linked = [(a, b) for k, (a, s) in enumerate(own) for b, r in own[:k] if s and r and 100 * len(s & r) >= 80 * len(s | r)]
    comp = components({a for a, _ in own}, linked)
    got = sorted((r._id, r.n_shingles, r.component_id) for r in trie_join.jaccard_classes(table(spark, rows)).collect())
    assert got == sorted((a, len(s), comp[a]) for a, s in own)


def test_trie_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        some = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(5)]
        many = [np.unique(np.r_[s[rng.random(len(s)) > 0.1], rng.integers(0, 60, 3).astype(np.uint64)]) for s in some for _ in range(5)]
        labels = [int(x) for x in rng.integers(0, 12, len(many))]
        is_link = lambda a, b: 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))
        got = trie_join.links(many, labels, (80, 100))
        assert all(is_link(many[a], many[b]) for a, b in got)
        same = [(a, b) for a in range(len(many)) for b in range(a) if labels[a] == labels[b]]
        every = [(a, b) for a in range(len(many)) for b in range(a) if is_link(many[a], many[b])]
        assert components(range(len(many)), same + got) == components(range(len(many)), same + every)


def test_trie_join_cuts_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "CHUNK", 3)
    monkeypatch.setattr(trie_join, "STAR", 2)
    test_trie_join(spark, 3)


@pytest.mark.parametrize("chunk", [1000, 3])
def test_trie_join_counts_every_link(spark, monkeypatch, chunk):
    """Also those within a component: variants of one text, most of which link with most others."""
    monkeypatch.setattr(trie_join, "CHUNK", chunk)
    rng = random.Random(4)
    text = [f"w{k}" for k in range(200)]
    near = [(500 + k, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(10**6)}" for w in text[: rng.randrange(170, 200)])) for k in range(30)]
    rows = corpus(4) + near + [(600, near[0][1])]
    own = [sets(t) for _, t in rows]
    want = [sum(j != k and bool(s) and bool(r) and 100 * len(s & r) >= 80 * len(s | r) for j, r in enumerate(own)) for k, s in enumerate(own)]
    assert sum(want[60:]) > 200
    got = sorted((r._id, r.n_shingles, r.n_links) for r in trie_join.jaccard_classes(table(spark, rows), counted=True).collect())
    assert got == sorted((key(i), len(s), n) for (i, _), s, n in zip(rows, own, want, strict=True))


def test_link_counts_by_the_trie():
    """Of one chunk with itself and of two, with copies, prefixes of others and sizes that can't link."""
    rng = np.random.default_rng(2)
    for turn in range(30):
        base = np.unique(rng.integers(0, 300, 40))
        sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(25, len(base) + 1)], rng.integers(0, 300, rng.integers(0, 6))]).astype(np.uint64) for _ in range(40)]
        sets += [sets[0][:-2], sets[0][:3], np.array([5], np.uint64)]
        copies = rng.integers(1, 5, len(sets))
        side = np.zeros(len(sets), np.int64) if turn % 2 else rng.integers(1, 3, len(sets))
        link = lambda i, j: i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) and (turn % 2 or side[i] != side[j])  # noqa: E731, B023
        want = [sum(copies[j] for j in range(len(sets)) if link(i, j)) for i in range(len(sets))]
        assert trie_join.link_counts(sets, copies, side, (80, 100)).tolist() == want and sum(want) > 50


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert trie_join.jaccard_classes(none).count() == 0
    assert line_dedup.LineIndex.build(none).apply(none).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert mixing.plan(mixing.sized(none.withColumn("source", F.lit("a")))).count() == 0
    assert pq_neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    want = components({x for e in edges for x in e}, edges)
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if sum(x == v for x in want.values()) > 1}


def lines_expected(rows, least=20, often=3):
    clean = lambda x: x.encode().strip().lower().decode()
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(clean(x)) >= least:
                held[clean(x)].add(key(i))
    out = []
    for i, t in rows:
        found = (t or "").split("\n")
        left = [x for x in found if not (len(h := held.get(clean(x), set())) >= often and key(i) < max(h))]
        out.append((key(i), len(found), len(found) - len(left), "\n".join(left)))
    return sorted(out)


def line_rows(seed, start=0, n=40):
    rng = random.Random(seed)
    pool = ["A Line that is Shared by many", "  a line that is shared BY many\r", "short", "ééééééééééééééééééé", "éééééééééééééééééééé", "once only " * 3, "x" * 20, "\x0btail and more of it here "]
    return [(start + i, rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(rng.choice(pool) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(7)))) for i in range(n)]


def applied(index, spark, rows):
    return sorted((r._id, r.n_lines, r.n_dropped, r.text) for r in index.apply(table(spark, rows)).collect())


def test_line_dedup(spark):
    rows = line_rows(1) + [(None, "A Line that is Shared by many"), (5, "x" * 20)]
    assert applied(line_dedup.LineIndex.build(table(spark, rows)), spark, rows) == lines_expected(rows)


def test_line_dedup_is_reversible(spark):
    old, new = line_rows(2), line_rows(3, start=100)
    first = line_dedup.LineIndex.build(table(spark, old))
    both = first.insert(table(spark, new))
    assert applied(both, spark, old + new) == lines_expected(old + new)
    back = both.delete(spark.createDataFrame([(i,) for i, _ in new], "doc_id long"))
    rows = lambda x: sorted(map(tuple, x.select("k1", "k2", "n", "top").collect()))
    assert rows(back.refs) == rows(first.refs)
    count = lambda x: sum(CuckooFilter.frombytes(bytes(r.filter)).count() for r in x.filters.collect())
    assert count(back) == count(first)
    assert applied(back, spark, old) == lines_expected(old)


def test_line_dedup_with_keys_that_the_filter_confuses(spark):
    seen, pair = {}, None
    for k in range(20_000):
        line = f"a line of its own, number {k}"
        k1 = int(np.frombuffer(line_dedup.key_of(line.encode(), 20), "<i8")[0])
        at = (k1 % 16, ((k1 % 2**64) >> 48) % 65535)  # shard and fingerprint
        if at in seen:
            pair = seen[at], line
            break
        seen[at] = line
    a, b = pair
    first = line_dedup.LineIndex.build(table(spark, [(1, a)]))
    back = first.insert(table(spark, [(2, b)])).delete(spark.createDataFrame([(2,)], "doc_id long"))
    count = lambda x: sum(CuckooFilter.frombytes(bytes(r.filter)).count() for r in x.filters.collect())
    assert count(back) == count(first) == 1
    rows = [(1, a), (3, a), (4, a)]
    again = back.insert(table(spark, rows[1:]))
    assert [(r.n, r.top) for r in again.refs.collect()] == [(3, 4)]
    assert applied(again, spark, rows) == lines_expected(rows)


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    f = CuckooFilter.of(keys)
    assert f.has(keys).all() and f.has(keys[::-1] + 1).mean() < 0.01
    assert f.remove(keys[:5000]) == 5000 and f.has(keys[5000:]).all() and f.has(keys[:5000]).mean() < 0.01
    assert CuckooFilter.of(np.array([5] * 8)).has(np.array([5]))[0]


def test_decontaminate(spark):
    rows = corpus(7, 80)
    items = [(k, t) for k, (_, t) in enumerate(rows[:20])] + [(20, " ".join((rows[4][1] or "a b").split()[5:30])), (21, "one"), (None, rows[1][1])]
    want = {(key(i), key(j), len(q), len(q & sets(t))) for i, t in rows for j, x in items if (q := sets(x)) and 100 * len(q & sets(t)) >= 80 * len(q)}
    held = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**7, 500):
        got = decontaminate.leaks(table(spark, rows), held, block_bytes=block).collect()
        assert {tuple(r) for r in got} == want
        twice = decontaminate.leaks(table(spark, rows + rows), held, block_bytes=block).collect()
        assert sorted(map(tuple, twice)) == sorted([tuple(r) for r in got] * 2)
        left = decontaminate.clean(table(spark, rows), held, block_bytes=block)
        assert sorted((key(r.doc_id), r.text or "") for r in left.collect()) == sorted((key(i), t or "") for i, t in rows if not any(100 * len(q & sets(t)) >= 80 * len(q) for _, x in items if (q := sets(x))))


def removed(rows, length=100):
    """By sets of windows; repeated rows and copies by what they are."""
    seen, out, before = set(), {}, set()
    for i, t in sorted({(key(i), t or "") for i, t in rows}, key=lambda r: r):
        b = t.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        before.add(t)
        left = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i, t] = (len(b), sum(mark), runs, hashlib.sha256(left).hexdigest())
    return sorted((key(i), *out[key(i), t or ""]) for i, t in rows)


def test_suffix_dedup(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([90, 150, 400, 1500]))) for _ in range(10)]
    piece = lambda s: s[rng.randint(0, len(s) // 2) : rng.randint(len(s) // 2, len(s))]
    rows = [(i, "".join(piece(rng.choice(base)) for _ in range(rng.randint(0, 5))) + "ab" * rng.choice([0, 0, 0, 90])) for i in range(90)]
    rows += [(100, rows[1][1]), (101, "x" * 700), (102, None), (103, ""), (7, rows[7][1]), (None, rows[3][1])]
    got = suffix_dedup.dedup(table(spark, rows)).select("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == removed(rows)


def test_run_index_keeps_little_of_repeats():
    piece = bytes(np.random.default_rng(1).integers(97, 123, 300, dtype=np.uint8))
    pieces = [piece] * 50
    index = suffix_dedup.RunIndex(pieces, np.arange(50, dtype=np.int64) << 32)
    assert len(index.head) < 400 and len(index.samples) < 400 and index.marks().sum() == 49 * 201


def test_run_index_against_brute_force():
    rng = np.random.default_rng(7)
    for trial in range(25):
        base = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(30, 120), dtype=np.uint8)) for _ in range(3)]
        pieces = []
        for _ in range(rng.integers(2, 12)):
            x = bytearray(b"".join(base[k] for k in rng.integers(0, 3, 2))[rng.integers(0, 20) :])
            for _ in range(rng.integers(0, 3)):
                x[rng.integers(0, len(x))] = 122
            pieces.append(bytes(x))
        length = int(rng.integers(14, 30))
        places = np.sort(rng.choice(40, len(pieces), False)).astype(np.int64) << 32
        if trial % 3 == 0:  # pieces that overlap in one document
            whole = b"".join(pieces)
            pieces = [whole[k : k + 60 + length - 1] for k in range(0, max(1, len(whole) - length + 1), 60)]
            places = np.arange(len(pieces), dtype=np.int64) * 60
        index = suffix_dedup.RunIndex(pieces, places, length)
        first = {}
        for p, piece in zip(places.tolist(), pieces, strict=True):
            for k in range(len(piece) - length + 1):
                w = piece[k : k + length]
                first[w] = min(first.get(w, p + k), p + k)
        want = np.zeros(int((index.sizes + 1).sum()), bool)
        for s, p, piece in zip(index.starts.tolist(), places.tolist(), pieces, strict=True):
            for k in range(len(piece) - length + 1):
                want[s + k] = first[piece[k : k + length]] < p + k
        assert (index.marks() == want).all()
        for piece, at, match, earliest in index.statistics():
            for i, a, m, e in zip(piece.tolist(), at.tolist(), match.tolist(), earliest.tolist(), strict=True):
                j = int(np.searchsorted(places, e, "right")) - 1
                mine = pieces[i][a - int(index.starts[i]) :]
                assert m >= length and len(mine) >= m and any(pieces[q][e - int(places[q]) :].startswith(mine[:m]) for q in range(j + 1) if e >= places[q])


def test_chat_format(spark):
    rng = random.Random(2)
    bits = ["<|turn|>", "\\", "<", "|>", "<|", "é", "漢", "🙂", " a", "\n", "<|endoftext|>", "### Assistant:", ""]
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "odd<|text|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12))) if rng.random() > 0.1 else None) for c in [*range(25), None] for k in range(rng.randrange(1, 7))]
    rows += [(3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (4, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[key(c)] = (len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), digest(loss))
    for segment in (10**6, 10):
        got = chat_format.digests(chat_format.formatted(df, segment=segment)).collect()
        assert {r[0]: tuple(r)[1:5] for r in got} == want


def test_mask_tokens_lie_in_assistant_texts():
    text, spans = chat_format.render([("user", "hi."), ("assistant", "ok.</s> 🙂"), ("assistant", "")])
    code = chat_format.tokenizer(chat_format.TOKENIZER).encode(text, add_special_tokens=False)
    mask, union = chat_format.masked(np.array(code.offsets), spans)
    assert [text[a:b] for a, b in union] == ["ok.</s> 🙂"]
    assert all((a >= spans[0][0] and b <= spans[0][1]) == m for (a, b), m in zip(code.offsets, mask, strict=True))


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i if i else None, " ".join(["w"] * rng.randrange(30)) if rng.random() > 0.1 else None, rng.choice(["a", "b", "b", "b", "ç", None, "one"])) for i in range(300)]
    rows.append((301, "w " * 50, "solo"))
    rows += [(302, "w w w", "b")] * 3 + [(303, "w w", "a"), (303, "w " * 9, "a"), (303, "w", None)]  # ids that repeat, with equal rows and others
    df = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, source string, target string").repartition(4)
    got = mixing.plan(mixing.sized(df)).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    taken, target = defaultdict(int), {}
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, left, rest = {}, dict(weight), 1.5 * sum(total.values())
    while left:
        level = rest / sum(left.values())
        full = [s for s in left if level * left[s] > 2 * total[s]]
        if not full:
            want |= {s: level * w for s, w in left.items()}
            break
        for s in full:
            want[s] = 2.0 * total[s]
            rest -= want[s]
            del left[s]
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = mixing.plan(mixing.sized(df.repartition(2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_follow_the_schedule(spark):
    x = spark.range(0, 1001).select((F.col("id") / 1000).alias("x"))
    for knots in mixing.SCHEDULES:
        got = np.array([r[0] for r in x.select(mixing.inverted(F.col("x"), knots)).collect()])
        t, w = np.array(knots).T
        grid = np.linspace(0, 1, 200_001)
        area = np.cumsum(np.interp(grid, t, w))
        assert np.abs(np.interp(got, grid, area / area[-1]) - np.arange(1001) / 1000).max() < 1e-4


def test_recall_with_more_lists_than_probes(spark):
    """Of 5,000 vectors in groups, with 70 lists and 4 probes a vector."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 24))
    x = (base[rng.integers(0, 900, 5000)] + rng.normal(size=(5000, 24)) * rng.choice([0.1, 0.2, 0.3], (5000, 1))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = sum(int((unit[k : k + 500] @ unit.T >= 0.95).sum()) for k in range(0, 5000, 500)) - 5000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sum(r.n_links for r in pq_neighbours.neighbours(df, probes=4).collect())
    assert want > 5000 and 0.9 * want <= got <= want


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3]) * (i >= 30)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), (401, [2 * x for x in rows[0][1]]), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, [None, *rows[0][1][1:]]), (406, [1.0, 2.0]), (None, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, k int").repartition(3)
    rows += [(408, [2.0, 4.0]), (409, [1.0, -2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, k int").repartition(3)
    ok = {key(i): np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links = defaultdict(int)
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    comp = components({key(i) for i, _ in rows}, linked)
    got = pq_neighbours.neighbours(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * sum(links[key(i)] for i, _ in rows) and all(r.n_links <= links[r._id] for r in got)
    assert sum(r.component_id == comp[r._id] for r in got) >= 0.95 * len(got)


def test_texts_of_more_than_a_slice(spark):
    """Texts over 1 MiB, beyond which they are hashed one by one, in every operator of lines, words and bytes."""
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(220_000))
    near = long + " and a few words more"
    rows = [(1, long), (2, near), (3, "short one"), (4, long[500_000:500_900]), (5, None), (6, "x" * 1_200_000)]
    assert len(long) > 1 << 20
    df = table(spark, rows)
    own = [sets(t) for _, t in rows]
    got = {r._id: (r.n_shingles, r.component_id) for r in trie_join.jaccard_classes(df).collect()}
    assert got == {i: (len(s), 1 if i == 2 else i) for (i, _), s in zip(rows, own, strict=True)}
    item = " ".join(long.split()[150_000:150_020])
    held = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r._id for r in decontaminate.leaks(df, held).collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate.clean(df, held).collect()) == [3, 4, 5, 6]
    cut = {r._id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).collect()}
    assert cut[1][1] == 0 and cut[2][1] == len(long) and cut[4] == (900, 900) and cut[6] == (1_200_000, 1_199_999)
    sizes = {r._id: r.size for r in mixing.sized(df.withColumn("source", F.lit("a"))).collect()}
    assert sizes == {1: 220_000, 2: 220_005, 3: 2, 4: len(rows[3][1].split()), 5: 0, 6: 1}
    assert line_dedup.LineIndex.build(df).apply(df).agg(F.sum("n_dropped")).first()[0] == 0


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(none)).count() == 0


def test_pq_vectors_of_any_size(spark):
    """Squares that over- or underflow make no difference: the cosine alone counts."""
    rows = [(1, [1.0, 1.0]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.7e308, 1.6e308]), (5, [5e-324, 5e-324]), (6, [1e200, -1e200]), (7, [0.0, 0.0]), (8, [1e-160, -1e-160]), (9, [float("inf"), 1.0])]
    got = {r._id: (r.n_links, r.component_id) for r in pq_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5), (4, 1)), 6: (1, 6), 8: (1, 6), 7: (0, 7), 9: (0, 9)}


def crowded(spark, n=2500, same_id=True):
    """n rows that share an id (or null) with texts of their own that all hold a passage, near copies among them, and rows that repeat."""
    rng = random.Random(12)
    passage = " ".join(f"word{rng.randrange(10**6)}" for _ in range(20))
    rows = []
    for k in range(n):
        own = " ".join(f"w{rng.randrange(10**5)}" for _ in range(12))
        rows.append(f"{own}\n{passage}\n{own[::-1]}")
    rows = [t if k % 10 else rows[0] + f" x{k % 3}" for k, t in enumerate(rows)]
    return [(None if same_id is None else 7 if same_id else k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("kind", [None, True])
def test_many_rows_of_one_id_cost_no_more(spark, kind):
    """Null ids and one id of thousands of rows take about as long as ids of their own, and rows fare as if judged one by one."""
    import time

    took, out = {}, {}
    for ids in (False, kind):
        rows = crowded(spark, same_id=ids)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        start = time.time()
        out[ids] = (
            sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).select("n_bytes", "n_removed").collect()),
            sorted(r.n_shingles for r in trie_join.jaccard_classes(df).select("n_shingles").collect()),
            sorted(r.n_dropped for r in line_dedup.LineIndex.build(df).apply(df).select("n_dropped").collect()),
        )
        took[ids] = time.time() - start
    assert took[kind] < 3 * took[False] + 20
    sizes = sorted(len(t.encode()) for _, t in rows)
    assert [n for n, _ in out[kind][0]] == sizes and out[kind][1] == out[False][1]
    assert set(out[kind][2]) == {0}  # one document, so no line is held by three
    assert sum(m for _, m in out[False][0]) > 0


def test_many_large_conversations_are_encoded_in_bounded_batches(spark, monkeypatch):
    """Conversations just under a segment flush by their characters, not by their number of turns."""
    sizes = []
    true_tokenizer = chat_format.tokenizer

    class Watched:
        def encode_batch(self, many, **more):
            sizes.append(sum(map(len, many)))
            return true_tokenizer(chat_format.TOKENIZER).encode_batch(many, **more)

    rows = [(c, t, "assistant" if t else "user", "word " * 180) for c in range(60) for t in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    plain = sorted(map(tuple, chat_format.digests(chat_format.formatted(df)).drop("n_tokens", "loss_tokens").collect()))
    parts = chat_format.formatted(df, segment=2000)
    assert parts.count() == 60 and sorted(map(tuple, chat_format.digests(parts).drop("n_tokens", "loss_tokens").collect())) == plain
    batches = []
    monkeypatch.setattr(chat_format, "tokenizer", lambda path: Watched())
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: batches.append(f) or self)
    chat_format.formatted(df, segment=2000)
    list(batches[0]([__import__("pyarrow").RecordBatch.from_pydict({"_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})]))
    assert max(sizes) < 3 * 2000 and len(sizes) >= 30


def test_line_index_grows_shards(spark, monkeypatch):
    """Inserts deal an index into more shards; counts, filters and deletions stay right."""
    from factloom.llm import line_dedup as ld

    monkeypatch.setattr(ld, "SHARD_KEYS", 20)
    text = lambda k: "\n".join(f"a line of document {k % 7} number {j}, long enough" for j in range(20))
    docs = spark.createDataFrame([(k, text(k)) for k in range(30)], "doc_id long, text string")
    index = ld.LineIndex.build(docs.where("doc_id < 3"), shards=1)
    assert index.shards == 1
    index = index.insert(docs.where("doc_id >= 3"))
    assert index.shards == 7 and index.refs.count() == 140 and index.filters.count() <= 7
    fresh = ld.LineIndex.build(docs, shards=7)
    key = lambda df: sorted(map(tuple, df.select("k1", "k2", "n", "top").collect()))
    assert key(index.refs) == key(fresh.refs)
    keys = np.array([r.k1 for r in index.refs.collect()])
    held = {r.shard: ld.CuckooFilter.frombytes(r.filter) for r in index.filters.collect()}
    assert all(held[int(k % 7)].has(np.array([k]))[0] for k in keys)
    gone = index.delete(docs.where("doc_id % 7 = 2"))
    assert gone.refs.count() == 120 and sum(ld.CuckooFilter.frombytes(r.filter).count() for r in gone.filters.collect()) == 120


def test_jaccard_join_frees_what_it_broadcast(spark, monkeypatch):
    """The bit maps don't stay with the driver and executors once the tables that need them are written."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(send(self, x)) or sent[-1])
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z 1", "x y", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for counted in (False, True):
        got = trie_join.jaccard_classes(df, counted=counted).collect()
        assert sorted((r._id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert len(sent) > 4 and not any(x._jbroadcast.isValid() for x in sent)


def jobs_of(spark, run) -> tuple[object, int]:
    """What run() gives and how many jobs it starts, with ten shuffle partitions that stay apart."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "10"}
    old = {k: spark.conf.get(k) for k in conf}
    spark.sparkContext.setJobGroup(group := f"jobs-{random.random()}", "")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_edges_without_rounds(spark):
    """A chain of 200 and loose edges need no rounds, each of which would be jobs and state on the driver."""
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(50)]
    rng.shuffle(edges)
    want = {k: v for k, v in components({x for a, b in edges if a != b for x in (a, b)}, edges).items()}
    got, n = jobs_of(spark, lambda: {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()})
    assert got == want and n <= 12


@pytest.mark.parametrize("few", [0, 7])
def test_components_of_more_edges_than_few(spark, monkeypatch, few):
    from factloom.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    test_components(spark)
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in edges[k : k + 4]], pa.int64()) for c in (0, 1)], names=["a", "b"]) for k in range(0, 45, 4)]
    stars = [(a, b) for x in module._stars(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    ids = {x for e in edges for x in e}
    assert components(ids, stars) == components(ids, edges)


def test_benchmark_items_are_read_in_one_job(spark):
    """Not in a job for each partition of the sorted items."""
    held = spark.createDataFrame([(k, f"w{k} a b c d e f g") for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x W7 a b c d e f g y"), (2, "nothing of them here at all")], "doc_id long, text string")
    left, n = jobs_of(spark, lambda: decontaminate.clean(docs, held))
    assert [r.doc_id for r in left.collect()] == [2] and n <= 6
