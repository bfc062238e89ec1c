"""Operators that learn or count: held-out results, and exact parts against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import context_mixing, gbdt, quality, token_counts
from factloom.llm.common import word_hashes

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    from __spark_entry__ import queries

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in queries()["op9_quality"](spark, SF).collect() if r.doc_id in labels and r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "some text here", 3.0), (2, "", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(2, None), (2, 1), (2, 1), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, odd).feature.shape == (40, 15)
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = gbdt.fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_context_mixing(spark):
    rng = random.Random(1)
    vocab = ["the", "of", *("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(2, 5))) for _ in range(300))]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([2, 20, 302])]) for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "The unseenword"), (302, "x" * 3000), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, h int").repartition(3)
    got = context_mixing.scored(df).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-(2**63) if i is None else i, len(w := toks(t)), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t in rows)
    assert sorted((r._id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert context_mixing.scored(df.limit(0)).count() == 0


def test_long_unseen_words_cost_by_their_length(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(40)), 0) for i in range(60)]
    word = "".join(rng.choice("qzjxvw") for _ in range(6000))
    rows += [(None, word[:3000], 0), (None, word, 0)]
    a, b = sorted((r.score for r in context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string, h int")).where("n_tokens = 2").collect()), reverse=True)
    assert a < -1000 and 1.8 < b / a < 2.2


def test_context_mixing_beats_the_base_on_held_out_documents(spark):
    from __spark_entry__ import queries

    test = [r for r in queries()["op5_context_mixing"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in test) > 0.9 * sum(r.base_score for r in test)
    assert np.mean([r.token_score > r.base_score for r in test]) > 0.95  # new words as one kind of token for both


def small_model(rng, n=40_000):
    """A code and a model of a small random corpus, with its words' hashes and counts."""
    hashes = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 90, len(hashes))
    hashes, counts = np.r_[hashes, context_mixing.END], np.r_[counts, 200]
    lead = np.argsort(-counts[:-1], kind="stable")[: context_mixing.LEAD]
    buckets = np.bincount((hashes >> np.uint64(56)).astype(int), counts, 256).astype(np.int64)
    code = context_mixing.Code(hashes, counts, lead, buckets, int(counts.sum()), len(counts), 30)
    seen = [rng.integers(0, 100, size) * (rng.random(size) < 0.5) for size in code.table_sizes()]
    model = context_mixing.Model(seen, [(x * rng.random(len(x))).astype(int) for x in seen])
    model.weights += (rng.normal(size=model.weights.shape) * 0.01).astype(np.float32)
    model.refine = np.clip(model.refine + rng.normal(size=model.refine.shape) * 0.02, 0.01, 0.99).astype(np.float32)
    return code, model, hashes, counts


def plain_bits(code, model, h, state):
    """log10 of each bit's probability, bit by bit, and the weights and map that a document has learnt at its end."""
    w, hits, every, waiting, out, n = *state, [], [], 0
    for k, word in enumerate(h):
        sym = int(code.look_up(np.array([word]))[0][0])
        last, two = (h[k - 1] if k else np.uint64(1)), (h[k - 2] if k > 1 else np.uint64(1))
        one = context_mixing.mixed(np.array([last]) * context_mixing._K).astype(np.uint32)[0]
        both = context_mixing.mixed(context_mixing.mixed(np.array([two]) * context_mixing._K) + last).astype(np.uint32)[0]
        for at in range(code.offsets[sym], code.offsets[sym + 1]):
            node, bit = int(code.nodes[at]), float(code.values[at])
            hashed = [context_mixing._slot(np.array([c]) + np.array([node], np.uint32) * context_mixing._K32, code.bits)[0] for c in (one, both)]
            got = [int(model.slots[t][s]) for t, s in enumerate((node, *hashed))]
            x = [np.int8(np.uint8(g & 255)) / 16 for g in got] + [0.3]
            gate = (got[1] >> 8) * 4 + (got[2] >> 8)
            dot = sum(a * b for a, b in zip(x, w[gate], strict=True))
            p = 1 / (1 + np.exp(-dot))
            cell = int(np.clip((dot + 8) * 2, 0, 32))
            out.append(np.log10(np.clip((p + hits[gate, cell] / every[gate, cell]) / 2, 1e-5, 1 - 1e-5) * bit + (1 - np.clip((p + hits[gate, cell] / every[gate, cell]) / 2, 1e-5, 1 - 1e-5)) * (1 - bit)))
            waiting.append((gate, cell, x, bit, p))
            n += 1
            if n % context_mixing.BLOCK == 0:
                for g, c, v, y, q in waiting:
                    w[g] += model.rate * (y - q) * np.array(v)
                    hits[g, c] += y
                    every[g, c] += 1
                waiting = []
    return out


def test_context_mixing_against_bit_by_bit():
    rng = np.random.default_rng(3)
    code, model, hashes, _ = small_model(rng)
    texts_ = [np.append(rng.choice(hashes[:-1], k), context_mixing.END) for k in (300, 0, 1, 170)]
    texts_[0][5] = np.uint64(12345)  # a word that training lacks
    part = context_mixing.Slice(code, list(range(4)), texts_, False, np.ones(2, np.uint64))
    size, bit, slots = code.path(part.sym, part.one, part.two)
    doc = np.repeat(part.doc, size)
    starts = np.searchsorted(doc, np.arange(4))
    x, gate = model.inputs(slots)
    p = model.predict(x, gate, bit, doc, np.arange(len(bit)) - starts[doc], context_mixing.State(model, 4)).astype(float)
    got = np.log10(np.where(bit, p, 1 - p))
    start = lambda: (model.weights.astype(float).copy(), context_mixing.PRIOR * model.refine.astype(float), np.full(model.refine.shape, context_mixing.PRIOR))
    want = np.concatenate([plain_bits(code, model, h, start()) for h in texts_])
    # Single precision may put a prediction on the border of two cells of the map into the other one.
    assert len(want) > 4 * context_mixing.BLOCK and (np.abs(got - want) < 2e-3).mean() > 0.98 and abs(got.sum() / want.sum() - 1) < 2e-3


def test_context_mixing_is_a_probability():
    """After any words, the probabilities of all known words, an end and something new add up to 1."""
    rng = np.random.default_rng(4)
    code, model, hashes, counts = small_model(rng)
    for before in (rng.choice(hashes, 2), np.ones(2, np.uint64)):
        syms = np.arange(len(code.offsets) - 1)
        syms = np.r_[syms[: code.end - 1], syms[code.end :]]  # the escape's code is the beginning of those behind it
        one = np.full(len(syms), context_mixing.mixed(before[1:] * context_mixing._K).astype(np.uint32)[0])
        size, bit, slots = code.path(syms, one, one)
        x, gate = model.inputs(slots)
        p = model.predict(x, gate, bit, np.repeat(np.arange(len(syms)), size), np.zeros(len(bit), int), context_mixing.State(model, len(syms))).astype(float)
        each = 10 ** np.add.reduceat(np.log10(np.where(bit, p, 1 - p)), np.cumsum(size) - size)
        assert abs(each.sum() - 1) < 1e-4
        sym, count = code.look_up(hashes)
        of = dict(zip(syms.tolist(), each.tolist(), strict=True))
        words = sum(of[int(s)] * ((1 - code.new) * c / code.rest[s - code.fresh] if s >= code.fresh else 1) for s, c in zip(sym, count, strict=True))
        behind = sum(v for k, v in of.items() if k >= code.fresh)
        empty = sum(of[code.fresh + b] for b in range(256) if not ((hashes >> np.uint64(56)).astype(int) == b).any())
        assert words + code.new * behind + (1 - code.new) * empty <= 1 + 1e-4 and words > 0.3


def test_long_texts_are_scored_in_slices_alike(monkeypatch):
    """A text cut into slices has the bits and contexts of the whole one."""
    rng = np.random.default_rng(5)
    code, model, hashes, _ = small_model(rng)
    h = np.append(rng.choice(hashes[:-1], 500), context_mixing.END)
    whole = context_mixing.Slice(code, [0], [h], False, np.ones(2, np.uint64))
    cut = [context_mixing.Slice(code, [0], [h[a : a + 200]], a > 0, h[a - 2 : a] if a else np.ones(2, np.uint64)) for a in range(0, len(h), 200)]
    for name in ("sym", "one", "two"):
        assert (np.concatenate([getattr(x, name) for x in cut]) == getattr(whole, name)).all()


def test_spelling():
    cut, bit, slots = context_mixing.spelled([b"ab", b"c"])
    assert cut.tolist() == [0, 24] and len(bit) == 40 and len(slots) == len(context_mixing.SPELL)
    assert np.packbits(bit).tobytes() == b"ab c "


def test_token_counts():
    by = token_counts.counter()
    rng = random.Random(1)
    bits = ["'s", "'re", " ", "  ", "\n", " \n ", "a", "1", "!", "é", "'", " don't", "..", "word", "  x", "漢"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 60, 600])))
        tree = token_counts.PreTokenTree.of(text, by)
        for _ in range(5):
            a = rng.randint(0, len(text) + 1)
            b, new = a + rng.choice([0, 1, 3, 100]), "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 9, 500])))
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_tokens == by.count(text) and int(tree.sums[1, 0]) == len(text)


def test_token_counts_of_a_table(spark):
    rows = [(1, "Some text, it's here. " * 40), (2, None), (None, ""), (1, "again")]
    states = token_counts.trees(spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, chars binary"))
    got = token_counts.edited(states, token_counts.revision(F.col("text"))).collect()
    by = token_counts.counter()
    assert len(got) == 4 and all(r.n_after == by.count(r.text) for r in got)
    long = next(r for r in got if r.n_tokens > 100)
    assert long.n_redone < 0.2 * long.n_pretokens
    null = token_counts.edited(states, F.lit(None).cast("array<struct<start:long,end:long,text:string>>")).collect()
    assert sorted(r.n_after for r in null) == sorted(by.count(t or "") for _, t in rows)


def test_pipeline_stages(spark):
    """Each stage against what its operator's own results say, on all that its predecessor kept."""
    from test_exact import components, lines_expected, sets

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols, sf = docs.columns, "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    kept = stages["quality classifier"](spark, docs, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    marked = kept[kept.doc_id.isin(labels.index)]
    assert list(kept.columns) == cols and (labels[marked.doc_id] == 1).mean() > 0.9
    step = stages["line dedup"](spark, spark.createDataFrame(kept), sf).toPandas()
    want = {i: (t, n) for i, _, n, t in lines_expected(list(zip(kept.doc_id, kept.text, strict=True)))}
    assert {i: t for i, t in zip(step.doc_id, step.text, strict=True)} == {i: t for i, (t, n) in want.items() if not n or t.split()}
    near = stages["n-gram Jaccard join"](spark, spark.createDataFrame(step), sf).toPandas()
    own = [(i, sets(t)) for i, t in zip(step.doc_id, step.text, strict=True)]
    comp = components([i for i, _ in own], [(a, b) for k, (a, s) in enumerate(own) for b, r in own[:k] if s and r and 100 * len(s & r) >= 80 * len(s | r)])
    assert sorted(near.doc_id) == sorted(i for i, c in comp.items() if i == c)
    clean = stages["benchmark decontamination"](spark, spark.createDataFrame(near), sf).toPandas()
    items = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (s := sets(r.text))]
    assert sorted(clean.doc_id) == sorted(i for i, t in zip(near.doc_id, near.text, strict=True) if not any(100 * len(q & sets(t)) >= 80 * len(q) for q in items))
    mix = stages["mixing sources to target weights"](spark, spark.createDataFrame(clean), sf).toPandas()
    size = clean.text.map(lambda t: len(t.encode().split()))
    assert mix.position.is_monotonic_increasing and abs(mix.words.sum() - min(1.5 * size.sum(), 2 * size.sum())) < 30
    assert set(mix.doc_id) <= set(clean.doc_id)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(None, None, "s", 1), (2, "", None, 0), (2, "", None, 0), (3, "word " * 4000, "s", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_chars long, `_id` int")
    for odd in (df, df.limit(0)):
        docs = odd
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()


def test_a_text_of_more_than_a_slice_is_scored(spark):
    """Some 0.7 MB of words go in several slices, with the base of brute force."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(130_000))
    rows = [(k, " ".join(rng.choice(words) for _ in range(100)), 0) for k in range(40)] + [(None, long, 0)]
    got = {r._id: r for r in context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string, h int")).collect()}
    one = got[-(2**63)]
    assert one.n_tokens == 130_001 and one.n_known <= one.n_tokens and one.score < 0
    c = Counter(w for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    assert abs(one.base_score - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*long.split(), None])) < 1e-3


def test_no_texts_to_count(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.edited(token_counts.trees(none), token_counts.revision(F.col("text"))).count() == 0


def plain_trees(x, y, trees, depth, rate=0.2, bins=64, l2=1.0, least=5):
    """The same trees node by node and split by split: a list of nested (feature, threshold, left, right) or leaf values."""
    n, width = x.shape
    base = np.log((y.sum() + 0.5) / (n + 1) / (1 - (y.sum() + 0.5) / (n + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    raw, out = np.full(n, base), []

    def grow(rows, level):
        g, h = p[rows] - y[rows], p[rows] * (1 - p[rows])
        if level == depth:
            return -rate * g.sum() / (h.sum() + l2)
        best = (1e-9, None, None)
        for f in range(width):
            for e in edges[f]:
                left = x[rows, f] <= e
                if left.sum() >= least and (~left).sum() >= least:
                    gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, e)
        if best[1] is None:
            return (0, np.inf, grow(rows, level + 1), grow(rows[:0], level + 1))
        right = x[rows, best[1]] > best[2]
        return (best[1], best[2], grow(rows[~right], level + 1), grow(rows[right], level + 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        out.append(grow(np.arange(n), 0))
        raw = raw + np.array([walked(out[-1], r) for r in x])
    return base, out


def walked(node, row):
    while isinstance(node, tuple):
        node = node[3] if row[node[0]] > node[1] else node[2]
    return node


def nested(trees, t, node=0):
    inner = trees.feature.shape[1]
    if node >= inner:
        return trees.leaf[t, node - inner]
    return (int(trees.feature[t, node]), trees.threshold[t, node], nested(trees, t, 2 * node + 1), nested(trees, t, 2 * node + 2))


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(4)
    for seed in range(3):
        x = rng.normal(size=(120, 4)).round(2)
        y = ((x[:, 0] > 0.2) ^ (x[:, 1] + 0.3 * rng.normal(size=120) > 0)).astype(float)
        fitted = gbdt.fit(x, y, trees=5, depth=3)
        base, plain = plain_trees(x, y, 5, 3)
        new = rng.normal(size=(200, 4)).round(2)
        want = 1 / (1 + np.exp(-(base + np.array([sum(walked(t, r) for t in plain) for r in new]))))
        assert np.allclose(fitted.predict(new), want, atol=1e-9), seed


def test_quality_scores_equal_walking_the_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    forest = [nested(trees, t) for t in range(len(trees.feature))]
    got = {r._id: r.score for r in quality.score(docs, trees).collect()}
    for r in docs.collect():
        raw = trees.base + sum(walked(t, quality.stats((r.text or "").encode())) for t in forest)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-raw))) < 1e-12
    learnt = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert len(got) == docs.count() and learnt & set(got)


def test_starting_weights_are_fitted_to_every_training_bit(spark):
    """Joint counts and grams of all rows, by brute force; more rows than any sample would take."""
    rng = random.Random(2)
    texts_ = [" ".join(rng.choice(["An", "the\u00e9", "of", "w" + str(rng.randrange(400))]) for _ in range(rng.randrange(6))) for _ in range(2500)]
    rows = spark.createDataFrame([(t,) for t in texts_], "text string").coalesce(1)
    code = context_mixing._code(context_mixing.written(context_mixing._counted(rows), "test"))
    send = spark.sparkContext.broadcast
    bits = context_mixing.written(context_mixing._tables(rows, send(code)), "test")
    _, said, _ = context_mixing.fitted(bits.where(f"t <> {context_mixing.GRAMS}"), code.table_sizes())
    n, ones = context_mixing._whole(context_mixing._joint(rows, send((code.short(), said))), context_mixing.JOINT)

    parts = [np.append(word_hashes(t.encode()), context_mixing.END) for t in texts_]
    part = context_mixing.Slice(code, list(range(len(parts))), parts, False, np.ones(2, np.uint64))
    _, bit, slots = code.path(part.sym, part.one, part.two)
    seen, hits = ([Counter() for _ in range(3)] for _ in range(2))
    for t in range(3):
        seen[t].update(slots[t].tolist())
        hits[t].update(slots[t][bit].tolist())
    want, want_ones = Counter(), Counter()
    for *at, y in zip(*(s.tolist() for s in slots), bit.tolist(), strict=True):
        cell = 0
        for t, s in enumerate(at):
            left, k = seen[t][s] - 1, hits[t][s] - y
            x = np.clip(np.log((k + 0.15) / (left - k + 0.15)), -7.9, 7.9)
            level = int(np.rint(x * context_mixing.STEPS)) + context_mixing.LEVELS // 2
            cell = cell * (4 * context_mixing.LEVELS if t else 1) + level + (context_mixing.LEVELS * sum(left >= e for e in (1, 8, 64)) if t else 0)
        want[cell] += 1
        want_ones[cell] += y
    assert n.sum() == len(bit) and {k: (int(n[k]), int(ones[k])) for k in np.flatnonzero(n).tolist()} == {k: (want[k], want_ones[k]) for k in want}

    count = Counter(w for t in texts_ for w in t.encode().lower().split())
    grams = Counter(bytes((w + b" ")[max(0, k - 5) : k + 1][::-1]).ljust(8, b"\0") for w in count if count[w] <= context_mixing.SELDOM for k in range(len(w) + 1))
    got = Counter()
    for r in bits.where(f"t = {context_mixing.GRAMS}").collect():
        got.update(dict(zip((bytes(r.n[k : k + 8]) for k in range(0, len(r.n), 8)), context_mixing._wide(r.ones, None, 0).tolist(), strict=True)))
    assert got == grams and len(grams) > 300
