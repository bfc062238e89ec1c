"""Nearest neighbours, whitening and collocations against brute force, on small tables with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import collocations, rp_forest, tsqr
from factloom.llm.mph import PerfectHash

ODD = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [1.0, float("nan"), 1.0]), (6, [float("inf"), 1.0, 1.0])]
VEC = "vec_id long, embedding array<double>, d int, v string, tree int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 9, "x", 1) for i, v in rows], VEC).repartition(parts)


def brute_nearest(rows, k, query):
    """By (id, vector): rows that repeat both are one."""
    ok = sorted({(rp_null(i), tuple(map(float, v))) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)})
    out = []
    for i, v in ok:
        if query(i):
            found = []
            for j, w in ok:
                if (j, w) != (i, v) and len(v) == len(w):
                    a, b = np.array(v), np.array(w)
                    with np.errstate(over="ignore"):
                        by = 2.0 if not np.isfinite(a - b).all() else 1.0
                    apart = np.abs(a / by - b / by)
                    found.append((by * apart.max() * np.sqrt(((apart / (apart.max() or 1)) ** 2).sum()), j))
            out += [(i, r, j, d) for r, (d, j) in enumerate(sorted(found)[:k], 1)]
    return out


def rp_null(i):
    return -(2**63) if i is None else i


def near(spark, rows, k=3, **more):
    got = rp_forest.nearest(vectors(spark, rows), F.col("_id") % 10 == 0, k=k, **more)
    return sorted((r.query_id, r["rank"], r._id, r.score) for r in got.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12, atol=0)


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i + 10, rng.normal(size=3).round(1).tolist()) for i in range(80)]
    rows += [(200 + i, [1.0, 2.0, 3.0]) for i in range(30)] + [(20, rows[10][1]), (30, [5.0, 5.0, 5.0]), (None, [1.0, 2.0, 3.5]), (None, [1.0, 2.0, 3.5])]
    rows += [(400, [1e200, 1e200, -1e200]), (401, [1.7e308, 0.0, 0.0]), (410, [-1.7e308, 0.0, 0.0]), (402, [1e-200, 0.0, 0.0]), (420, [2e-200, 0.0, 0.0]), (500, [1.0]), (501, [2.0]), (502, [3.0, 4.0])]
    same(near(spark, rows + ODD), brute_nearest(rows, 3, lambda i: i % 10 == 0))
    assert near(spark, ODD) == [] and near(spark, [(10, [1.0, 2.0])]) == []
    same(near(spark, rows[:5]), brute_nearest(rows[:5], 3, lambda i: i % 10 == 0))


def test_nearest_finds_copies_through_tiles(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "TILE", 20)
    monkeypatch.setattr(rp_forest, "ASKED", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    x = (base[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.05).astype(np.float32).astype(float)
    x[:400] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = near(spark, rows, k=10), brute_nearest(rows, 10, lambda i: i % 10 == 0)
    assert len(got) == len(want)
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.95 * len(want)
    of = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(of[g[0], g[2]] - g[3]) < 1e-9 for g in got if (g[0], g[2]) in of)
    assert [g for g in got if g[0] < 400] == [w for w in sorted(want) if w[0] < 400]


def test_nearest_recall_where_few_leaves_are_asked(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = base[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.1
    forest = rp_forest.Forest(x)
    assert forest.visits < 0.2 * 4 * 2**forest.depth
    hit = 0
    for i in range(0, 6000, 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += (forest.among(forest.search(x[i], forest.visits))[np.argsort(d)[:10]]).sum()
    assert hit / 600 >= 0.93


def test_whitening(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(20, 20))
    x = (rng.normal(size=(300, 20)) @ mix).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(7, x[7]), (900, x[8]), (None, x[9]), (901, [0.0] * 20)] + [o for o in ODD if o[0] != 3] + [(902, [1e300] * 20)]
    rows += [(1000 + i, [float(i % 3), 5.0]) for i in range(9)] + [(1100, [2.0, 3.0, 4.0, 5.0])]
    got = tsqr.whiten(vectors(spark, rows, 5)).collect()
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e16]
    assert Counter(r._id for r in got) == Counter(rp_null(i) for i, v in kept for _ in range(min(16, len(v))))
    whole = {rp_null(i): np.floor(64 * np.array(v)).astype(int) + 1_000_000 for i, v in kept if len(v) == 20}
    fit = np.unique(np.stack(list(whole.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - total / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    for r in got:
        if r._id in whole:
            d = r.component - 1
            assert r.n == n and r.deviation == int(((n * whole[r._id] - total) ** 2).sum()) == int(r.deviation_text)
            assert abs(abs(r.whitened) - abs((whole[r._id] - total / n) @ v[:, d] / np.sqrt(e[d]))) < 1e-9
            assert abs(r.explained / (e[d] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    two = sorted((r._id, r.component, r.n, r.whitened is None, r.explained) for r in got if 1000 <= r._id < 1009)
    assert [t[2:] for t in two[:2]] == [(3, False, 1.0), (3, True, 0.0)] and len(two) == 18
    one = [r for r in got if r._id == 1100]
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    assert tsqr.whiten(vectors(spark, rows).limit(0)).count() == 0


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(x)] * 3) for i, x in enumerate((2**50, -(2**50), 0, 3))]
    got = {r._id: r for r in tsqr.whiten(vectors(spark, rows)).where("component = 1").collect()}
    xs = [64 * int(v[0]) + 1_000_000 for _, v in rows]
    want = [3 * (4 * x - sum(xs)) ** 2 for x in xs]
    assert [int(got[i].deviation_text) for i in range(4)] == want and got[0].deviation is None


def brute_phrases(rows, least, top):
    f, n, out = Counter(), Counter(), []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    c = {x: a for x, a in f.items() if a >= least and len(x) > 2}
    inner = {(x[0], *x[i : i + k]) for x, a in c.items() for k in range(2, len(x) - 1) for i in range(1, len(x) - k + 1) if c.get((x[0], *x[i : i + k])) == a}
    for x, a in c.items():
        if x not in inner:
            score, cut = min((1000 * a * n[x[0]] // (f[x[: k + 1]] * f[x[0], *x[k + 1 :]]), k) for k in range(1, len(x) - 1))
            out.append((x[0], -score, -a, " ".join(x[1:]).encode(), f[x[: cut + 1]], f[x[0], *x[cut + 1 :]], n[x[0]]))
    ranks = Counter()
    want = []
    for lang, s, a, p, left, right, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            want.append((lang, ranks[lang], p.decode(), -a, left, right, total, -s))
    return want


@pytest.mark.parametrize(("bits", "block", "top"), [(22, 4_000_000, 2000), (16, 40, 7)])
def test_collocations(spark, bits, block, top):
    rng = random.Random(8)
    words = ["The", "of", "Été", "x\x1cy", " ", "don't", "a", "été", "zoë"]
    text = lambda n: "".join(rng.choice(words[: rng.choice([2, 4, 9])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), text(rng.choice([1, 5, 60]))) for _ in range(120)] + [("en", None), (None, ""), ("en", " .,\n ")]
    rows += [rows[0]] * 3 + [("de", "same same same same same same same")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, n int, k int").repartition(5)
    got = collocations.collocations(df, least=6, bits=bits, block=block, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, 6, top))
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.select("lang", F.lit(None).cast("string").alias("text"))).count() == 0


@pytest.mark.parametrize(("bits", "most", "n"), [(16, 4 << 16, 3), (17, 2 << 16, 10)])
def test_collocations_in_rounds_and_bounded_sets(spark, monkeypatch, bits, most, n):
    """Counters filled some lengths or a range of buckets at a time; candidates handed out a bounded number at a time, of one partition too."""
    rng = random.Random(11)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice(["ab", "cd", "ef", f"w{rng.randrange(300)}"]) for _ in range(80))) for _ in range(60)]
    for k in (15, 31, 47):  # a long word parts a task's texts into slices
        rows.insert(k, ("en", "x" * collocations.SLICE))
    monkeypatch.setattr(collocations, "HELD", 100)
    monkeypatch.setattr(collocations.bucket_maps, "__defaults__", (most,))
    sizes, united = [], collocations.united

    def seen(pieces):
        sizes.extend(r[1] for r in pieces.groupBy("node").agg((F.sum(F.length("data")) / 16).cast("long")).collect())
        return united(pieces)

    monkeypatch.setattr(collocations, "united", seen)
    assert len(collocations.rounds(bits, most)) == n
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1), least=4, bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, 4, 2000)) and len(got) > 50
    assert 1 < len(sizes) <= collocations.FAN and max(sizes) < 4000


def test_buckets_grow_with_the_text(spark):
    of = lambda n: collocations.bits_for(spark.range(n).select(F.lit("en").alias("lang"), F.lit("x" * collocations.LOAD).alias("text")), 4)
    assert (of(0), of(16), of(17), of(1 << 10)) == (4, 4, 5, 10)


def test_collocations_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 200)
    rng = random.Random(9)
    long = " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(3000))
    rows = [("en", long), ("en", long.replace("ef ab", "ef. ab")), ("fr", "x" * 5000 + ". ab cd")]
    for lang, text in rows:
        assert b".".join(collocations.sliced(text.encode())).replace(b".", b"") == text.encode().replace(b".", b"")
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, 5, 2000))


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**9, 7 * 10**13, 9 * 10**9, 10**10)], "a long, n long, l long, r long")
    score = df.select(F.expr(collocations.SCORE)).first()[0]
    assert score == 1000 * 3 * 10**9 * 7 * 10**13 // (9 * 10**9 * 10**10)


def test_perfect_hash():
    rng = np.random.default_rng(10)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    first, second = keys // np.uint64(3), keys * np.uint64(7)
    table = PerfectHash(first, second)
    assert sorted(table.slots(first, second).tolist()) == list(range(len(keys)))
    assert (table.slots(first, second + np.uint64(1)) == -1).all() and (table.slots(second, first) == -1).all()
    order = rng.permutation(len(keys))
    assert (PerfectHash(first[order], second[order]).slots(first, second) == table.slots(first, second)).all()
    assert len(PerfectHash(first[:0], second[:0])) == 0 and (PerfectHash(first[:0], second[:0]).slots(first[:3], second[:3]) == -1).all()
