"""Operators on one large key: pairs of a fund, pages of a document; against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.config import Rules
from factloom.operators import bands, chunking, layout, rules

DOC = "fund int, doc_id long, doc_ord long, doc_name string, " + ", ".join(f"{m} struct<value:double,page:int,snippet:string>" for m in ("aum", "mgmt_fee", "target_irr"))


def fund_docs(spark, rows):
    """rows: (fund, aum, fee, target)"""
    return spark.createDataFrame([(f, k, k, f"d{k}", *((v, 1, "s") for v in vs)) for k, (f, *vs) in enumerate(rows)], DOC)


@pytest.mark.parametrize("size", [3, 4096])
def test_pairs_at_odds(spark, monkeypatch, size):
    monkeypatch.setattr(bands, "RANGE", size)
    monkeypatch.setattr(bands.apart, "__defaults__", (None, size))
    rng = random.Random(size)
    pick = lambda xs: rng.choice([None, *xs])
    rows = [(rng.choice([1, 1, 1, 2, None]), pick([-2e9, -1.9e9, 0.0, 1e9, 1.05e9, 1.1e9, 5e9, rng.random()]), pick([1.5, 1.6, 1.7, 2.0, 1.5 + 0.1, rng.random()]), pick([15.0, 18.0, 20.0, 17.5 + rng.random()])) for _ in range(60)]
    r = Rules()
    share = lambda a, b: 0.0 if abs(a) + abs(b) == 0 else abs(a - b) / ((abs(a) + abs(b)) / 2)
    tests = (lambda a, b: share(a, b) > r.aum_tolerance_pct, lambda a, b: abs(a - b) > r.mgmt_fee_abs_pct, lambda a, b: abs(a - b) > r.target_irr_abs_pct)
    want = sorted((k, i << 32 | j, a, b) for k, test in enumerate(tests) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and x[0] == y[0] is not None and (a := x[k + 1]) is not None and (b := y[k + 1]) is not None and test(a, b))
    docs = fund_docs(spark, rows)
    odd = rules.figures_at_odds(docs, r)
    got = [x for f in (rules.aum_mismatch, rules.fee_mismatch, rules.target_irr_drift) for x in f(docs, r, odd).collect()]
    assert sorted((x.rule_ord, x.flag_ord, x.a, x.b) for x in got) == want and len(want) > 50
    assert sorted((x.flag_ord, x.a) for x in rules.fee_mismatch(docs, r).collect()) == sorted(w[1:3] for w in want if w[0] == 1)
    # Only what fresh documents are part of, whether their values are new or not.
    some = docs.withColumn("fresh", F.col("doc_id") % 7 == 3)
    odd = rules.figures_at_odds(some, r)
    got = [x for f in (rules.aum_mismatch, rules.fee_mismatch, rules.target_irr_drift) for x in f(some, r, odd).collect()]
    assert sorted((x.rule_ord, x.flag_ord, x.a, x.b) for x in got) == [w for w in want if 3 in ((w[1] >> 32) % 7, (w[1] & (1 << 32) - 1) % 7)]


def test_pairs_are_counted_without_being_made(spark):
    """Against the flags themselves, with funds and figures that are null, and documents of one place in the order."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, None]), k, rng.choice([k, k, 5]), f"d{k}", *((rng.choice([None, a, b, a + rng.random()]), 1, "s") for a, b in ((1e9, 2e9), (1.5, 2.0), (15.0, 18.0))), (rng.choice([None, 12.0]), 1, "gross"), rng.choice([None, ("net", "s", 1, "x"), ("gross", "s", 1, "x")])) for k in range(60)]
    docs = spark.createDataFrame(rows, f"{DOC}, net_irr struct<value:double,page:int,snippet:string>, basis struct<basis:string,snippet:string,page:int,section:string>")
    mentions = spark.createDataFrame([(1, 0, 99.0, "net", 1, "s")], "doc_id long, mention_ord int, value double, basis string, page int, snippet string")
    found = spark.createDataFrame([], "doc_id long, field string, agreement double, by_extractor array<struct<extractor:string,value:double>>")
    want = {tuple(r) for r in rules.run_rules(docs, mentions, found).groupBy("fund", "severity", "type").count().collect()}
    counts = rules.flag_counts(docs, mentions, found)
    assert {tuple(r) for r in counts.collect()} == want and len({r[2] for r in want}) > 5


def test_one_fund_of_many_documents_and_few_flags(spark):
    """100,000 documents of one fund with as many fees: values meet by range, never all of them, and no join is by fund alone."""
    n, r = 100_000, Rules()
    fee = 1.5 + r.mgmt_fee_abs_pct * 1.0001 * F.col("id") / n  # only the first and the last dozen are at odds
    docs = spark.range(n).select(F.lit(1).alias("fund"), F.col("id").alias("doc_id"), F.col("id").alias("doc_ord"), F.concat(F.lit("d"), "id").alias("doc_name"), F.struct(fee.alias("value"), F.lit(1).alias("page"), F.lit("s").alias("snippet")).alias("mgmt_fee"))
    odd = rules.figures_at_odds(docs, r, ("mgmt_fee",))
    got = rules.fee_mismatch(docs, r, odd).collect()
    fees = [1.5 + r.mgmt_fee_abs_pct * 1.0001 * i / n for i in range(n)]
    want = {(i, j) for i in range(20) for j in range(n - 20, n) if abs(fees[i] - fees[j]) > r.mgmt_fee_abs_pct}
    assert {(x.flag_ord >> 32, x.flag_ord & (1 << 32) - 1) for x in got} == want and 30 < len(want) < 100
    plan = odd._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and all("part" in line for line in joins)


def fold(rows, most):
    """Chunks page by page, as the definition has it."""
    out, key, length, pages = [], object(), 0, 0
    for k, o, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k != key:
            key, chunk, length, pages = k, 0, 0, 0
        if pages and length + n > most:
            chunk, length, pages = chunk + 1, 0, 0
        length, pages = length + n, pages + 1
        out.append((k, o, chunk))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_chunks_over_ranges(spark, parts):
    """Keys that span ranges, pages without text, oversize pages, repeated page numbers, whatever the ranges."""
    rng = random.Random(parts)
    rows = [(k, o if rng.random() > 0.05 else o - 1, rng.choice([0, 0, 1, 30, 60, 99, 250])) for k in range(30) for o in range(rng.choice([1, 2, 5, 300]))]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, n long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = layout.chunked(df, 100, size=F.col("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == fold(rows, 100)
    assert layout.chunked(df.limit(0), 100, size=F.col("n")).count() == 0


def test_a_document_of_a_million_pages(spark):
    n, most = 1_000_000, 24_000
    size = F.pmod(F.xxhash64("id"), F.lit(5000))
    pages = spark.range(n).select(F.lit("big").alias("doc_id"), F.col("id").alias("page_num"), size.alias("n"))
    got = layout.chunked(pages, most, size=F.col("n")).join(pages, ["doc_id", "page_num"]).orderBy("page_num").select("chunk", "n").toArrow()
    chunk, length, pages_in = 0, 0, 0
    for c, x in zip(got["chunk"].to_pylist(), got["n"].to_pylist(), strict=True):
        if pages_in and length + x > most:
            chunk, length, pages_in = chunk + 1, 0, 0
        length, pages_in = length + x, pages_in + 1
        assert c == chunk
    assert chunk > 90_000 and got.num_rows == n


def test_summaries_of_runs_agree_with_walking_them():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 9, 20]) for _ in range(rng.randint(1, 30))]
        import numpy as np

        r = chunking.Run(np.array(sizes), np.array([0, len(sizes)]), 12)
        count, left = r.summary(0, len(sizes))
        for i in range(len(sizes)):
            opens = np.flatnonzero(r.openings(i))
            assert count[i] == len(opens) and left[i] == sum(sizes[opens[-1] :])


def test_texts_of_many_suppliers_are_made_in_many_tasks(spark, tmp_path):
    """A file of few bytes, which one task reads, holds documents for several."""
    from factloom.plans import reports_data

    n = 2 * reports_data.DOCUMENTS + 1
    spark.range(n).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = reports_data.pages(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*"), F.count_distinct("doc_id")).collect()
    assert len(rows) == 3 and sum(r[1] for r in rows) == 2 * n and sum(r[2] for r in rows) == n and max(r[2] for r in rows) < 2 * reports_data.DOCUMENTS
