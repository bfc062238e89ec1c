"""What spans runs: the content store, readings, artifacts, first extractors, streams."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import __main__ as cli
from factloom.operators import extract, extractors
from factloom.plans import artifacts, pipeline, readings
from factloom.sources.store import Store, content_key

PAGES = "doc_id long, doc_ord long, doc_name string, fund long, page_num int, text string"
LPA = "Effective Date: 2026-01-15\nAssets Under Management (AUM): $1.20B\nNet IRR: 16.90%\nTVPI: 1.55x\nManagement Fee: 1.50%\nwe target a 25% gross IRR"
QUARTER = "As-of Date: 2026-03-31\nAssets Under Management (AUM): $1.20B\nNet IRR: 16.90%\nTVPI: 1.55x\nManagement Fee: 2.00%"


def table(spark, *texts):
    return spark.createDataFrame([(k, k, n, 0, 1, t) for k, (n, t) in enumerate(texts)], PAGES)


def test_content_keys_tell_parts_apart(spark):
    rows = [("a", None), (None, "a"), ("", "a"), ("a", ""), ("a\u001f", ""), ("a", "\u001f"), ("=a", "-"), ("a\\u", "b"), ("a\u001fb", None), (None, None), ("a", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(content_key(F.col("x"), F.col("y"))).collect()]
    assert len(set(got)) == len(rows) - 1 and got[0] == got[-1] and all(len(g) == 24 for g in got)


def test_store_keeps_replaces_and_repairs(spark, tmp_path):
    folder, asked = str(tmp_path / "kept"), []
    store = Store(spark, folder, "key string, v long", slots=4)

    def compute(new):
        asked.append(sorted(r.key for r in new.collect()))
        return new.where("key <> 'none'").select("key", F.length("key").cast("long").alias("v"))

    keys = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "key string, x int")
    one = store.get(keys("a", "bb", "bb", "none"), compute).collect()
    assert sorted(one) == [("a", 1, True), ("bb", 2, True)] and asked == [["a", "bb", "none"]]
    two = store.get(keys("a", "bb", "ccc", "none"), compute).collect()
    assert sorted(two) == [("a", 1, False), ("bb", 2, False), ("ccc", 3, True)] and asked[1] == ["ccc", "none"]
    store.put(spark.createDataFrame([("a", 9), ("a", 9)], "key string, v long"))  # as a run that puts a key again
    assert sorted((r.key, r.v) for r in store.kept().collect()) == [("a", 9), ("bb", 2), ("ccc", 3)]
    broken = next(p for p in (tmp_path / "kept").rglob("*.parquet"))
    lost = {r.key for r in spark.read.parquet(str(broken)).collect()}
    broken.write_bytes(b"PAR1 no table PAR1")
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    three = store.get(keys("a", "bb", "ccc"), compute).collect()
    assert {r.key for r in three if r.computed} == lost and len(three) == 3 and asked[2] == sorted(lost)
    assert len(store.get(keys("a", "bb", "ccc"), compute).where("computed").collect()) == 0 and store.kept().count() == 3


def test_readings_follow_content_not_names(spark, tmp_path):
    store = str(tmp_path / "kept")
    first = table(spark, ("lpa.txt", LPA), ("quarterly.txt", QUARTER))
    a = pipeline.analyse(first, store=store)
    plain = pipeline.analyse(first)
    # The second is renamed and has a copy, the first is changed, a third is new.
    later = table(spark, ("renamed.txt", QUARTER), ("copy.txt", QUARTER), ("lpa.txt", LPA + "\nmore"), ("empty.txt", None))
    found, _ = readings.readings(later, store=store)
    assert {r.doc_id: r.computed for r in found.collect()} == {0: False, 1: False, 2: True, 3: True}
    again, _ = readings.readings(later, store=store)
    assert again.where("computed").count() == 0
    key = lambda x: sorted(map(str, x.select(*sorted(x.columns)).collect()))
    for name in ("docs", "metrics", "candidates", "mentions", "disagreements", "flags", "scores"):
        assert key(getattr(a, name)) == key(getattr(plain, name)), name
    assert key(pipeline.analyse(first, store=store).metrics) == key(plain.metrics)


def test_first_extractor_gives_date_notes_and_missing_fields(spark):
    """Two models: figures come from the best, all else from the first, though the second found more."""
    answers = {"one": {"aum": {"value": 2.0e9, "confidence": 0.1}, "doc_date": "2020-02-02", "notes": ["of one"], "missing_fields": ["tvpi.value", 7]}, "two": {"aum": {"value": 3.0e9, "confidence": 0.9}, "tvpi": {"value": 1.5, "confidence": 0.9}, "doc_date": "2021-01-01", "notes": ["of two"]}}
    pages = table(spark, ("lpa.txt", LPA), ("odd.txt", "no figure here"))
    models = [extractors.Model(n, k, n, lambda p, n=n: json.dumps(answers[n]) if "Net IRR:" in p or n == "two" else "none", 10_000, 1, 0.0) for k, n in enumerate(answers)]
    extra, details = extractors.all_candidates(pages, models)
    a = pipeline.analyse(pages, extra=extra, details=details)
    docs = {r.doc_name: r for r in a.docs.collect()}
    lpa, odd = docs["lpa.txt"], docs["odd.txt"]
    assert lpa.doc_date == "2020-02-02" and lpa.notes[0] == "of one" and lpa.missing_fields == ["tvpi.value", "7"] and lpa.tvpi.value == 1.55
    assert odd.doc_date is None and odd.notes[0].endswith("patterns were used.") and "aum.value" in odd.missing_fields and odd.aum.value == 3.0e9
    assert {r.doc_name: r.doc_date for r in pipeline.analyse(pages).docs.collect()} == {"lpa.txt": "2026-01-15", "odd.txt": None}


def test_chunks_of_an_answer_keep_the_first_date_and_all_notes(spark):
    pages = spark.createDataFrame([(1, 1, "a.txt", 0, k, t * 50) for k, t in enumerate(("first ", "second ", "third "), 1)], PAGES)

    def client(prompt):
        if "second" in prompt:
            return json.dumps({"doc_date": {"value": "2022-01-01"}, "carry": {"value": 0.2, "hurdle": 8, "confidence": 0.5}, "notes": ["b", "a"]})
        return json.dumps({"notes": ["a"], "doc_date": "2023-01-01" if "third" in prompt else None})

    got = extractors.candidates(pages, extractors.Model("m", 0, "hosted", client, 360, 1, 0.0))[1].first()
    assert got.doc_date == "2022-01-01" and got.notes[:2] == ["a", "b"] and got.notes[2].startswith("carry.value: model returned 0.2 ") and got.notes[3:] == ["Document processed in 3 chunks due to length (hosted)."]
    assert got.missing_fields == ["aum.value", "net_irr.value", "tvpi.value", "target_irr.value", "mgmt_fee.value"]


def test_artifacts_are_read_back(spark, tmp_path):
    a = pipeline.analyse(table(spark, ("lpa.txt", LPA), ("quarterly.txt", QUARTER), ("empty.txt", "")))
    rows = [json.loads(r[0]) for r in artifacts.documents(a).orderBy("doc_ord").drop("doc_ord").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    assert rows[0]["irr_mentions"][-1]["basis"] == "gross" and rows[0]["aum"]["evidence"]["doc_name"] == "lpa.txt" and rows[0]["extraction_candidates"]["aum"][0]["winner"]
    pretty, lined = tmp_path / "pretty.json", tmp_path / "lined.json"
    pretty.write_text(json.dumps(rows, indent=2))
    lined.write_text("[\n" + ",\n".join(map(json.dumps, rows)) + "\n]")
    want = sorted(map(str, a.flags.select("severity", "type", "docs", "detail", "evidence").collect()))
    for path in (pretty, lined):
        back = artifacts.read_documents(spark, str(path))
        assert [r.doc_name for r in back.docs.orderBy("doc_ord").collect()] == ["lpa.txt", "quarterly.txt", "empty.txt"]
        again = pipeline.compared(back)
        assert sorted(map(str, again.flags.select("severity", "type", "docs", "detail", "evidence").collect())) == want and len(want) >= 2
        assert again.scores.first().decision == a.scores.first().decision
        assert [json.loads(r[0]) for r in artifacts.documents(back).orderBy("doc_ord").drop("doc_ord").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()] == rows
    few = tmp_path / "few.json"  # fields that are unknown or missing
    few.write_text(json.dumps([{"doc_name": "x", "aum": {"value": 1}, "later": 3}], indent=1))
    one = artifacts.read_documents(spark, str(few))
    assert one.docs.first().aum.value == 1.0 and one.docs.first().notes == [] and one.mentions.count() == 0
    (tmp_path / "none.json").write_text("[]")
    assert artifacts.read_documents(spark, str(tmp_path / "none.json")).docs.count() == 0
    for text in ('[\n{"doc_name": "x"},\n{"doc_name": \n]', '[{"doc_name": {"a": 1}, \n "aum": 3}]'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="bad.json"):
            artifacts.read_documents(spark, str(tmp_path / "bad.json"))
    assert artifacts.read_flags(spark, str(tmp_path / "missing.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.read_documents(spark, str(tmp_path / "missing.json"))


def test_records_of_a_folder_keep_the_order_of_its_files(spark, tmp_path):
    """The largest file, which Spark deals out first, is the last but one; files are cut into blocks, and the eleventh part follows the tenth."""
    sizes, n = [3, 1, 5, 2, 4, 1, 1, 1, 1, 400, 2], 0
    for k, size in enumerate(sizes):
        rows = [json.dumps({"doc_name": f"d{n + i}", "notes": ["x" * 50]}) for i in range(size)]
        (tmp_path / f"part-{k}.json").write_text("\n".join(rows) + "\n")
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        got = artifacts.read(spark, str(tmp_path), artifacts.DOCUMENT).orderBy("doc_ord").select("doc_ord", "doc_name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(k, f"d{k}") for k in range(n)]


def test_flag_and_report_read_the_artifacts(spark, tmp_path, capsys):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "lpa_agreement.txt").write_text(LPA)
    (src / "quarterly_update.txt").write_text(QUARTER)
    with pytest.raises(FileNotFoundError):
        cli.main(["flag", "--out", str(out)])
    assert cli.main(["extract", "--input", str(src), "--out", str(out)]) == 0
    (out / "flags.json").unlink()
    assert cli.main(["report", "--out", str(out)]) == 0
    assert "No flags detected." in capsys.readouterr().out
    assert cli.main(["flag", "--out", str(out)]) == 0
    assert [f["type"] for f in json.loads((out / "flags.json").read_text())] == ["MGMT_FEE_MISMATCH", "IRR_MENTION_CONFLICT"]
    assert cli.main(["report", "--out", str(out)]) == 0
    said = capsys.readouterr().out
    assert "MGMT_FEE_MISMATCH" in said and "| lpa_agreement.txt | 2026-01-15 |" in said
    assert extract.CONFIDENCE == 0.55


def test_documents_as_a_data_source(spark, tmp_path):
    """Batches and streams give the rows of files.load(); a file is taken once by a stream, whatever runs between."""
    from factloom.sources import datasource, files

    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"b.txt": b"one\r\ntwo\rthree", "a.txt": b"bad \xff byte", "empty.txt": b"", "d e.txt": "é".encode() * 10, ".hidden.txt": b"x", "_part.txt": b"x", "note.md": b"x"}
    for name, raw in texts.items():
        (folder / name).write_bytes(raw)
    spark.dataSource.register(datasource.Documents)
    rows = lambda df: sorted(tuple(r[c] for c in ("doc_id", "doc_ord", "doc_name", "page_num", "text")) for r in df.collect())
    want = rows(files.load(spark, str(folder)))
    assert len(want) == 4
    for path in (str(folder), f"file://{folder}"):
        got = spark.read.format("documents").option("partitionBytes", "15").load(path)
        assert rows(got) == want and got.rdd.getNumPartitions() > 1
    latin = spark.read.format("documents").option("encoding", "latin-1").load(str(folder)).where("doc_name = 'a.txt'").first()
    assert latin.text == "bad ÿ byte"
    with pytest.raises(Exception, match="note.md"):
        spark.read.format("documents").option("strict", "true").load(str(folder)).collect()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def drain():
        spark.readStream.format("documents").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        return rows(spark.read.parquet(out))

    assert drain() == want and drain() == want
    (folder / "late.txt").write_text("later")
    got = drain()
    assert [r for r in got if r[2] != "late.txt"] == want and [r[1:] for r in got if r[2] == "late.txt"] == [(4, "late.txt", 1, "later")]
    (tmp_path / "none").mkdir()
    assert spark.read.format("documents").load(str(tmp_path / "none")).count() == 0


def test_batches_equal_one_run_over_what_stands(spark, tmp_path):
    """Documents that come, come again changed, and come again as they were; a batch that runs twice; against one run over all."""
    import random

    from factloom.streaming import incremental

    rng = random.Random(6)

    def text():
        basis = rng.choice(["", "All figures are net of fees.", "All figures are gross of fees."])
        return f"Assets Under Management (AUM): ${rng.choice([1, 2])}.{rng.randint(10, 12)}B\nNet IRR: {rng.choice([12, 16])}.5%\nTarget IRR: {rng.choice([14, 18])}%\nManagement Fee: {rng.choice(['1.50', '1.60', '2.00'])}%\nDefinitions\n{basis}\n" + rng.choice(["", "targeting a 25% gross IRR"])

    doc = lambda k: (k, k, f"d{k}.txt", k % 2, 1, text())
    batches = [[doc(k) for k in range(8)], [doc(k) for k in (8, 9, 2, 5)], [doc(10)], [doc(2), doc(0)], [doc(11)]]
    batches[2].append(batches[0][3])
    out, stands = str(tmp_path / "out"), {}
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, PAGES)
        for _ in range(2 if number == 1 else 1):
            incremental.step(df, number, out)
        stands |= {r[0]: r for r in rows}
    whole = pipeline.analyse(spark.createDataFrame([stands[k] for k in sorted(stands)], PAGES))
    key = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
    cols = ("fund", "rule_ord", "flag_ord", "severity", "type", "docs", "detail", "evidence", "a", "b", "doc_a", "doc_b")
    assert key(incremental.flags(spark, out), *cols) == key(whole.flags, *cols) and whole.flags.count() > 20
    assert key(incremental.scores(spark, out), "fund", "risk_score", "decision") == key(whole.scores, "fund", "risk_score", "decision")
    assert key(incremental.current(spark, out, "metrics"), "doc_id", "field", "value") == key(whole.metrics, "doc_id", "field", "value")
    last = spark.read.parquet(f"{out}/flags/batch=4")
    assert {11} <= {x for r in last.collect() for x in (r.doc_a, r.doc_b)} and all(11 in (r.doc_a, r.doc_b) for r in last.collect())


def test_a_stream_writes_no_pairs_of_documents(spark, tmp_path):
    """200 documents of one fund with two fees are 10,000 flags, and what a batch leaves of them is one pair of figures."""
    from factloom.streaming import incremental

    out = str(tmp_path)
    for number in (0, 1):
        texts = [(k, k, f"d{k}.txt", 0, 1, f"Management Fee: {'1.00' if k % 2 else '2.00'}%") for k in range(100 * number, 100 * number + 100)]
        incremental.step(spark.createDataFrame(texts, PAGES), number, out)
    assert spark.read.parquet(f"{out}/flags").count() == 0 and spark.read.parquet(f"{out}/odd").count() == 2
    assert incremental.flags(spark, out).groupBy("type", "a").count().orderBy("a").collect() == [("MGMT_FEE_MISMATCH", 1.0, 4950), ("MGMT_FEE_MISMATCH", 2.0, 5050)]
