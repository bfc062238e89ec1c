"""Fusion, rules, reports, answers and whole runs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from factloom import __main__ as cli
from factloom.config import Config, Trust, load
from factloom.operators import extract, fusion, layout, reports, responses, rules
from factloom.plans import pipeline, sinks

C = "doc_id long, field string, extractor string, extractor_ord int, value double, hurdle double, confidence double, page int, snippet string"
LPA = "Effective Date: 2026-01-15\nAssets Under Management (AUM): $1.20B\nNet IRR: 16.90%\nTVPI: 1.55x\nManagement Fee: 1.50%"
QUARTER = "As-of Date: 2026-03-31\nAssets Under Management (AUM): $1.20B\nNet IRR: 16.90%\nTVPI: 1.55x\nManagement Fee: 2.00%"


def cands(spark, *rows):
    return spark.createDataFrame([(1, "aum", e, o, v, None, c, 1, "s") for e, o, v, c in rows], C)


@pytest.mark.parametrize("a, b, expected", [(1.20e9, 1.21e9, 1.0), (1.20e9, 1.80e9, 0.6), (None, 1.0, 1.0), (0.0, 0.0, 1.0)])
def test_agreement(spark, a, b, expected):
    got = fusion.agreements(cands(spark, ("RegexExtractor", 1, a, 0.5), ("CohereExtractor", 0, b, 0.5))).first()
    assert got.agreement == pytest.approx(expected)


def test_best_candidate(spark):
    two = cands(spark, ("CohereExtractor", 0, 1.8e9, 0.60), ("RegexExtractor", 1, 1.2e9, 0.55))
    assert fusion.fused(two).first().extractor == "RegexExtractor"
    swapped = Trust(extractor_weights=(("RegexExtractor", 0.10), ("CohereExtractor", 0.99)))
    assert fusion.fused(two, swapped).first().extractor == "CohereExtractor"
    assert [x["value"] for x in fusion.disagreements(two).first().by_extractor] == [1.8e9, 1.2e9]
    null_wins = cands(spark, ("CohereExtractor", 0, None, 0.99), ("RegexExtractor", 1, 1.2e9, 0.55))
    assert fusion.fused(null_wins).first().value is None


def test_verification(spark):
    p = spark.createDataFrame([(1, 1, "The fund's Net IRR: 16.90% since 2020")], "doc_id long, page_num int, text string")
    docs = spark.createDataFrame([(1, "lpa.txt", "2026-01-15")], "doc_id long, doc_name string, doc_date string")
    rows = [("aum", "net irr:  16.90%", 1.0), ("tvpi", "net lrr: 16.90%", 0.75), ("carry", "quite other words", 0.40), ("mgmt_fee", "", 0.50)]
    m = spark.createDataFrame([(1, f, "RegexExtractor", 0, 1.0, None, 0.55, 1, s) for f, s, _ in rows], C).withColumn("agreement", F.lit(1.0))
    got = {r.field: r.confidence for r in fusion.verified(m, p, docs).collect()}
    assert got == {f: pytest.approx(0.7375 * x) for f, _, x in rows}


def analysis(spark, *texts, names=("lpa_agreement.txt", "quarterly_update.txt")):
    rows = [(k, k, names[k % len(names)], 0, 1, t) for k, t in enumerate(texts)]
    return pipeline.analyse(spark.createDataFrame(rows, "doc_id long, doc_ord long, doc_name string, fund int, page_num int, text string"))


def test_scenario(spark):
    got = analysis(spark, LPA, QUARTER)
    assert [(r.severity, r.type, r.detail) for r in got.flags.collect()] == [("RED", "MGMT_FEE_MISMATCH", "Management fee differs: 1.50% vs 2.00%")]
    s = got.scores.first()
    assert (round(s.risk_score, 6), s.decision, s.decision_confidence) == (0.393469, "INVESTIGATE", 0.74)
    conf = {(r.doc_id, r.field): r.confidence for r in got.metrics.collect()}
    assert conf[0, "aum"] == pytest.approx(0.7375) and conf[1, "aum"] == pytest.approx(0.68) and conf[0, "carry"] == 0
    q = {r.doc_name: r for r in reports.data_quality(got.metrics, got.docs).collect()}
    assert q["lpa_agreement.txt"].fields_found == 4 and q["lpa_agreement.txt"].missing_count == 3


def test_more_rules(spark):
    a = "Assets Under Management (AUM): $1.00B\nNet IRR: 12.0%\nTarget IRR: 18%\nWe target a 25% gross IRR.\nDefinitions\nfigures are gross of fees"
    b = "Assets Under Management (AUM): $2.00B\nNet IRR: 12.0%\nTarget IRR: 14%\nDefinitions\nfigures are net of fees"
    got = {(r.type, r.docs) for r in analysis(spark, a, b).flags.collect()}
    both, one, two = "lpa_agreement.txt vs quarterly_update.txt", "lpa_agreement.txt", "quarterly_update.txt"
    assert got == {("AUM_MISMATCH", both), ("TARGET_IRR_DRIFT", both), ("IRR_DEFINITION_DRIFT", both), ("IRR_DEFINITION_DRIFT_INTERNAL", one), ("UNDER_TARGET_PERFORMANCE", one), ("UNDER_TARGET_PERFORMANCE", two), ("IRR_MENTION_CONFLICT", one)}


def test_every_mention_conflicts_without_known_values(spark):
    got = analysis(spark, "a 20% gross IRR and again a 20% gross IRR")
    assert [r.a for r in got.flags.where("type = 'IRR_MENTION_CONFLICT'").collect()] == [20.0]


@pytest.mark.parametrize("red, yellow, risk, decision", [(0, 0, 0, "APPROVE"), (1, 0, 1 - math.exp(-0.5), "INVESTIGATE"), (0, 3, 1 - math.exp(-0.75), "INVESTIGATE"), (50, 0, 1 - math.exp(-25), "PASS")])
def test_risk(spark, red, yellow, risk, decision):
    flags = spark.createDataFrame([(0, "RED", "x")] * red + [(0, "YELLOW", "x")] * yellow, "fund int, severity string, type string")
    got = reports.recommendation(reports.risk_score(flags, spark.createDataFrame([(0,)], "fund int"), "fund")).first()
    assert got.risk_score == pytest.approx(risk) and got.decision == decision


def test_flag_difference(spark):
    a = spark.createDataFrame([("T", "RED"), ("T", "RED")], "type string, severity string")
    assert [tuple(r) for r in reports.flag_difference(a, a.limit(1)).collect()] == [("T", "RED", False)]
    assert reports.flag_difference(a, a).count() == 0


def test_many_flags_differ_by_their_counts(spark):
    """As many flags of one type as no array holds: they are counted, and rows of a difference come in blocks."""
    n = 200_000
    got = spark.range(n).select(F.when(F.col("id") < n - 3, "T").alias("type"), F.lit("RED").alias("severity"))
    few = spark.createDataFrame([("T", "RED")] * 2 + [(None, "RED")] * 4 + [("U", "RED")], "type string, severity string")
    rows = reports.flag_difference(got, few)
    assert {tuple(r) for r in rows.groupBy("type", "severity", "missing").count().collect()} == {("T", "RED", False, n - 5), (None, "RED", True, 1), ("U", "RED", True, 1)}
    counts = reports.flag_difference_counts(got, few)
    assert {tuple(r) for r in counts.collect()} == {("T", "RED", False, n - 5), (None, "RED", True, 1), ("U", "RED", True, 1)}
    assert all("replicaterows" not in df._jdf.queryExecution().executedPlan().toString() for df in (rows, counts))


def test_answers(spark):
    said = ["```json\n{'mgmt_fee': {'value': 0.02, 'confidence': .9,}, 'notes': ['n', {'text': 'm'}],}\n```".replace(".9", "0.9"), '{"mgmt_fee": {"value": 2.5, "confidence": 0.4}, "doc_date": "2025-01-01"}', "no json"]
    r = responses.parsed(spark.createDataFrame([(1, k, s) for k, s in enumerate(said)], "doc_id long, chunk int, response string"))
    m = responses.merged_chunks(responses.response_metrics(r))
    assert {x.field: x.value for x in m.collect()}["mgmt_fee"] == pytest.approx(2.0)
    assert [x.doc_date for x in responses.response_dates(r).orderBy("chunk").collect()] == [None, "2025-01-01", None]
    assert responses.merged_notes(responses.response_notes(r), r, "x").first().notes == ["n", "m", "Document processed in 3 chunks due to length (x)."]


def test_charts(spark):
    said = json.dumps({"charts": [{"title": "T", "series": [{"label": "a", "value": 1}, "odd"]}, "odd", {"summary": "S"}]})
    r = responses.parsed(spark.createDataFrame([(1, 1, said), (1, 2, '{"charts": 3}')], "doc_id long, page int, response string"))
    got = responses.charts(r).orderBy("chart_ord").collect()
    assert [(x.title, x.snippet, [tuple(s) for s in x.series]) for x in got] == [("T", "T", [("a", 1.0)]), (None, "S", [])]


def test_prompts_and_hint(spark):
    p = spark.createDataFrame([(1, 1, "x" * 5), (1, 2, "y")], "doc_id long, page_num int, text string")
    got = responses.prompts(p, layout.chunked(p, 100), "Head").first().prompt
    assert got == "Head\n\n--- PAGE 1 ---\nxxxxx\n\n--- PAGE 2 ---\ny"
    hint = json.loads(p.select(responses.schema_hint(F.lit("d"))).first()[0])
    assert hint["aum"] == {"value": None, "confidence": 0.0, "evidence": {"doc_name": "d", "page": None, "snippet": ""}} and "hurdle" in hint["carry"]


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in" / "input"
    src.mkdir(parents=True)
    (src / "lpa_agreement.txt").write_bytes(LPA.replace("\n", "\r\n").encode())
    (src / "quarterly_update.txt").write_text(QUARTER)
    (src / "ignored.md").write_text("x")
    (tmp_path / "in" / "expected_flags.json").write_text(json.dumps([{"type": "MGMT_FEE_MISMATCH", "severity": "RED"}]))
    out = str(tmp_path / "out")
    assert cli.main(["eval", "--input", str(tmp_path / "in")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["pass"]
    assert cli.main(["run", "--input", str(src), "--out", out]) == 0
    assert "MGMT_FEE_MISMATCH" in (tmp_path / "out" / "ic_memo.md").read_text()
    manifest = json.loads((tmp_path / "out" / "audit_manifest.json").read_text())
    assert len(manifest["inputs"]) == 2 and manifest["outputs"]
    assert cli.main(["flag", "--out", out]) == 0 and cli.main(["report", "--out", out]) == 0
    assert "INVESTIGATE" in capsys.readouterr().out


def test_sinks_keep_every_row(spark, tmp_path):
    got = pipeline.analyse(spark.createDataFrame([(k, k, n, 0, 1, t) for k, (n, t) in enumerate((("lpa.txt", LPA), ("quarterly.txt", QUARTER)))], "doc_id long, doc_ord int, doc_name string, fund int, page_num int, text string"), Config())
    many = spark.range(10_001).select(F.lit(1).alias("_one"))
    got.docs, got.flags = got.docs.limit(1).crossJoin(many).drop("_one"), got.flags.limit(1).crossJoin(many).drop("_one")
    manifest = sinks.write(got, str(tmp_path / "out"), Config())
    text = (tmp_path / "out" / "ic_memo.md").read_text()
    assert manifest["documents"] == 10_001 and "Documents analyzed: **10001**" in text
    assert text.count("\n### RED: ") == 10_001 and text.count("\n| lpa.txt | ") + text.count("\n| quarterly.txt | ") == 10_001


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("rules:\n  mgmt_fee_abs_pct: 0.5\ntrust:\n  extractor_weights:\n    RegexExtractor: 0.1\n")
    got = load(str(path))
    assert got.rules.mgmt_fee_abs_pct == 0.5 and got.trust.extractor_weights == (("RegexExtractor", 0.1),) and load() == Config()


def test_stream(spark, tmp_path):
    from factloom.streaming import incremental

    rows = [(k, k, n, 0, 1, t) for k, (n, t) in enumerate((("lpa.txt", LPA), ("quarterly.txt", QUARTER)))]
    spark.createDataFrame(rows, incremental.PAGES).write.parquet(str(tmp_path / "in"))
    q = incremental.start(incremental.pages_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert incremental.flags(spark, str(tmp_path / "out")).count() == 1


def test_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "risk_score" in e.queries()
    assert extract.CONFIDENCE == 0.55 and len(rules.REGISTRY) == 8


def test_models_chunks_fallback_redaction_and_cache(spark, tmp_path):
    """A fake client answers the first page's chunk, fails on the second and sees no e-mail address; answers are asked for once."""
    from factloom.operators import extractors

    asked = tmp_path / "asked"
    asked.mkdir()

    def client(prompt, folder=str(asked)):
        import os
        import uuid

        assert "@" not in prompt
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if "Net IRR" in prompt.split("Document:")[1]:
            return 'Here: {"aum": {"value": 2.5e9, "confidence": 0.9, "evidence": {"page": 1, "snippet": "AUM"}}, "mgmt_fee": {"value": 0.02, "confidence": 0.4}, "notes": ["read"],}'
        raise OSError("no answer")

    rows = [(1, 0, "a.txt", 0, 1, "Net IRR: 16.8% write to me@example.com " + "x" * 60), (1, 0, "a.txt", 0, 2, "Management Fee: 1.75% " + "y" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, doc_ord long, doc_name string, fund long, page_num int, text string")
    model = extractors.Model("OllamaExtractor", 1, "local", client, 120, attempts=2, backoff_s=0.0)
    for _ in range(2):
        got, notes = extractors.candidates(df, model, redact=True, cache=str(tmp_path / "answers"))
        by = {r.field: r for r in got.collect()}
    assert by["aum"].value == 2.5e9 and by["mgmt_fee"].value == 1.75 and by["mgmt_fee"].confidence == 0.55 and by["net_irr"].value is None
    said = notes.first().notes
    assert "read" in said and any("patterns were used" in n for n in said) and "2 chunks" in said[-1]
    assert len(list(asked.iterdir())) == 1 + 2 * 2  # the answer once; the failure twice a run
    a = pipeline.analyse(df, extra=got)
    assert {r.field: r.value for r in a.metrics.collect()}["aum"] == 2.5e9


def test_files_are_numbered_without_moving_contents(spark, tmp_path):
    from factloom.sources import files

    for k in range(30):
        (tmp_path / f"f{k:02}.txt").write_text(f"text {k}")
    found = files.discover(spark, str(tmp_path))
    assert [(r.doc_ord, r.doc_name, bytes(r.content).decode()) for r in found.orderBy("doc_ord").collect()] == [(k, f"f{k:02}.txt", f"text {k}") for k in range(30)]
    assert files.load(spark, str(tmp_path), strict=True).count() == 30
    (tmp_path / "odd.docx").write_text("x")
    with pytest.raises(ValueError, match="odd.docx"):
        files.load(spark, str(tmp_path), strict=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line for line in plan.split("\n") if "SinglePartition" in line)


def test_other_layout_of_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"model": {"provider": "cohere", "model": "m"}, "ollama": {"enabled": True, "host": "h"}, "vision": {"max_pages": 3, "prompt": "p.txt"}, "rules": {"aum_tolerance_pct": 0.1}, "run": {"use_cohere": True, "redact_before_llm": True, "enable_disk_cache": False, "prompts_dir": str(tmp_path)}}))
    got = load(str(path))
    assert got.hosted.model == "m" and got.hosted.enabled and got.local.enabled and got.local.host == "h" and got.vision.max_pages == 3
    assert got.redact and not got.cache and got.rules.aum_tolerance_pct == 0.1
    from factloom.operators import extractors

    for text, on in (("run:\n  use_cohere: true\n", (True, True)), ("ollama:\n  enabled: false\n", (True, False)), ("rules:\n  mgmt_fee_abs_pct: 0.5\n", (False, False)), ("run:\n", (True, True))):
        (tmp_path / "c.yaml").write_text(text)
        own = load(str(tmp_path / "c.yaml"))
        assert (own.hosted.enabled, own.local.enabled) == on and not own.vision.enabled
    (tmp_path / "p.txt").write_text("own prompt")
    assert extractors.prompt_text(got, got.prompts.charts, "x") == "own prompt" and extractors.prompt_text(Config(), "none.txt", "x") == "x"
    with pytest.raises(FileNotFoundError):
        extractors.prompt_text(got, "none.txt", "x")


def test_charts_of_page_images(spark, tmp_path):
    """Equal images are asked for once and kept; a failing page has no charts, and is asked twice a run."""
    from factloom.operators import extractors

    asked = tmp_path / "asked"
    asked.mkdir()

    def client(prompt, png, folder=str(asked)):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if png == b"bad":
            raise OSError("no answer")
        return json.dumps({"charts": [{"title": png.decode(), "series": [{"label": "a", "value": 1}]}]})

    images = spark.createDataFrame([(1, 1, b"one"), (1, 2, b"bad"), (2, 1, b"one")], "doc_id long, page_num int, png binary")
    model = extractors.ChartModel("m", client, backoff_s=0.0)
    for _ in range(2):
        got = extractors.charts(images, model, str(tmp_path / "kept")).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.title, r.confidence) for r in got] == [(1, 1, "one", 0.6), (2, 1, "one", 0.6)]
    assert len(list(asked.iterdir())) == 1 + 2 * 2


def test_sections_of_pdf_lines_and_tables(spark):
    """Documents named *.pdf take sections from their lines, others from their text; a table fills what no extractor found."""
    pages = spark.createDataFrame([(1, 0, "a.pdf", 0, 1, "FEES:\nnothing"), (2, 1, "b.txt", 0, 1, "FEES:\nnothing")], "doc_id long, doc_ord long, doc_name string, fund long, page_num int, text string")
    lines = spark.createDataFrame([(1, 1, 0, "Performance Summary", 20.0, True, 0.1), (1, 1, 1, "body text", 10.0, False, 0.2), (1, 1, 2, "more text", 10.0, False, 0.3)], "doc_id long, page_num int, line_no int, text string, size double, bold boolean, y_frac double")
    rows = [[{"header": "", "value": "Net IRR"}, {"header": "2024", "value": "14.2%"}]]
    found = spark.createDataFrame([(1, 0, "t0", 1, rows, [])], "doc_id long, table_ord int, table_id string, page int, rows array<array<struct<header:string,value:string>>>, footnotes array<string>")
    got = pipeline.analyse(pages, doc_tables=found, lines=lines)
    assert {(r.doc_id, r.value) for r in got.metrics.where("field = 'net_irr'").collect()} == {(1, 14.2), (2, None)}
    assert {r.doc_id: r.section_types for r in got.docs.collect()} == {1: ["performance_summary"], 2: ["fees_and_expenses"]}


def test_exports_log_and_memo_by_model(spark, tmp_path):
    rows = [(k, k, n, 0, 1, t) for k, (n, t) in enumerate((("lpa.txt", LPA), ("quarterly.txt", QUARTER)))]
    got = pipeline.analyse(spark.createDataFrame(rows, "doc_id long, doc_ord int, doc_name string, fund int, page_num int, text string"), Config())
    log, seen = sinks.RunLog(), []

    def client(prompt):
        seen.append(prompt)
        return "# Memo of a model"

    made = sinks.write(got, str(tmp_path / "out"), Config(), timings={"extract_s": 1.0}, memo_client=client)
    sinks.LOG.info("done")
    log.save(spark, str(tmp_path / "out"))
    assert (tmp_path / "out/ic_memo.md").read_text() == "# Memo of a model" and made["recommendation"] in seen[0]
    assert [d["doc_name"] for d in json.loads((tmp_path / "out/extracted.json").read_text())] == ["lpa.txt", "quarterly.txt"]
    assert [f["type"] for f in json.loads((tmp_path / "out/flags.json").read_text())] == ["MGMT_FEE_MISMATCH"]
    assert (tmp_path / "out/run.log").read_text().endswith("| INFO | done\n") and set(made["timings_s"]) == {"extract_s", "write_s"}
    assert "git_commit" in made and made["risk_score"] > 0

    def broken(prompt):
        raise OSError("away")

    docs, flags, decision = got.docs, got.flags, got.scores.first()
    assert sinks.model_memo(docs, flags, decision, broken, 10**6) is None and sinks.model_memo(docs, flags, decision, client, 10) is None and len(seen) == 1
    assert json.loads("".join(sinks.json_lines(docs.limit(0)))) == []
