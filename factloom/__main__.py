"""Command line: run, extract, flag, report, eval."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from . import config as cfg
from .operators import extractors, reports, rules
from .plans import artifacts, pipeline, sinks
from .session import session, staged
from .sources import files, plugins


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("factloom")
    p.add_argument("command", choices=("run", "extract", "flag", "report", "eval"))
    p.add_argument("--input", help="folder of documents, of one engagement (eval: the scenario's folder)")
    p.add_argument("--out", help="folder of a run's tables")
    p.add_argument("--config")
    p.add_argument("--master")
    a = p.parse_args(argv)
    config = cfg.load(a.config)
    spark = session(a.master)
    if a.command in ("run", "extract", "eval"):
        log, start = sinks.RunLog(), time.time()
        folder = f"{a.input}/input" if a.command == "eval" else a.input
        found = files.discover(spark, folder)
        lines, doc_tables = files.pdf_layout(found)
        pages = files.load(spark, folder, config.ocr).withColumn("fund", F.lit(0))
        # The command evaluates the defaults, patterns alone; answers are kept beside the run, so a second run asks for new prompts only.
        models = [] if a.command == "eval" else extractors.build(config)
        cache = f"{a.out}/answers" if config.cache else None
        extra, details = extractors.all_candidates(pages, models, config.redact, cache)
        asked = time.time()
        known = pipeline.extracted(pages, config, extra, doc_tables, a.command != "extract", lines, details, f"{a.out}/kept" if config.cache and a.command != "eval" else None)
        seer = None if a.command == "eval" else extractors.build_charts(config)
        if config.vision.enabled and config.redact and a.command != "eval":
            note = F.when(F.lower("doc_name").endswith(".pdf"), F.array(F.lit(extractors.NO_CHARTS)))
            known.docs = known.docs.withColumn("notes", F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.coalesce(note, F.array().cast("array<string>"))))
        extracted = time.time()
        got = pipeline.compared(known, config)
        if seer is not None and plugins.available("pdf"):
            images = plugins.rendered_pages(found.where(F.lower("doc_name").endswith(".pdf")), None, config.vision.dpi, config.vision.max_pages)
            got.charts = extractors.charts(images, seer, cache and f"{cache}/charts")
        if a.command == "eval":
            expected = spark.read.option("multiLine", True).schema("type string, severity string").json(f"{a.input}/expected_flags.json")
            diff = [r.asDict() for r in reports.flag_difference(got.flags, expected).collect()]
            print(json.dumps({"pass": not diff, "difference": diff}))
            return 0
        status = plugins.status(config.hosted.enabled, config.local.host, config.local.model)
        for name, state in status.items():
            sinks.LOG.info("extractor %s: %s", name, state)
        compared = time.time()
        timings = {"models_s": asked - start, "extract_s": extracted - asked, "rules_plan_s": compared - extracted, "total_s": compared - start}
        writer = next((m.client for m in models if m.label == "hosted"), None)
        made = sinks.write(got, a.out, config, found.select("path", "content"), {k: round(v, 3) for k, v in timings.items()}, status, writer)
        sinks.LOG.info("run complete: %s", json.dumps({k: made.get(k) for k in ("documents", "flags_by_severity", "risk_score", "recommendation", "timings_s")}))
        log.save(spark, a.out)
        print(json.dumps([r.asDict() for r in got.scores.limit(20).collect()]))
        return 0
    known = artifacts.read_documents(spark, f"{a.out}/extracted.json")
    if a.command == "flag":
        flags = staged(rules.run_rules(known.docs, known.mentions, known.disagreements, config.rules), "flags")
        flags.write.mode("overwrite").parquet(f"{a.out}/flags")
        sinks.put_json(spark, f"{a.out}/flags.json", artifacts.flags(flags.orderBy("fund", "rule_ord", "flag_ord")))
        print(json.dumps([r.asDict() for r in reports.risk_score(flags, known.docs, "fund").limit(20).collect()]))
        return 0
    flags = artifacts.read_flags(spark, f"{a.out}/flags.json").withColumn("fund", F.lit(0))
    scores = reports.recommendation(reports.risk_score(flags, known.docs, "fund"))
    totals = reports.completeness(known.metrics).first()
    for line in sinks.memo(known.docs.orderBy("doc_ord"), flags.orderBy("flag_ord"), totals, scores.first()):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
