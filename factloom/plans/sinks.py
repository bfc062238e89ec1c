"""What a run leaves: Parquet tables, one CSV, the memo, a manifest and a summary."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
import os
import platform
import subprocess
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import METRICS, Config
from ..operators import reports
from . import artifacts
from .pipeline import Analysis

LOG = logging.getLogger("factloom")
#: Rows of a part file, so that a file can be read, and hashed, as one value of under 2 GB.
PART_ROWS = 1_000_000


def _put(spark: SparkSession, path: str, text: str | Iterable[str]) -> None:
    """A text file, of one text or of lines as they come, through the session's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    held, size, sep = [], 0, ""
    for line in [text] if isinstance(text, str) else text:
        held.append(sep + line)
        size, sep = size + len(line), "\n"
        if size > 1 << 20:
            out.write(bytearray("".join(held).encode()))
            held, size = [], 0
    out.write(bytearray("".join(held).encode()))
    out.close()


def _figure(x, form: str, end: str = "") -> str:
    return "N/A" if x is None else f"{x:{form}}{end}"


def _money(x) -> str:
    if x is None:
        return "N/A"
    for size, end in ((1e9, "B"), (1e6, "M")):
        if abs(x) >= size:
            return f"${x / size:.2f}{end}"
    return f"${x:,.0f}"


# The memo's wording and the labels of its fields.
MEMO_HEAD = """# IC Diligence Summary

## Executive Summary
- Generated from extracted fields only.
- Documents analyzed: **{documents}**
- Flags detected: **{red} RED**, **{yellow} YELLOW**
- Data completeness: **{present}/{total}** core fields extracted (avg confidence **{average}**)
- Recommendation: **{decision}** (confidence {confidence:.2f})

## Key Metrics by Source
| Source | As-of | AUM | Net IRR | TVPI | Target IRR | Mgmt Fee | Carry |
|---|---:|---:|---:|---:|---:|---:|---:|"""
MEMO_EVIDENCE = (("AUM", "aum", True), ("Mgmt Fee", "mgmt_fee", True), ("Net IRR", "net_irr", False))
MEMO_FLAG = (("Docs", "docs"), ("Detail", "detail"), ("Evidence", "evidence"), ("Why it Matters", "why_it_matters"), ("Question to Ask", "question_to_ask"))
NO_FLAGS = "No flags detected."


def memo(docs: DataFrame, flags: DataFrame, totals, decision) -> Iterator[str]:
    """Lines of the summary in Markdown, of one fund's documents and flags in order; rows stream through the driver."""
    counts = {r["severity"]: r["n_flags"] for r in reports.severity_counts(flags).collect()}
    count = lambda s: counts.get(s, 0)
    average = "N/A" if totals["avg_confidence"] is None else f"{totals['avg_confidence']:.0%}"
    yield from MEMO_HEAD.format(documents=docs.count(), red=count("RED"), yellow=count("YELLOW"), present=totals["present"], total=totals["total"], average=average, decision=decision["decision"], confidence=decision["decision_confidence"]).split("\n")
    for d in docs.toLocalIterator():
        v = {m: d[m]["value"] if d[m] else None for m in METRICS}
        hurdle = d["carry"]["hurdle"] if d["carry"] else None
        carry = _figure(v["carry"], ".0f", "%") + (f" over {hurdle:.0f}%" if v["carry"] is not None and hurdle is not None else "")
        cells = [d["doc_name"], d["doc_date"] or "N/A", _money(v["aum"]), _figure(v["net_irr"], ".1f", "%"), _figure(v["tvpi"], ".2f", "x"), _figure(v["target_irr"], ".1f", "%"), _figure(v["mgmt_fee"], ".2f", "%"), carry]
        yield "| " + " | ".join(cells) + " |"
    yield from ("", "## Evidence")
    for d in docs.toLocalIterator():
        yield f"### {d['doc_name']}"
        for label, m, always in MEMO_EVIDENCE:
            if always or d[m]["value"] is not None:
                yield f'- {label}: p.{d[m]["page"]} — "{d[m]["snippet"]}"'
        yield ""
    yield "## Flags Queue"
    for f in flags.toLocalIterator():
        yield from [f"### {f['severity']}: {f['type']}", *(f"- {label}: {f[k]}" for label, k in MEMO_FLAG), ""]
    if not counts:
        yield NO_FLAGS


MEMO_PROMPT = """Write an investment committee memo in Markdown from the rows below, and from nothing else.
State missing figures as missing. The decision is fixed: {decision} (confidence {confidence:.2f}); repeat it as it stands.
Give the three gravest risks, each from a flag below, then the contradictions between documents, then the decision with its evidence.
Documents:
{docs}
Flags:
{flags}
"""


def json_lines(df: DataFrame) -> Iterator[str]:
    """The rows as lines of one JSON array, as they stream through the driver."""
    rows, sep = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(), ""
    yield "["
    held = None
    for r in rows:
        if held is not None:
            yield held + ","
        held = r["j"]
    if held is not None:
        yield held
    yield "]"


def put_json(spark: SparkSession, path: str, df: DataFrame) -> None:
    """The rows as one JSON array with a record a line."""
    _put(spark, path, json_lines(df))


def model_memo(docs: DataFrame, flags: DataFrame, decision, client: Callable[[str], str], most: int) -> str | None:
    """The memo as a model writes it; None, for the template, if the rows exceed ``most`` characters or the model fails."""
    parts, left = [], most
    for df in (docs, flags):
        held = []
        for line in json_lines(df):
            held.append(line)
            left -= len(line) + 1
            if left < 0:
                return None
        parts.append("\n".join(held))
    try:
        return client(MEMO_PROMPT.format(decision=decision["decision"], confidence=decision["decision_confidence"], docs=parts[0], flags=parts[1]))
    except Exception as e:  # noqa: BLE001 - whatever the client raises, the template is there
        LOG.warning("memo by model failed, template used: %s", e)
        return None


def git_commit() -> str | None:
    """The commit of the code that runs, if it runs from a checkout."""
    try:
        got = subprocess.run(["git", "rev-parse", "HEAD"], cwd=os.path.dirname(os.path.abspath(__file__)), capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.SubprocessError):
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


class RunLog(logging.Handler):
    """Keeps a run's log lines, to be put beside its tables in whatever store they are; one run's, as handlers are replaced."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []
        self.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        LOG.setLevel(logging.INFO)
        LOG.handlers = [self, logging.StreamHandler()]

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))

    def save(self, spark: SparkSession, folder: str) -> None:
        _put(spark, f"{folder}/run.log", "".join(x + "\n" for x in self.lines))


def _hashed(files: DataFrame) -> DataFrame:
    """(path, sha256) of files; null where one is too long to be one value, as a JSON file of very many flags may be."""
    small = F.col("length") < (1 << 31) - 1
    long = files.where(~small).select("path", F.lit(None).cast("string").alias("sha256"))
    return files.where(small).select("path", F.sha2("content", 256).alias("sha256")).unionByName(long)


def write(a: Analysis, folder: str, config: Config, inputs: DataFrame | None = None, timings: dict | None = None, extractors: dict | None = None, memo_client: Callable[[str], str] | None = None) -> dict:
    """Writes a run's tables, and for one engagement the memo, whose rows stream through the driver.

    memo_client: a model that writes the memo instead, from rows of at most config.hosted.max_chars characters."""
    spark, began = a.docs.sparkSession, time.time()
    for name, df in (("extracted", a.docs), ("metrics", a.metrics), ("candidates", a.candidates), ("mentions", a.mentions), ("flags", a.flags), ("scores", a.scores)):
        df.write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).parquet(f"{folder}/{name}")
    reports.facts_table(a.docs).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/facts_table")
    scores = a.scores.limit(2).collect()
    docs, flags = (spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in (("extracted", a.docs), ("flags", a.flags)))
    if len(scores) == 1:
        in_order = docs.orderBy("fund", "doc_ord"), flags.orderBy("fund", "rule_ord", "flag_ord")
        said = memo_client and model_memo(*in_order, scores[0], memo_client, config.hosted.max_chars)
        _put(spark, f"{folder}/ic_memo.md", said or memo(*in_order, reports.completeness(a.metrics).first(), scores[0]))
        _put(spark, f"{folder}/extracted.json", json_lines(artifacts.documents(a).orderBy("doc_ord").drop("doc_ord")))
        _put(spark, f"{folder}/flags.json", json_lines(artifacts.flags(in_order[1])))
    if a.charts is not None:
        a.charts.write.mode("overwrite").parquet(f"{folder}/charts")
    counts = {r["severity"]: r["n_flags"] for r in reports.severity_counts(flags).collect()}
    _put(spark, f"{folder}/config.json", json.dumps(dataclasses.asdict(config), indent=2))
    files = [r.asDict() for r in reports.input_manifest(inputs).collect()] if inputs is not None else []
    _put(spark, f"{folder}/inputs.json", json.dumps(files, indent=2))
    summary = {"documents": docs.count(), "flags_by_severity": counts, "timings_s": (timings or {}) | {"write_s": round(time.time() - began, 3)}, "extractors": extractors or {}}
    if len(scores) == 1:
        summary |= {"risk_score": scores[0]["risk_score"], "recommendation": scores[0]["decision"], "recommendation_confidence": scores[0]["decision_confidence"]}
    _put(spark, f"{folder}/run_summary.json", json.dumps(summary, indent=2))
    made = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,csv,md,json}").load(folder)
    manifest = {
        "run_id": str(uuid.uuid4()), "git_commit": git_commit(), "models": {"hosted": config.hosted.model, "local": config.local.model, "local_host": config.local.host, "vision": config.vision.model}, "generated_at_utc": datetime.now(UTC).isoformat(), "python_version": platform.python_version(), "spark_version": spark.version, "platform": platform.platform(),
        "operator": os.environ.get("USER", "unknown"), "config_sha256": hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest(),
        "inputs": files, "outputs": [r.asDict() for r in _hashed(made).collect()], **summary,
    }
    _put(spark, f"{folder}/audit_manifest.json", json.dumps(manifest, indent=2))
    return manifest
