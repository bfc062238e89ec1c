"""Extractors beside the patterns: language models that are asked page chunk by page chunk.

An extractor is a name, its place in the order and a client, a function from prompt to
answer; tests and callers hand in their own. What it gives are candidates like those of
the patterns, for fusion. Clients that are not there are left out by build().
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..session import staged
from ..sources import plugins
from ..sources.store import Store, content_key
from . import extract, layout, responses

PROMPT = "Extract the fund's figures from the pages below. Answer with one JSON object of this form, with null for what is not stated, percent figures as percent numbers and AUM in dollars:\n{form}\nDocument: {name}"
COLUMNS = ("doc_id", "field", "value", "hurdle", "confidence", "page", "snippet", "extractor", "extractor_ord")


CHART_PROMPT = 'Find every bar, line, pie, donut, area or scatter chart in this page image; tables of text are no charts. Answer with one JSON object {"charts": [{"chart_type": "", "title": null, "x_label": null, "y_label": null, "series": [{"label": "", "value": null}], "summary": ""}]}, with null for what can not be read, and an empty list if there is no chart.'
#: What is kept of an answer.
ANSWERS = "key string, response string, error string"
NO_CHARTS = "Charts were not read: redaction is on, and page images can not be redacted."


@dataclass(frozen=True)
class Model:
    name: str
    order: int
    label: str
    client: Callable[[str], str]
    max_chars: int
    attempts: int = 3
    backoff_s: float = 2.0
    prompt: str = PROMPT


@dataclass(frozen=True)
class ChartModel:
    """Reads charts off page images: client is a function of prompt and PNG."""

    name: str
    client: Callable[[str, bytes], str]
    attempts: int = 2
    backoff_s: float = 2.0
    confidence: float = 0.60
    prompt: str = CHART_PROMPT


def hosted_client(model: str, temperature: float = 0.0, url: str | None = None, key: str | None = None, timeout: float = 180.0) -> Callable[[str], str]:
    """A chat endpoint that takes and gives messages; address and key from FACTLOOM_MODEL_URL and FACTLOOM_MODEL_KEY."""
    url, key = url or os.environ["FACTLOOM_MODEL_URL"], key or os.environ["FACTLOOM_MODEL_KEY"]

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}), timeout=timeout) as r:
            said = json.load(r)
        return "".join(part["text"] for part in said["message"]["content"])

    return ask


def build(config: Config) -> list[Model]:
    """The models that are switched on and can be reached, in their order; the patterns always come last."""
    out, prompt = [], prompt_text(config, config.prompts.extract, PROMPT)
    if config.hosted.enabled and os.environ.get("FACTLOOM_MODEL_URL") and os.environ.get("FACTLOOM_MODEL_KEY"):
        h = config.hosted
        out.append(Model("CohereExtractor", 0, "hosted", hosted_client(h.model, h.temperature), h.max_chars, h.attempts, h.backoff_s, prompt))
    if config.local.enabled and plugins.reachable(config.local.host, config.local.model):
        x = config.local
        out.append(Model("OllamaExtractor", 1, "local", plugins.local_model(x.host, x.model, x.timeout_s, x.temperature), x.max_chars, x.attempts, prompt=prompt))
    return out


def prompt_text(config: Config, name: str, default: str) -> str:
    """The prompt file of that name, or the default where no folder is set. A missing file is an error."""
    if config.prompts.folder is None:
        return default
    with open(os.path.join(config.prompts.folder, name), encoding="utf-8") as f:
        return f.read()


def build_charts(config: Config) -> ChartModel | None:
    """The vision model, if it is switched on, reachable and there, and pages are not to be redacted."""
    v = config.vision
    if not v.enabled or config.redact or not plugins.reachable(v.host, v.model):
        return None
    prompt = prompt_text(config, config.prompts.charts, CHART_PROMPT)
    return ChartModel(v.model, plugins.local_vision_model(v.host, v.model, v.timeout_s, v.temperature), v.attempts, confidence=v.confidence, prompt=prompt)


def charts(images: DataFrame, model: ChartModel, cache: str | None = None) -> DataFrame:
    """Rows of responses.charts() over page images (doc_id, page_num, png), as plugins.rendered_pages() gives them.

    Equal images are asked for once, and kept in the folder cache by model, prompt and image. A page without a readable answer has no charts."""
    key = content_key(F.lit(model.name), F.lit(model.prompt), F.sha2("png", 256))
    pages = staged(images.select("doc_id", F.col("page_num").alias("page"), "png", key.alias("key")), "page-images")

    def compute(new: DataFrame) -> DataFrame:
        return plugins.image_answers(new, model.prompt, model.client, model.attempts, model.backoff_s).select("key", "response", "error")

    if cache:
        said = Store(pages.sparkSession, cache, ANSWERS).get(pages.select("key", "png"), lambda new: compute(new).where("response is not null")).drop("computed")
    else:
        said = staged(compute(pages.dropDuplicates(["key"])), "chart-answers")
    return responses.charts(responses.parsed(pages.select("doc_id", "page", "key").join(said, "key")), model.confidence)


def candidates(pages: DataFrame, model: Model, redact: bool = False, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, details (doc_id, extractor_ord, doc_date, notes, missing_fields)) of one model over pages (doc_id, doc_name, page_num, text).

    Pages are redacted before they leave, if asked for. Answers are kept by model and prompt in the folder cache, where
    only new prompts are asked. A chunk that gets no readable answer has what the patterns find instead, and a note."""
    own = pages.withColumn("text", T.redacted(F.col("text"))) if redact else pages
    chunks = layout.chunked(own, model.max_chars)
    names = pages.groupBy("doc_id").agg(F.first("doc_name").alias("doc_name"))
    text = model.prompt if "{form}" in model.prompt else model.prompt + "\n{form}\nDocument: {name}"
    head = F.replace(F.replace(F.lit(text), F.lit("{form}"), responses.schema_hint(F.col("doc_name"))), F.lit("{name}"), F.col("doc_name"))
    asked = responses.prompts(own, chunks, "").join(names, "doc_id").withColumn("prompt", F.concat(head, F.col("prompt")))
    asked = staged(asked.select("doc_id", "chunk", "prompt", content_key(F.lit(model.name), F.col("prompt")).alias("key")), "prompts")

    def compute(new: DataFrame) -> DataFrame:
        got = plugins.answers(new.select(F.col("key").alias("doc_id"), F.lit(0).alias("chunk"), "prompt"), model.client, model.attempts, model.backoff_s)
        return got.select(F.col("doc_id").alias("key"), "response", "error")

    if cache:
        said = Store(asked.sparkSession, cache, ANSWERS).get(asked.select("key", "prompt"), lambda new: compute(new).where("response is not null")).drop("computed")
    else:
        said = staged(compute(asked.dropDuplicates(["key"])), "answers")
    read = staged(responses.parsed(asked.select("doc_id", "chunk", "key").join(said, "key", "left")).drop("key"), "parsed-answers")
    good, failed = read.where("v is not null"), read.where("v is null").select("doc_id", "chunk")
    # The patterns over the pages of chunks without an answer, document and chunk together being the key.
    lost = staged(own.join(chunks, ["doc_id", "page_num"]).join(failed, ["doc_id", "chunk"]).withColumn("doc_id", F.struct("doc_id", "chunk")), "lost-chunks")
    hits = extract.all_hits(lost)
    found = extract.metric_candidates(lost, hits=hits)
    metrics = staged(responses.response_metrics(good), "answer-metrics")
    parts = ["field", "value", "hurdle", "confidence", "page", "snippet"]
    both = metrics.select("doc_id", "chunk", *parts).unionByName(found.select("doc_id.doc_id", "doc_id.chunk", *parts))
    merged = staged(responses.merged_chunks(both), "merged-answers")
    out = merged.withColumns({"extractor": F.lit(model.name), "extractor_ord": F.lit(model.order), "confidence": F.coalesce("confidence", F.lit(0.0)), "snippet": F.coalesce("snippet", F.lit(""))})
    note = F.concat(F.lit("Chunk "), F.col("chunk").cast("string"), F.lit(f" had no readable answer ({model.label}); patterns were used."))
    instead = extract.doc_dates(lost, hits).join(extract.missing_fields(found), "doc_id").select("doc_id.doc_id", "doc_id.chunk", "doc_date", "missing_fields").withColumn("notes", F.array(note))
    details = responses.merged_details(responses.chunk_details(good, metrics).unionByName(instead), extract.missing_fields(merged), model.label)
    return out.select(*COLUMNS), details.select("doc_id", F.lit(model.order).alias("extractor_ord"), "doc_date", "notes", "missing_fields")


def all_candidates(pages: DataFrame, models: list[Model], redact: bool = False, cache: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Candidates and details of all models, for pipeline.analyse(extra=..., details=...); None without models."""
    out = details = None
    for m in models:
        part, own = candidates(pages, m, redact, f"{cache}/{m.name}" if cache else None)
        out, details = (part, own) if out is None else (out.unionByName(part), details.unionByName(own))
    return out, details
