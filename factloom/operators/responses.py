"""What a language or vision model answers, as rows: parsing, repair, percent numbers, merging of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METRICS
from ..functions import text as T

PERCENTS = ("net_irr", "target_irr", "mgmt_fee", "carry")
# What notes say of a repaired percent figure and of a document of several chunks.
REPAIRED = "{what}: model returned {was} (looked like a fraction, not a percent) -- auto-corrected to {now} per this schema's percent-number convention."
CHUNKED = "Document processed in {n} chunks due to length ({source})."


def _try(path: str, kind: str):
    return F.try_variant_get("v", path, kind)


def parsed(responses: DataFrame, raw: str = "response") -> DataFrame:
    """responses (doc_id, chunk, ...) with v, the VARIANT of the answer; null where it can't be read."""
    return responses.withColumn("v", T.parsed_json(F.col(raw)))


def response_metrics(responses: DataFrame, fields: tuple[str, ...] = METRICS) -> DataFrame:
    """(doc_id, chunk, field, value, hurdle, basis, confidence, page, snippet, notes) from parsed(), of the fields asked for;
    absent or odd metrics are null with confidence 0. The answer is read once, into one struct."""
    form = ", ".join(f"{m}: struct<value: double, hurdle: double, basis: string, confidence: double, evidence: struct<page: int, snippet: string>>" for m in fields)
    rows = []
    for m in fields:
        own = F.col("_s")[m]
        raw, hurdle = own["value"], own["hurdle"] if m == "carry" else F.lit(None).cast("double")
        fixed, fixed_hurdle = (T.percent_repaired(raw), T.percent_repaired(hurdle)) if m in PERCENTS else (raw, hurdle)
        changed = F.array_compact(F.array(*[F.when(a != b, T.filled(REPAIRED, what=F.lit(f"{m}.{part}"), was=a, now=b)) for part, a, b in (("value", raw, fixed), ("hurdle", hurdle, fixed_hurdle))]))
        rows.append(F.struct(F.lit(m).alias("field"), fixed.alias("value"), fixed_hurdle.alias("hurdle"), own["basis"].alias("basis"), F.coalesce(own["confidence"], F.lit(0.0)).alias("confidence"), own["evidence"]["page"].alias("page"), F.coalesce(own["evidence"]["snippet"], F.lit("")).alias("snippet"), changed.alias("notes")))
    return responses.select("doc_id", "chunk", _try("$", f"struct<{form}>").alias("_s")).select("doc_id", "chunk", F.inline(F.array(*rows)))


def response_dates(responses: DataFrame) -> DataFrame:
    """(doc_id, chunk, doc_date): a date given as an object is its value."""
    return responses.select("doc_id", "chunk", F.coalesce(_try("$.doc_date.value", "string"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.doc_date", "variant")) == "STRING", _try("$.doc_date", "string"))).alias("doc_date"))


def response_notes(responses: DataFrame) -> DataFrame:
    """(doc_id, chunk, note_ord, note): a note given as an object is its text."""
    items = F.coalesce(F.try_variant_get("v", "$.notes", "array<variant>"), F.array().cast("array<variant>"))
    out = responses.select("doc_id", "chunk", F.posexplode(items).alias("note_ord", "n"))
    return out.select("doc_id", "chunk", "note_ord", F.coalesce(F.try_variant_get("n", "$.text", "string"), F.try_variant_get("n", "$", "string"), F.to_json("n")).alias("note"))


def merged_chunks(metrics: DataFrame) -> DataFrame:
    """A row for each document and field: of the chunks that have a value the surest, the earliest on ties; nulls where none has."""
    parts = ("value", "hurdle", "confidence", "page", "snippet")
    present = F.when(F.col("value").isNotNull(), F.struct(*parts))
    best = F.max_by(present, F.when(F.col("value").isNotNull(), F.struct("confidence", -F.col("chunk"))))
    out = metrics.groupBy("doc_id", "field").agg(best.alias("b"))
    return out.select("doc_id", "field", *[F.col("b")[p].alias(p) for p in parts])


def merged_notes(notes: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """(doc_id, notes): distinct notes in the order of chunks, and one on the number of chunks."""
    held = F.array_sort(F.collect_list(F.struct("chunk", "note_ord", "note")))
    said = notes.groupBy("doc_id").agg(F.array_distinct(F.transform(held, lambda x: x["note"])).alias("n"))
    per = chunks.groupBy("doc_id").agg(F.count_distinct("chunk").alias("c")).join(said, "doc_id", "left")
    last = T.filled(CHUNKED, n=F.col("c"), source=F.lit(source))
    return per.select("doc_id", F.concat(F.coalesce("n", F.array().cast("array<string>")), F.array(last)).alias("notes"))


def response_missing(responses: DataFrame) -> DataFrame:
    """(doc_id, chunk, missing_fields): what an answer itself lists as missing, as texts."""
    items = F.coalesce(F.try_variant_get("v", "$.missing_fields", "array<variant>"), F.array().cast("array<variant>"))
    return responses.select("doc_id", "chunk", F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))).alias("missing_fields"))


def chunk_details(good: DataFrame, metrics: DataFrame) -> DataFrame:
    """(doc_id, chunk, doc_date, notes, missing_fields) of answers: their own notes, then those on repaired figures.

    good: parsed() answers that can be read; metrics: their response_metrics()."""
    fields = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("field")).cast("int")
    repairs = metrics.select("doc_id", "chunk", fields.alias("f"), F.posexplode("notes").alias("k", "note")).select("doc_id", "chunk", ((1 << 20) + F.col("f") * 2 + F.col("k")).cast("int").alias("note_ord"), "note")
    held = F.array_sort(F.collect_list(F.struct("note_ord", "note")))
    notes = response_notes(good).unionByName(repairs).groupBy("doc_id", "chunk").agg(F.transform(held, lambda x: x["note"]).alias("notes"))
    out = response_dates(good).join(response_missing(good), ["doc_id", "chunk"]).join(notes, ["doc_id", "chunk"], "left")
    return out.withColumn("notes", F.coalesce("notes", F.array().cast("array<string>"))).select("doc_id", "chunk", "doc_date", "notes", "missing_fields")


def merged_details(details: DataFrame, missing: DataFrame, source: str) -> DataFrame:
    """(doc_id, doc_date, notes, missing_fields) of chunk_details(): of a document in one piece what its answer says;
    of several chunks the first date, all notes once with one on the number of chunks, and what is missing after merging (doc_id, missing_fields)."""
    held = F.array_sort(F.collect_list(F.struct("chunk", "doc_date", "notes", "missing_fields")))
    per = details.groupBy("doc_id").agg(held.alias("h")).join(missing.withColumnRenamed("missing_fields", "_m"), "doc_id", "left")
    n = F.size("h")
    dates = F.filter(F.transform("h", lambda x: F.nullif(x["doc_date"], F.lit(""))), lambda x: x.isNotNull())
    said = F.flatten(F.transform("h", lambda x: x["notes"]))
    last = F.array(T.filled(CHUNKED, n=n, source=F.lit(source)))
    one = F.col("h")[0]
    return per.select(
        "doc_id", F.get(dates, F.lit(0)).alias("doc_date"), F.when(n == 1, one["notes"]).otherwise(F.concat(F.array_distinct(said), last)).alias("notes"),
        F.when(n == 1, one["missing_fields"]).otherwise(F.coalesce("_m", F.array().cast("array<string>"))).alias("missing_fields"),
    )


def schema_hint(name: Column) -> Column:
    """The JSON object that a prompt shows as the form of an answer, for a column of document names."""
    evidence = F.struct(name.alias("doc_name"), F.lit(None).cast("int").alias("page"), F.lit("").alias("snippet"))
    cols = [name.alias("doc_name"), F.lit(None).cast("string").alias("doc_date")]
    for m in METRICS:
        extra = {"mgmt_fee": [F.lit(None).cast("string").alias("basis")], "carry": [F.lit(None).cast("double").alias("hurdle")]}.get(m, [])
        cols.append(F.struct(F.lit(None).cast("double").alias("value"), *extra, F.lit(0.0).alias("confidence"), evidence.alias("evidence")).alias(m))
    return F.to_json(F.struct(*cols, F.array().cast("array<string>").alias("notes"), F.array().cast("array<string>").alias("missing_fields")), {"ignoreNullFields": "false"})


def prompts(pages: DataFrame, chunks: DataFrame, head: str) -> DataFrame:
    """(doc_id, chunk, prompt): the pages of each chunk in order behind their markers."""
    both = pages.join(chunks, ["doc_id", "page_num"])
    held = F.array_sort(F.collect_list(F.struct("page_num", F.concat(F.lit("--- PAGE "), F.col("page_num").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit(""))).alias("t"))))
    return both.groupBy("doc_id", "chunk").agg(F.concat(F.lit(head + "\n\n"), F.array_join(F.transform(held, lambda x: x["t"]), "\n\n")).alias("prompt"))


def charts(responses: DataFrame, confidence: float = 0.60) -> DataFrame:
    """(doc_id, page, chart_ord, chart_type, title, x_label, y_label, series, summary, confidence, snippet) from parsed(); what is no chart is skipped."""
    items = F.coalesce(F.try_variant_get("v", "$.charts", "array<variant>"), F.array().cast("array<variant>"))
    c = responses.select("doc_id", "page", F.posexplode(items).alias("chart_ord", "c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    g = lambda p: F.try_variant_get("c", p, "string")
    points = F.filter(F.coalesce(F.try_variant_get("c", "$.series", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    series = F.transform(points, lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.label", "string"), F.lit("")).alias("label"), F.try_variant_get(x, "$.value", "double").alias("value")))
    return c.select("doc_id", "page", "chart_ord", g("$.chart_type").alias("chart_type"), g("$.title").alias("title"), g("$.x_label").alias("x_label"), g("$.y_label").alias("y_label"), series.alias("series"), g("$.summary").alias("summary"), F.lit(confidence).alias("confidence"), F.substring(F.coalesce(F.nullif(g("$.title"), F.lit("")), g("$.summary"), F.lit("")), 1, 200).alias("snippet"))
