"""New documents as a stream: a batch's pages are read, and the rules compare its documents with those before.

A batch holds whole documents. What it says of a document replaces what earlier ones said; the document's
version is its last batch's number. A batch leaves its documents' rows, the flags that they are part of alone, with
their versions, and the pairs of figures of a fund that are at odds and of which one at least is theirs. Pairs of
documents are many more than documents, so they are not written: they are met again on reading, by such
figures. Flags of replaced versions are left out then, so nothing that earlier batches wrote is written
again, and a reader always finds whole tables. All is written under the batch's number: a batch that
runs again replaces itself. There is no event time in the model, so there is nothing to set a watermark on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Config
from ..operators import reports, rules
from ..plans import pipeline
from ..session import staged

PAGES = "doc_id long, doc_ord long, doc_name string, fund long, page_num int, text string"
TABLES = ("docs", "metrics", "candidates", "mentions", "disagreements")


def pages_stream(spark: SparkSession, folder: str, schema: str = PAGES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def versions(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """(doc_id, batch) of the documents as they stand now, or stood after a batch."""
    docs = spark.read.parquet(f"{out}/docs")
    docs = docs if upto is None else docs.where(F.col("batch") <= upto)
    return docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))


def current(spark: SparkSession, out: str, name: str, upto: int | None = None) -> DataFrame:
    """The rows of one of TABLES, of every document's last version."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{out}/{name}")
    return rows.join(versions(spark, out, upto), ["doc_id", "batch"], "left_semi").drop("batch")


def flags(spark: SparkSession, out: str) -> DataFrame:
    """The flags between documents as they stand now."""
    now = versions(spark, out)
    rows = spark.read.parquet(f"{out}/flags")
    for side in "ab":
        rows = rows.join(now.select(F.col("doc_id").alias(f"doc_{side}"), F.col("batch").alias(f"version_{side}")), [f"doc_{side}", f"version_{side}"], "left_semi")
    odd = spark.read.parquet(f"{out}/odd").drop("batch").distinct()
    docs, mentions, found = (current(spark, out, name) for name in ("docs", "mentions", "disagreements"))
    return rows.select(*rules.FLAG).unionByName(rules.run_rules(docs, mentions, found, names=rules.PAIRS, odd=odd))


def scores(spark: SparkSession, out: str) -> DataFrame:
    return reports.recommendation(reports.risk_score(flags(spark, out), current(spark, out, "docs"), "fund"))


def step(batch: DataFrame, number: int, out: str, config: Config = Config(), store: str | None = None) -> None:
    """Takes one batch of pages into the tables under ``out``."""
    spark = batch.sparkSession
    got = pipeline.extracted(batch, config, store=store)
    for name in TABLES:
        getattr(got, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    known = staged(versions(spark, out, number), "versions")
    schema = StructType([*got.docs.schema.fields, StructField("batch", IntegerType())])
    docs = spark.read.schema(schema).parquet(f"{out}/docs").join(known, ["doc_id", "batch"])
    # Funds without a new document have no new flag.
    docs = docs.join(got.docs.select("fund").distinct(), "fund", "left_semi").withColumn("fresh", F.col("batch") == number).drop("batch")
    docs = staged(docs, "compared")
    rules.figures_at_odds(docs, config.rules).write.mode("overwrite").parquet(f"{out}/odd/batch={number}")
    new = rules.run_rules(docs, got.mentions, got.disagreements, config.rules, [name for name in rules.REGISTRY if name not in rules.PAIRS])
    for side in "ab":
        new = new.join(known.select(F.col("doc_id").alias(f"doc_{side}"), F.col("batch").alias(f"version_{side}")), f"doc_{side}")
    new.write.mode("overwrite").parquet(f"{out}/flags/batch={number}")


def start(pages: DataFrame, out: str, checkpoint: str, config: Config = Config(), store: str | None = None) -> StreamingQuery:
    """Pages of whole documents in; current(), flags() and scores() read the tables under ``out``. Drains what there is."""
    writer = pages.writeStream.foreachBatch(lambda batch, number: step(batch, number, out, config, store))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
