"""From raw documents to a training mix in five stages, each one operator of factloom.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is
all that its predecessor kept, and returns a DataFrame. All but the last return the
columns of documents (with other columns that docs may have); n_chars follows the
text where a stage changes it.

Rows with null ids or texts pass through like others: a null text is an empty one. The
first, third and fourth stage judge each row by its own text, whatever its id; where line
dedup and mixing count documents, rows that share an id are one, null ids being one id,
the smallest. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, line_dedup, mixing, quality, trie_join
from factloom.llm.common import NULL_KEY, written


def _internal(docs: DataFrame, *but: str) -> tuple[dict[str, str], list]:
    """Internal names for columns to carry past an operator, and the columns that restore them."""
    names = [c for c in docs.columns if c not in but]
    keep = {f"_c{k}": c for k, c in enumerate(names)}
    return keep, [F.col(k).alias(c) for k, c in keep.items()]


def _matched(docs: DataFrame, ids: DataFrame, how: str, *more) -> DataFrame:
    """docs' columns (and more) of docs joined by id with ids (_id, ...), under names that can't clash."""
    keep, back = _internal(docs)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("_id"), *[F.col(f"`{c}`").alias(k) for k, c in keep.items()])
    return own.join(ids, "_id", how).select(*back, *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under the threshold) go."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep, back = _internal(docs)
    out = quality.score(docs, trees, keep=keep)
    return out.where(F.col("score") >= quality.THRESHOLD).select(*back)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least three documents stay only in the last; documents left without a word go."""
    keep, back = _internal(docs, "text", "n_chars")
    out = line_dedup.LineIndex.build(docs).apply(docs, keep=keep)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    restored = dict(zip(keep.values(), back, strict=True)) | {k: v.alias(k) for k, v in text.items()}
    return out.select(*[restored[c] for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest document stays; without words, all do.

    Documents are told apart by id and text, so others of their id, null ones too, stay; rows that repeat both stand or fall together."""
    key = F.xxhash64("doc_id", "text")
    ids = docs.select(key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = written(trie_join.jaccard_classes(ids, "_key").select(F.col("_id").alias("_key"), F.col("component_id").alias("_comp")).where("_key <> _comp"), "near-copies")
    # All of a group but its first by key are known so far; the smallest document takes that one's place.
    members = groups.select("_key", "_comp").union(groups.select("_comp", "_comp")).distinct()
    own = ids.select("_key", F.coalesce("doc_id", F.lit(NULL_KEY)).alias("_doc"))
    first = members.join(own, "_key").groupBy("_comp").agg(F.min(F.struct("_doc", "_key"))["_key"].alias("_first"))
    gone = members.join(first, "_comp").where("_key <> _first").select("_key").distinct()
    keep, back = _internal(docs)
    rows = docs.select(key.alias("_key"), *[F.col(f"`{c}`").alias(k) for k, c in keep.items()])
    return rows.join(gone.hint("shuffle_hash"), "_key", "left_anti").select(*back)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each use of a document, range-sorted by position, with the words to take of it.

    Rows that repeat an id share the place of the longest and stand there together."""
    sizes = written(mixing.sized(docs), "mix-sizes")
    one = sizes.groupBy("_id").agg(F.max_by("source", "size").alias("source"), F.max("size").alias("size"))
    uses = mixing.plan(one).select("_id", F.explode("passes").alias("use"))
    out = _matched(docs, uses, "inner", F.col("use.position").alias("position"), F.col("use.pass").alias("pass"), F.col("use.words").alias("words"))
    return out.orderBy("position", "pass", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]
#: The quality stage's trees are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
