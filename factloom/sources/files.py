"""Reading a folder of documents into pages, and the files that runs leave.

Paths are Spark paths: whatever store the session reads. Files are listed and read by
Spark's own readers, never by the driver's file system.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Ocr
from ..operators import layout, tables
from . import plugins


def _empty(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the *.pdf and *.txt files right in a folder that have no byte, which Spark's readers leave out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [d.getPath() for d in fs.globStatus(at) or [] if d.isDirectory()]
    none = [(s.getPath().toString(),) for d in folders for s in fs.listStatus(d) if s.isFile() and not s.getLen()]
    return spark.createDataFrame([r for r in none if re.search(r"/[^._/][^/]*\.(pdf|txt)$", r[0])], "path string")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc_ord, doc_name, path, content) of the *.pdf and *.txt files right in a folder, in the order of their paths.

    The order is over the names alone, which are as many as the folder has files; contents are not read for it, nor moved."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,txt}").load(folder).select("path", "content")
    files = files.unionByName(_empty(spark, folder).withColumn("content", F.lit(b"")))
    order = F.row_number().over(Window.orderBy("path")) - 1
    listed = files.select("path").select("path", order.cast("long").alias("doc_ord"))
    return files.join(listed, "path").select(F.sha2("path", 256).alias("doc_id"), "doc_ord", F.element_at(F.split("path", "/"), -1).alias("doc_name"), "path", "content")


def text_pages(files: DataFrame) -> DataFrame:
    """A page for each text file: UTF-8 with bad bytes replaced, line ends as LF."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    own = files.where(F.lower("doc_name").endswith(".txt"))
    return own.select("doc_id", "doc_ord", "doc_name", F.lit(1).alias("page_num"), text.alias("text"))


def with_ocr(pages: DataFrame, ocr: DataFrame | None, config: Ocr = Ocr()) -> DataFrame:
    """pages with the OCR's text where a page has next to none and the OCR's is longer; ocr: doc_id, page_num, ocr_text."""
    if ocr is None:
        return pages
    own, other = F.length(F.trim(F.coalesce("text", F.lit("")))), F.length(F.trim(F.coalesce("ocr_text", F.lit(""))))
    better = (own < config.min_text_chars) & (other > own)
    return pages.join(ocr, ["doc_id", "page_num"], "left").withColumn("text", F.when(better, F.col("ocr_text")).otherwise(F.col("text"))).drop("ocr_text")


def other_types(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files in a folder whose type has no reader."""
    return spark.read.format("binaryFile").load(folder).select("path").where(~F.lower("path").rlike(r"\.(pdf|txt)$"))


def load(spark: SparkSession, folder: str, ocr: Ocr = Ocr(), strict: bool = False) -> DataFrame:
    """Pages of all documents of a folder; PDFs by the plugin, which must be installed if there are any. strict: files of other types are an error."""
    if strict and (odd := other_types(spark, folder).first()):
        raise ValueError(f"no reader for {odd['path']}")
    files = discover(spark, folder)
    pages = text_pages(files)
    pdfs = files.where(F.lower("doc_name").endswith(".pdf"))
    if plugins.available("pdf"):
        found = plugins.pdf_pages(pdfs)
        thin = found.where(F.length(F.trim(F.coalesce("text", F.lit("")))) < ocr.min_text_chars)
        read = plugins.ocr_pages(pdfs, thin, ocr.dpi) if ocr.enabled and plugins.available("ocr") else None
        return pages.unionByName(with_ocr(found, read, ocr))
    if pdfs.limit(1).count():
        raise RuntimeError("there are PDFs, and no PDF reader is installed")
    return pages


def pdf_layout(files: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(lines, tables with their pages' footnotes) of the PDFs among discovered files, each None where its reader is not installed."""
    pdfs = files.where(F.lower("doc_name").endswith(".pdf"))
    lines = layout.block_lines(plugins.pdf_blocks(pdfs)) if plugins.available("pdf") else None
    found = [read(pdfs) for kind, read in (("lattice", plugins.ruled_tables), ("tables", plugins.pdf_tables)) if plugins.available(kind)]
    if not found:
        return lines, None
    both = tables.all_tables(*found)
    return lines, both if lines is None else layout.linked_footnotes(both, layout.pdf_footnotes(lines))
