"""Layout: lines, headings, sections, footnotes, their tables, and chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import chunked as chunked

FRONT = "Front Matter"
HEADING_WORDS, HEADING_RATIO = 12, 1.15
BOLD_FLAG = 16
FOOTNOTE_RATIO, FOOTNOTE_Y, FOOTNOTE_WORDS = 0.90, 0.82, 40


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, text): stripped lines that are not blank; line_no counts all lines from 0."""
    split = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), T.LINE_BREAKS)).alias("line_no", "line")
    return docs.select("doc_id", split).select("doc_id", "line_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")


def block_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, text, size, bold, y_frac) of pages as a reader lays them out:
    (doc_id, page_num, height, blocks array<struct<lines array<struct<y0, spans array<struct<text, size, flags>>>>>>).

    A line is its spans' texts, stripped, with the largest size, bold if any span is, at the height of its upper edge;
    lines without text are left out. Null blocks (images), lines and spans count as empty. All of it within the row."""
    lines = F.flatten(F.transform(F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)), lambda b: F.coalesce(b["lines"], F.array())))
    high = F.when(F.col("height") > 0, F.col("height")).otherwise(1.0)

    def line(x: Column) -> Column:
        spans = F.coalesce(x["spans"], F.array())
        text = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
        return F.struct(
            F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["size"])), F.lit(0.0)).cast("double").alias("size"),
            F.exists(spans, lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(BOLD_FLAG) != 0).alias("bold"), (x["y0"] / high).alias("y_frac"),
        )

    held = F.filter(F.transform(lines, line), lambda x: x["text"] != "")
    return blocks.select("doc_id", "page_num", F.posexplode(held).alias("line_no", "l")).select("doc_id", "page_num", "line_no", "l.*")


def _kinds_of_text(lines: DataFrame) -> DataFrame:
    c = F.col("text")
    words = T.word_count(c)
    footnote = T.is_footnote(c) & (words <= FOOTNOTE_WORDS)
    upper = (F.upper(c) == c) & (F.lower(c) != c)
    heading = T.canonical(c).isNotNull() | ((words <= HEADING_WORDS) & (upper | c.endswith(":")))
    return lines.withColumn("kind", F.when(footnote, "footnote").when(heading, "heading").otherwise("text"))


def _kinds_of_pdf(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page_num, line_no, text, size, bold, y_frac)"""
    c = F.col("text")
    body = F.median("size").over(Window.partitionBy("doc_id"))
    lines = lines.withColumn("body", F.when(body == 0, 10.0).otherwise(F.coalesce(body, F.lit(10.0))))
    footnote = (F.col("y_frac") > FOOTNOTE_Y) & (F.col("size") < F.col("body") * FOOTNOTE_RATIO) & T.is_footnote(c)
    large = F.col("size") >= F.col("body") * HEADING_RATIO
    bold = F.col("bold") & ~c.rlike(r"[.,;]$")
    heading = T.canonical(c).isNotNull() | ((T.word_count(c) <= HEADING_WORDS) & (large | bold))
    return lines.withColumn("kind", F.when(footnote, "footnote").when(heading, "heading").otherwise("text")).drop("body")


def _sections(lines: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Numbered by a running count of headings; footnote lines count for the last page only."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "line_no")
    is_heading = F.col("kind") == "heading"
    lines = lines.withColumn("section_ord", F.sum(is_heading.cast("int")).over(order).cast("int"))
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("page_num", "line_no", "text"))))
    out = lines.groupBy("doc_id", "section_ord").agg(
        F.max(F.when(is_heading, F.col("text"))).alias("title"),
        F.min("page_num").alias("page_start"),
        F.max("page_num").alias("last"),
        F.trim(F.array_join(F.transform(said, lambda x: x["text"]), " ")).alias("text"),
    )
    whole = lines.groupBy("doc_id").agg(F.min("page_num").alias("p0"), F.max("page_num").alias("p1"))
    # The front matter is there even if the first line is a heading, and for a document without lines.
    front = whole.select("doc_id", F.lit(0).alias("section_ord"))
    if docs is not None:
        front = docs.select("doc_id", F.lit(0).alias("section_ord")).distinct()
    out = front.join(out, ["doc_id", "section_ord"], "full_outer").join(whole, "doc_id", "left")
    start = F.when(F.col("section_ord") == 0, F.coalesce("p0", F.lit(1))).otherwise(F.col("page_start"))
    after = F.lead(start).over(Window.partitionBy("doc_id").orderBy("section_ord"))
    return out.select(
        "doc_id", "section_ord", F.coalesce("title", F.lit(FRONT)).alias("title"),
        F.when(F.col("section_ord") > 0, T.canonical(F.col("title"))).alias("canonical_type"),
        start.alias("page_start"), F.coalesce(after, "p1", start).alias("page_end"), F.coalesce("text", F.lit("")).alias("text"),
    )


def sections_from_text(docs: DataFrame, text: str = "text", page: int = 1) -> DataFrame:
    """(doc_id, section_ord, title, canonical_type, page_start, page_end, text) of plain texts; every document has its front matter."""
    lines = _kinds_of_text(text_lines(docs, text)).withColumn("page_num", F.lit(page))
    return _sections(lines, docs)


def sections_from_pages(pages: DataFrame, text: str = "text", page: int = 1) -> DataFrame:
    """As of their joined texts, but lines are cut page by page: no document is put together in one row."""
    split = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), T.LINE_BREAKS)).alias("n", "line")
    lines = pages.select("doc_id", "page_num", split).select("doc_id", (F.col("page_num").cast("long") * (1 << 32) + F.col("n")).alias("line_no"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")
    return _sections(_kinds_of_text(lines).withColumn("page_num", F.lit(page)), pages)


def sections_from_lines(lines: DataFrame) -> DataFrame:
    """As above, of lines with font size, weight and place; documents without lines have no section."""
    return _sections(_kinds_of_pdf(lines), None)


def footnotes(kinds: DataFrame) -> DataFrame:
    """(doc_id, fn_ord, marker, text, page_num) of lines with a kind."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "line_no")) - 1
    return kinds.where("kind = 'footnote'").select("doc_id", order.alias("fn_ord"), T.footnote_marker(F.col("text")).alias("marker"), "text", "page_num")


def text_footnotes(docs: DataFrame, text: str = "text", page: int = 1) -> DataFrame:
    return footnotes(_kinds_of_text(text_lines(docs, text)).withColumn("page_num", F.lit(page)))


def pdf_footnotes(lines: DataFrame) -> DataFrame:
    return footnotes(_kinds_of_pdf(lines))


def linked_footnotes(tables: DataFrame, notes: DataFrame) -> DataFrame:
    """tables with footnotes: the texts of all footnotes of their page, in order."""
    held = F.array_sort(F.collect_list(F.struct("fn_ord", F.col("text").alias("t"))))
    of = notes.groupBy("doc_id", F.col("page_num").alias("page")).agg(F.transform(held, lambda x: x["t"]).alias("footnotes"))
    return tables.drop("footnotes").join(of, ["doc_id", "page"], "left").withColumn("footnotes", F.coalesce("footnotes", F.array().cast("array<string>")))


def section_types(sections: DataFrame) -> DataFrame:
    """(doc_id, section_types): canonical types in the order in which they first appear."""
    held = F.array_sort(F.collect_list(F.when(F.col("canonical_type").isNotNull(), F.struct("section_ord", "canonical_type"))))
    return sections.groupBy("doc_id").agg(F.array_distinct(F.transform(held, lambda x: x["canonical_type"])).alias("section_types"))


def section_for_page(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, section_ord, title): the first section whose pages hold each page."""
    both = pages.select("doc_id", "page_num").join(sections, "doc_id").where("page_num between page_start and page_end")
    return both.groupBy("doc_id", "page_num").agg(F.min_by(F.struct("section_ord", "title"), "section_ord").alias("s")).select("doc_id", "page_num", "s.*")
