"""Fund documents for the queries: text made from supplier rows by SQL that Spark and DuckDB both run.

Two pages a document, one document a supplier, the nation being the fund. Numbers are
put together from integers, so both engines write the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "s_suppkey"
#: Documents that a task makes the texts of.
DOCUMENTS = 4096
_I = lambda x: f"CAST(CAST({x} AS BIGINT) AS STRING)"
_TWO = lambda x: f"lpad({_I(x)}, 2, '0')"
NL = "chr(10)"

NAME = f"concat(CASE {K} % 8 WHEN 0 THEN 'LPA_' WHEN 1 THEN 'Side_Agreement_' WHEN 2 THEN 'audited_' WHEN 3 THEN 'Financial_' WHEN 4 THEN 'Quarterly_Update_' WHEN 5 THEN 'Update_' WHEN 6 THEN 'Deck_' ELSE 'notes_' END, {_I(K)}, '.txt')"
DATE = f"CASE WHEN {K} % 11 = 0 THEN '' WHEN {K} % 5 = 0 THEN concat('Effective Date: 2025-', {_TWO(f'{K} % 12 + 1')}, '-01', {NL}) ELSE concat('As-of Date: 2025-', {_TWO(f'{K} % 12 + 1')}, '-', {_TWO(f'{K} % 28 + 1')}, {NL}) END"
AUM = f"CASE WHEN {K} % 7 = 0 THEN '' ELSE concat('Assets Under Management (AUM): $', {_I(f'{K} % 3 + 1')}, '.', {_TWO(f'{K} % 10')}, 'B', {NL}) END"
NET = f"concat('Net IRR (since inception): ', {_I(f'{K} % 9 + 11')}, '.', {_I(f'{K} % 10')}, '%', {NL})"
TVPI = f"CASE WHEN {K} % 13 = 0 THEN concat('TVPI', {NL}, '1.', {_TWO(f'{K} % 90 + 10')}, 'x', {NL}) ELSE concat('TVPI: 1.', {_TWO(f'{K} % 90 + 10')}, 'x', {NL}) END"
TARGET = f"CASE WHEN {K} % 6 = 5 THEN '' ELSE concat('Target IRR: ', {_I(f'{K} % 7 + 12')}, '%', {NL}) END"
FEE = f"CASE WHEN {K} % 4 = 0 THEN concat('Management Fee', {NL}, {_I(f'{K} % 2 + 1')}, '.', {_TWO(f'{K} % 4 * 25')}, '% on committed capital', {NL}) ELSE concat('Management Fee: ', {_I(f'{K} % 2 + 1')}, '.', {_TWO(f'{K} % 4 * 25')}, '% on committed capital', {NL}) END"
CARRY = f"CASE WHEN {K} % 10 = 9 THEN '' ELSE concat('Carry: ', {_I(f'{K} % 3 * 5 + 10')}, '% over an ', {_I(f'{K} % 2 + 7')}, '% preferred return', {NL}) END"
PROSE = f"CASE WHEN {K} % 3 = 0 THEN concat('The team is targeting a ', {_I(f'{K} % 5 + 18')}, '% gross IRR.', {NL}) ELSE '' END"
BASIS = f"CASE {K} % 4 WHEN 0 THEN concat('All figures are net of fees.', {NL}) WHEN 1 THEN concat('All figures are gross of fees.', {NL}) ELSE '' END"
PAGE1 = f"concat({DATE}, {AUM}, 'Performance Summary', {NL}, {NET}, {TVPI}, {TARGET})"
PAGE2 = f"concat('Fees and Expenses', {NL}, {FEE}, {CARRY}, {PROSE}, 'Definitions', {NL}, {BASIS}, '1) Unaudited, see note.', {NL})"

#: Pages and documents as SQL over the table supplier.
PAGES = f"""SELECT CAST({K} AS BIGINT) AS doc_id, CAST({K} AS BIGINT) AS doc_ord, {NAME} AS doc_name, CAST(s_nationkey AS BIGINT) AS fund, 1 AS page_num, {PAGE1} AS text FROM supplier
UNION ALL SELECT CAST({K} AS BIGINT), CAST({K} AS BIGINT), {NAME}, CAST(s_nationkey AS BIGINT), 2, {PAGE2} FROM supplier"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages by way of an explode, so that what reads a text does not make it anew in each of its expressions.

    Suppliers are few bytes, so one task reads many of them; they are dealt out before they become texts."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    tasks = -(-suppliers.count() // DOCUMENTS)
    suppliers = suppliers.repartition(tasks, "s_suppkey") if tasks > 1 else suppliers
    docs = suppliers.selectExpr(f"CAST({K} AS BIGINT) AS doc_id", f"CAST({K} AS BIGINT) AS doc_ord", f"{NAME} AS doc_name", "CAST(s_nationkey AS BIGINT) AS fund", f"array(struct(1 AS page_num, {PAGE1} AS text), struct(2 AS page_num, {PAGE2} AS text)) AS pages")
    return docs.select("doc_id", "doc_ord", "doc_name", "fund", F.inline("pages"))
