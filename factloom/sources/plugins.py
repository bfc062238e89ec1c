"""Readers and models at the edge of the graph. Each is optional and named where it is missing.

Plugins run in mapInPandas on rows that earlier steps have chosen, since a condition in
an expression does not keep rows from a Python function.
"""

from __future__ import annotations

import base64
import importlib.util
import io
import json
import tempfile
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

NEEDS = {"pdf": ("fitz",), "ocr": ("pytesseract", "PIL", "fitz"), "tables": ("pdfplumber",), "lattice": ("camelot",)}
TABLES = "doc_id string, table_ord int, table_id string, page int, headers array<string>, rows array<array<struct<header:string,value:string>>>, raw_text string, confidence double, footnotes array<string>"
# Kinds of tables in the order in which they are tried, with the confidence of each.
RULED = (("lattice", 0.85), ("stream", 0.65))


def available(kind: str) -> bool:
    return all(importlib.util.find_spec(m) is not None for m in NEEDS[kind])


def _need(kind: str) -> None:
    if not available(kind):
        raise RuntimeError(f"{kind} needs {', '.join(NEEDS[kind])}")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, doc_name, page_num, text): the text layer of each page."""
    _need("pdf")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for df in batches:
            rows = []
            for r in df.itertuples():
                with fitz.open(stream=r.content, filetype="pdf") as doc:
                    rows += [(r.doc_id, r.doc_ord, r.doc_name, k + 1, page.get_text("text")) for k, page in enumerate(doc)]
            yield pd.DataFrame(rows, columns=["doc_id", "doc_ord", "doc_name", "page_num", "text"])

    return files.select("doc_id", "doc_ord", "doc_name", "content").mapInPandas(read, "doc_id string, doc_ord long, doc_name string, page_num int, text string")


BLOCKS = "doc_id string, page_num int, height double, blocks array<struct<lines: array<struct<y0: double, spans: array<struct<text: string, size: double, flags: int>>>>>>"


def pdf_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, height, blocks): pages as the reader lays them out, for layout.block_lines()."""
    _need("pdf")

    def span(s: dict) -> dict:
        return {"text": s.get("text"), "size": float(s.get("size", 0.0)), "flags": int(s.get("flags", 0))}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for df in batches:
            rows = []
            for r in df.itertuples():
                with fitz.open(stream=r.content, filetype="pdf") as doc:
                    for p, page in enumerate(doc):
                        blocks = [{"lines": [{"y0": float(x["bbox"][1]), "spans": [span(s) for s in x.get("spans", [])]} for x in b.get("lines", [])]} for b in page.get_text("dict").get("blocks", [])]
                        rows.append((r.doc_id, p + 1, float(page.rect.height), blocks))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "height", "blocks"])

    return files.select("doc_id", "content").mapInPandas(read, BLOCKS)


def rendered_pages(files: DataFrame, wanted: DataFrame | None = None, dpi: int = 200, most: int | None = None) -> DataFrame:
    """(doc_id, page_num, png): images of the wanted pages (doc_id, page_num), or of the first ``most``, and of no others."""
    _need("pdf")
    rows = files.select("doc_id", "content")
    if wanted is not None:
        rows = rows.join(wanted.groupBy("doc_id").agg({"page_num": "collect_set"}).toDF("doc_id", "pages"), "doc_id")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for df in batches:
            for r in df.itertuples():
                with fitz.open(stream=r.content, filetype="pdf") as doc:
                    last = min(len(doc), most or len(doc))
                    pages = sorted(r.pages) if wanted is not None else range(1, last + 1)
                    out = [(r.doc_id, int(p), doc[int(p) - 1].get_pixmap(dpi=dpi).tobytes("png")) for p in pages if 1 <= p <= last]
                yield pd.DataFrame(out, columns=["doc_id", "page_num", "png"])

    return rows.mapInPandas(draw, "doc_id string, page_num int, png binary")


def ocr_pages(files: DataFrame, wanted: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc_id, page_num, ocr_text) of the wanted pages."""
    _need("ocr")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pytesseract
        from PIL import Image

        for df in batches:
            yield pd.DataFrame({"doc_id": df.doc_id, "page_num": df.page_num, "ocr_text": [pytesseract.image_to_string(Image.open(io.BytesIO(x))) for x in df.png]})

    return rendered_pages(files, wanted, dpi).mapInPandas(read, "doc_id string, page_num int, ocr_text string")


def pdf_tables(files: DataFrame) -> DataFrame:
    """(doc_id, table_ord, table_id, page, headers, rows, raw_text, confidence, footnotes); empty cells and short rows are kept as empty."""
    _need("tables")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for df in batches:
            out = []
            for r in df.itertuples():
                with pdfplumber.open(io.BytesIO(r.content)) as doc:
                    n = 0
                    for p, page in enumerate(doc.pages):
                        for t, table in enumerate(page.extract_tables()):
                            if table:
                                head = [x or "" for x in table[0]]
                                rows = [[{"header": h, "value": (row[k] if k < len(row) else None) or ""} for k, h in enumerate(head)] for row in table[1:]]
                                out.append((r.doc_id, n, f"pdfplumber_{p}_{t}", p + 1, head, rows, "\n".join(" ".join(x or "" for x in row) for row in table), 0.75, []))
                                n += 1
            yield pd.DataFrame(out, columns=["doc_id", "table_ord", "table_id", "page", "headers", "rows", "raw_text", "confidence", "footnotes"])

    return files.select("doc_id", "content").mapInPandas(read, TABLES)


def ruled_tables(files: DataFrame) -> DataFrame:
    """As pdf_tables, of ruled tables, or of those that blanks align in documents without any; a document that can't be read has none."""
    _need("lattice")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import camelot

        for df in batches:
            out = []
            for r in df.itertuples():
                with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # the library reads paths only; the file lives as long as this row
                    f.write(r.content)
                    f.flush()
                    for flavor, confidence in RULED:
                        try:
                            found = list(camelot.read_pdf(f.name, pages="all", flavor=flavor))
                        except Exception:  # noqa: BLE001 - a kind of table that the document does not have
                            found = []
                        for n, t in enumerate(found):
                            grid = t.df.astype(str)
                            if len(grid.columns):
                                head = list(grid.iloc[0])
                                rows = [[{"header": h, "value": v} for h, v in zip(head, row, strict=True)] for row in grid.iloc[1:].itertuples(index=False)]
                                out.append((r.doc_id, n, f"{flavor}_{n}", int(t.page), head, rows, grid.to_string(), confidence, []))
                        if found:
                            break
            yield pd.DataFrame(out, columns=["doc_id", "table_ord", "table_id", "page", "headers", "rows", "raw_text", "confidence", "footnotes"])

    return files.select("doc_id", "content").mapInPandas(read, TABLES)


def reachable(host: str, model: str | None = None, timeout: float = 2.0) -> bool:
    """Whether a local model server answers, and has the model (by the name before its colon)."""
    try:
        with urllib.request.urlopen(f"{host}/api/tags", timeout=timeout) as r:
            names = [m.get("name", "").split(":")[0] for m in json.load(r).get("models", [])]
    except (OSError, ValueError):
        return False
    return model is None or model.split(":")[0] in names


def local_model(host: str, model: str, timeout: float, temperature: float = 0.0) -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": temperature}}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{host}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["response"]

    return ask


def local_vision_model(host: str, model: str, timeout: float, temperature: float = 0.0) -> Callable[[str, bytes], str]:
    def ask(prompt: str, png: bytes) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "images": [base64.b64encode(png).decode()], "stream": False, "format": "json", "options": {"temperature": temperature}}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{host}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["response"]

    return ask


def _asked(call: Callable[[], str], attempts: int, backoff_s: float) -> tuple[str | None, str | None]:
    """(answer, error) of up to ``attempts`` calls, waiting twice as long each time."""
    error = None
    for k in range(attempts):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001 - whatever the client raises is its answer's error
            error = str(e)
            time.sleep(backoff_s * 2**k if k + 1 < attempts else 0)
    return None, error


def answers(prompts: DataFrame, client: Callable[[str], str], attempts: int = 3, backoff_s: float = 2.0) -> DataFrame:
    """(doc_id, chunk, response, error): each prompt asked up to ``attempts`` times, waiting twice as long each time.

    A failed prompt has a null response, for which the caller takes the patterns' candidates of that chunk. Put it behind
    sources.files.cached(), so that a task that is run again does not pay again."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(r.doc_id, r.chunk, *_asked(lambda r=r: client(r.prompt), attempts, backoff_s)) for r in df.itertuples()]
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "response", "error"])

    kind = prompts.schema["doc_id"].dataType.simpleString()
    return prompts.select("doc_id", "chunk", "prompt").mapInPandas(ask, f"doc_id {kind}, chunk int, response string, error string")


def image_answers(images: DataFrame, prompt: str, client: Callable[[str, bytes], str], attempts: int = 2, backoff_s: float = 2.0) -> DataFrame:
    """(key, response, error) of images (key, png), asked as in answers()."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(r.key, *_asked(lambda r=r: client(prompt, r.png), attempts, backoff_s)) for r in df.itertuples()]
            yield pd.DataFrame(out, columns=["key", "response", "error"])

    return images.select("key", "png").mapInPandas(ask, "key string, response string, error string")


def status(hosted: bool, local_host: str, local_model_name: str) -> dict[str, str]:
    """What is there to work with, for the audit manifest."""
    out = {k: "available" if available(k) else "not installed" for k in NEEDS}
    out["patterns"] = "available"
    out["hosted_model"] = "configured" if hosted else "off"
    out["local_model"] = "available" if reachable(local_host, local_model_name) else "unreachable"
    return out
