"""Text documents of a folder as a Spark data source, for batches and for streams.

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("strict", "true").load(folder)
    spark.readStream.format("documents").load(folder)

The rows are those of files.load() over text files. The driver lists names, sizes and times; a partition
is a run of files of some ``partitionBytes``, and executors open them, through the file systems that Arrow
knows (local, HDFS, object stores), so a folder that only Spark's own readers reach is for files.load().

Options: ``strict`` (files of other types are an error), ``encoding`` (UTF-8; bytes that it can't decode are
replaced), ``partitionBytes``. A stream's offset is the time and name of the last file that was
taken and how many came before. A file is taken once; one that appears with an older time than
the offset's is not seen, and files are not to be removed while documents are numbered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "doc_id string, doc_ord long, doc_name string, page_num int, text string"
PARTITION_BYTES = 16 << 20


@dataclass(frozen=True)
class Found:
    name: str
    size: int
    time: int


def _opened(folder: str):
    """(file system, path in it, the folder as Spark names it)"""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:)?/*(/.*)", folder)
    if local:
        path = local[1].rstrip("/") or "/"
        return fs.LocalFileSystem(), path, f"file:{path.rstrip('/')}"
    system, path = fs.FileSystem.from_uri(folder)
    return system, path, folder.rstrip("/")


def listed(folder: str, strict: bool = False) -> list[Found]:
    """The text files right in a folder, by name; what Spark takes for hidden is left out."""
    from pyarrow import fs

    system, path, base = _opened(folder)
    found = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    odd = sorted(x.base_name for x in found if not x.base_name.lower().endswith((".txt", ".pdf")))
    if strict and odd:
        raise ValueError(f"no reader for {base}/{odd[0]}")
    if any(x.base_name.endswith(".pdf") for x in found):
        raise RuntimeError("there are PDFs, which this source does not read")
    return sorted((Found(x.base_name, x.size, x.mtime_ns or 0) for x in found if x.base_name.endswith(".txt")), key=lambda f: f.name)


class Files(InputPartition):
    """A run of files: (number, name)."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


def planned(files: list[Found], first: int, most: int) -> list[Files]:
    """Runs of files of about so many bytes, numbered from ``first``; at least one, as a plan needs it."""
    out: list[list[tuple[int, str]]] = [[]]
    held = 0
    for k, f in enumerate(files, first):
        if out[-1] and held + f.size > most:
            out.append([])
            held = 0
        out[-1].append((k, f.name))
        held += f.size
    return [Files(x) for x in out]


class _Reading:
    """What batches and streams share; a mix-in, as both kinds of readers are classes of their own."""

    def __init__(self, options: dict[str, str]):
        known = {k.lower(): v for k, v in options.items()}
        self.folder = known["path"]
        self.strict = known.get("strict", "false").lower() == "true"
        self.encoding = known.get("encoding", "utf-8")
        self.most = int(known.get("partitionbytes", PARTITION_BYTES))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, path, base = _opened(self.folder)
        for number, name in partition.files:
            with system.open_input_stream(f"{path.rstrip('/')}/{name}") as f:
                text = f.read().decode(self.encoding, "replace")
            doc_id = hashlib.sha256(f"{base}/{name}".encode()).hexdigest()
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc_id, number, name, 1, text), kinds, strict=True)], ["doc_id", "doc_ord", "doc_name", "page_num", "text"])


class Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return planned(listed(self.folder, self.strict), 0, self.most)


class Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": "", "seen": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.folder, self.strict)
        last = max(found, key=lambda f: (f.time, f.name), default=None)
        return {"time": last.time, "name": last.name, "seen": len(found)} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda o: (o["time"], o["name"])
        new = [f for f in listed(self.folder, self.strict) if at(start) < (f.time, f.name) <= at(end)]
        return planned(new, start["seen"], self.most)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(dict(self.options))

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(dict(self.options))
