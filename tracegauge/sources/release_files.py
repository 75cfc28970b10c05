"""A data source over the files of a release, and a writer of such files.

The tree is listed once. Files are cut into byte ranges of about the same size; a range
yields the records that begin in it, typed by kind, so a file of any size is many rows and
may be many tasks, and many small files are one task. Folders may lie in any store that
pyarrow opens by its address.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where the files of a task and of a split lie, and the heading of a section.
INTERACTIONS, CALLS, GOALS = "logs/environment_io.md", "logs/api_calls.jsonl", "dbs/supervisor.jsonl"
HEADING = re.compile(rb"### Environment Interaction \d+\s*")
INSERT = b"INSERT INTO tasks"

KINDS = {INTERACTIONS: "interaction", CALLS: "call", GOALS: "goal"}
KEYS = ("architecture", "vendor", "model_family", "benchmark_split", "task_id")
SCHEMA = "kind string, " + ", ".join(f"{k} string" for k in KEYS) + ", place bigint, text string"
RANGE_BYTES = 32 << 20
FILE_COST = 64 << 10
BATCH_ROWS = 1000


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of an address or a local path."""
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def children(address: str) -> list[str]:
    """Names of the folders right below one."""
    system, path = opened(address)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory)


@dataclass(frozen=True)
class Piece:
    """A byte range of one file."""

    path: str
    kind: str
    keys: tuple[str | None, ...]
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def placed(parts: list[str]) -> tuple[str, tuple[str | None, ...]] | None:
    """Kind and keys of a file by its path below the root; None where it is no file of a release."""
    if len(parts) == 8 and parts[4] == "tasks" and (kind := KINDS.get("/".join(parts[6:]))):
        return kind, (*parts[:4], parts[5])
    if len(parts) == 6 and parts[4] == "evaluations" and parts[5] == f"{parts[3]}.json":
        return "truth", (*parts[:4], None)
    return None


def lines_from(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at or after ``start``."""
    raw = io.BufferedReader(file, 1 << 20)
    at = max(0, start - 1)
    raw.seek(at)
    if start:
        at += len(raw.readline())
    for line in raw:
        yield at, line
        at += len(line)


def records(file, piece: Piece) -> Iterator[tuple[int, str | None, bytes]]:
    """(place, task, text) of the records that begin in a range: sections, lines, or tasks of an evaluation."""
    if piece.kind == "truth":
        yield -1, None, b"{}"  # the split was evaluated, even where no task was
        for i, (task, own) in enumerate((json.loads(file.read()).get("individual") or {}).items()):
            yield i, task, json.dumps(own).encode()
        return
    held, begun = None, 0
    for at, line in lines_from(file, piece.start):
        heads = piece.kind == "interaction" and HEADING.fullmatch(line.rstrip(b"\r\n"))
        if at >= piece.end and (held is None or heads):
            break
        if piece.kind == "interaction":
            if heads:
                if held is not None:
                    yield begun, None, b"".join(held)
                held, begun = [], at
            elif held is not None:
                held.append(line)
        elif piece.kind == "call" or INSERT in line:
            yield at, None, line.rstrip(b"\r\n")
    if held is not None:
        yield begun, None, b"".join(held)


class ReleaseReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.architectures = json.loads(options["architectures"])
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Pieces]:
        system, base = opened(self.root)
        out, held, size = [], [], 0
        for architecture in self.architectures:
            for info in system.get_file_info(fs.FileSelector(f"{base}/{architecture}", recursive=True, allow_not_found=True)):
                found = placed(info.path[len(base) :].strip("/").split("/")) if info.type == fs.FileType.File else None
                if found is None:
                    continue
                step = info.size if found[0] == "truth" else self.range_bytes
                for start in range(0, max(1, info.size), max(1, step)):
                    held.append(Piece(info.path, *found, start, min(start + max(1, step), info.size)))
                    size += held[-1].end - start + FILE_COST
                    if size >= self.range_bytes:
                        out.append(Pieces(held))
                        held, size = [], 0
        return [*out, Pieces(held)] if held or not out else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        columns = [pa.field(n, pa.int64() if n == "place" else pa.string()) for n in ("kind", *KEYS, "place", "text")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, schema=pa.schema(columns))

        for piece in partition.pieces:
            with system.open_input_file(piece.path) as file:
                for place, task, text in records(file, piece):
                    text = text.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                    rows.append((piece.kind, *piece.keys[:4], task if piece.kind == "truth" else piece.keys[4], place, text))
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
        if rows:
            yield batch()


class ReleaseSource(DataSource):
    """``spark.read.format("trace_release")`` with ``path``, ``architectures`` (a JSON list) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "trace_release"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReleaseReader:
        return ReleaseReader(self.options)


def read_files(spark: SparkSession, root: str, architectures: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(kind, keys, place, text): sections, call lines, insert lines and evaluated tasks of the named folders."""
    spark.dataSource.register(ReleaseSource)
    reader = spark.read.format("trace_release").option("architectures", json.dumps(list(architectures))).option("rangeBytes", range_bytes)
    return reader.load(root)


def write_files(rows: DataFrame, root: str) -> None:
    """One file per row (path below the root, text); a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("path", "text").mapInArrow(run, "n bigint").agg({"n": "sum"}).collect()
