"""Cubes and raw frames as Spark data sources: planned input partitions, pushed line and file ranges, two-phase writing.

``spark.read.format("swathline_cube")`` reads a folder of band-interleaved cubes as one sequence of lines. The planner looks at
names and headers only; a partition is a block of lines of one file, cut by the line and path filters of the query, and a task
reads just the wanted bands of its lines. ``swathline_frame`` does the same for raw frames.

``df.write.format("swathline_cube")`` takes one row per line of a cube. A task writes below a folder of its own attempt; what an
attempt has written is renamed into place when the whole job has succeeded, headers after their data, so that a cube that can
be read is whole. Files of attempts that failed or lost a race go with the attempts' folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from swathline.sources import codec

CUBE = "swathline_cube"
FRAME = "swathline_frame"
PIXEL_SCHEMA = "path string, file_no bigint, line bigint, sample bigint, spectrum array<double>"
FRAME_SCHEMA = "path string, line bigint, header binary, data binary"
LINE_SCHEMA = "folder string, line bigint, samples int, bands int, data binary, peak double, side map<string,string>, width int"
ATTEMPTS = "_attempts"
FAR = 1 << 62


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters reach them."""
    spark.dataSource.register(CubeSource)
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Block(InputPartition):
    """Lines ``start`` to ``start + count`` of a file; ``line0`` is the file's first line in the sequence."""
    path: str
    file_no: int
    line0: int
    start: int
    count: int
    shape: dict = field(default_factory=dict)

    def __init__(self, path: str, file_no: int, line0: int, start: int, count: int, shape: dict) -> None:
        super().__init__(None)
        self.path, self.file_no, self.line0, self.start, self.count, self.shape = path, file_no, line0, start, count, shape


class _RangeReader(DataSourceReader):
    """What both readers share: a range of lines and a set of paths taken from options (lower-case names) and filters."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.block = int(options.get("block", 64))
        self.low, last = int(options.get("first", 0)), int(options.get("last", -1))
        self.high = FAR if last < 0 else last
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of ``line`` and equality of ``path`` are taken whole; Spark keeps the others."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "line" and isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif name == "line" and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif name == "line" and isinstance(f, LessThan):
                self.high = min(self.high, value)
            elif name == "line" and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value + 1)
            elif name == "line" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value + 1)
            elif name == "path" and isinstance(f, (EqualTo, In)):
                given = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = given if self.paths is None else self.paths & given
            else:
                yield f

    def blocks(self, path: str, file_no: int, line0: int, lines: int, shape: dict) -> Iterator[Block]:
        """The file's blocks inside the wanted range; none if the file lies outside it."""
        if self.paths is not None and path not in self.paths:
            return
        first, end = max(0, self.low - line0), min(lines, self.high - line0)
        for start in range(first, end, self.block):
            yield Block(path, file_no, line0, start, min(self.block, end - start), shape)


class CubeReader(_RangeReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.bands = json.loads(options["bands"]) if options.get("bands") else None
        self.joined = str(options.get("sequence", "true")).lower() == "true"

    def partitions(self) -> list[Block]:
        """Names in sequence order, then the headers, several at once; a row per file is held here, as in any listing."""
        paths = codec.sequence_order(codec.files_below(self.folder, ".bil"))
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(codec.cube_header, paths))
        shapes = {json.dumps(codec.shape_of(h), sort_keys=True) for h in headers}
        if len(shapes) > 1 and self.joined:
            raise ValueError(f"cubes of one sequence differ: {' and '.join(sorted(shapes)[:2])}")
        out, line0 = [], 0
        for file_no, (path, header) in enumerate(zip(paths, headers, strict=True)):
            out += self.blocks(path, file_no, line0, header["lines"], header)
            line0 += header["lines"] if self.joined else 0
        return out

    def read(self, partition: Block):
        import numpy as np
        import pyarrow as pa

        spectra = codec.read_lines(partition.path, partition.shape, partition.start, partition.count, self.bands)
        for at, data in spectra:  # samples by bands of one line
            n, width = data.shape
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(data.astype(float).ravel()))
            columns = [pa.array([partition.path] * n), pa.array(np.full(n, partition.file_no)), pa.array(np.full(n, partition.line0 + at)), pa.array(np.arange(n)), values]
            yield pa.RecordBatch.from_arrays(columns, ["path", "file_no", "line", "sample", "spectrum"])


class FrameReader(_RangeReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.samples, self.bands = int(options.get("samples", codec.FRAME_SAMPLES)), int(options.get("bands", codec.FRAME_BANDS))
        self.ending = options.get("ending", ".bin")
        self.headers_only = str(options.get("headersonly", "false")).lower() == "true"

    def partitions(self) -> list[Block]:
        size = self.samples * 2 * (self.bands + 1)
        files = sorted(codec.files_below(self.folder, self.ending))
        with ThreadPoolExecutor(16) as pool:
            lines = [n // size for n in pool.map(codec.size_of, files)]
            cut = list(pool.map(codec.last_samples, files))
        return [b for k, path in enumerate(files) for b in self.blocks(path, k, 0, lines[k], {} if cut[k] is None else {"lines": lines[k], "last_samples": cut[k]})]

    def read(self, partition: Block):
        import pyarrow as pa

        head, size = self.samples * 2, self.samples * 2 * (self.bands + 1)
        wanted = head if self.headers_only else size
        with codec.opened(partition.path) as f:
            for line in range(partition.start, partition.start + partition.count):
                raw = codec.take(f, line * size, wanted)
                raw = raw if len(raw) == wanted else bytes(wanted)  # a short read gives a line of zeros
                data = None if self.headers_only else raw[head:]
                if data and line + 1 == partition.shape.get("lines"):  # a line that was cut off: of each band the pixels it has
                    data = b"".join(data[at : at + 2 * partition.shape["last_samples"]] for at in range(0, len(data), head))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path]), pa.array([line], pa.int64()), pa.array([raw[:head]], pa.binary()), pa.array([data], pa.binary())], ["path", "line", "header", "data"]
                )


@dataclass
class Written(WriterCommitMessage):
    """Files of one attempt: where they are and where they belong, headers last."""
    moves: list[tuple[str, str]]


class CubeWriter(DataSourceArrowWriter):
    """Rows of ``LINE_SCHEMA``; all rows of a folder come to one task, in the order of their lines."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.data_type = int(options.get("datatype", 12))
        self.header = json.loads(options.get("header", "{}"))
        self.attempts = f"{self.root}/{ATTEMPTS}/{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        out = codec.CubeFiles(f"{self.attempts}/{uuid.uuid4().hex}", self.root, self.data_type, self.header)
        with out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.add(**row)
        return Written(out.moves)

    def commit(self, messages) -> None:
        moves = [m for message in messages if message is not None for m in message.moves]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("a folder's lines came to several tasks")
        if not self.overwrite and (there := codec.existing(targets)):
            self.abort(messages)
            raise ValueError(f"{there[0]} exists")
        with ThreadPoolExecutor(16) as pool:
            for last in (False, True):  # data and side files, then the headers that make them cubes
                list(pool.map(lambda m: codec.move(*m), [m for m in moves if m[1].endswith(".hdr") == last]))
        codec.remove_folder(self.attempts)

    def abort(self, messages) -> None:
        codec.remove_folder(self.attempts)


class CubeSource(DataSource):
    """Options: path, bands (JSON list), block, first, last, sequence (false: each file has lines from 0, shapes may differ); for
    writing: path, dataType, header (JSON object)."""

    @classmethod
    def name(cls) -> str:
        return CUBE

    def schema(self) -> str:
        return PIXEL_SCHEMA

    def reader(self, schema) -> CubeReader:
        return CubeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CubeWriter:
        return CubeWriter(dict(self.options), overwrite)


class FrameSource(DataSource):
    """Options: path (a file or a folder), ending (of its frames' names, .bin), samples, bands, block, headersOnly. A last line that
    was cut off, as a header beside the frame tells, has fewer bytes of data."""

    @classmethod
    def name(cls) -> str:
        return FRAME

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))
