"""Binary vector files: a header and a flat buffer of 32-bit floats, a row's position being its id.

``read_vectors`` goes through Spark's own file readers, so any path works that Spark can open; files
are its unit of parallel work, and each has to fit in a row, below 2 GiB. The data source "vector_file"
reads row ranges of files of any size, or writes a folder of shard files, through Arrow's file systems: a
plain path that every node has mounted, or an address that they know (file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from simvane.errors import DimensionMismatch, FileSizeMismatch, InvalidHeader
from simvane.operators.vectors import dimension, matrix
from simvane.session import share_path

# Fixed values of the format: little-endian magic, row count and dimension, 8 bytes each.
MAGIC = 0x56454352_53544F52
HEADER = struct.Struct("<QQQ")
SCHEMA = "shard_id int, id long, embedding array<float>"


def encode(vectors: np.ndarray) -> bytes:
    n, dim = vectors.shape
    return HEADER.pack(MAGIC, n, dim) + np.ascontiguousarray(vectors, "<f4").tobytes()


def parse_header(raw: bytes, size: int, path: str = "") -> tuple[int, int]:
    """(rows, dimension), checked: a longer file than the header tells is fine, a shorter one is not."""
    if size < HEADER.size:
        raise FileSizeMismatch(path, HEADER.size, size)
    magic, n, dim = HEADER.unpack(raw[: HEADER.size])
    if magic != MAGIC:
        raise InvalidHeader(path, "not a vector file")
    if size < HEADER.size + 4 * n * dim:
        raise FileSizeMismatch(path, HEADER.size + 4 * n * dim, size)
    return n, dim


def decode(raw: bytes, path: str = "") -> np.ndarray:
    n, dim = parse_header(raw, len(raw), path)
    return np.frombuffer(raw, "<f4", n * dim, HEADER.size).reshape(n, dim)


def _batch(shard: int, first: int, x: np.ndarray) -> pa.RecordBatch:
    n, dim = x.shape
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim) if dim else np.zeros(n + 1, int), pa.int32()), pa.array(np.ascontiguousarray(x, np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(first, first + n)), vectors], ["shard_id", "id", "embedding"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, id, embedding) of vector files named shard_<number>.bin, or of any file as shard 0; ids count in a file."""
    share_path(spark)
    files = spark.read.format("binaryFile").load(path)
    number = F.coalesce(F.regexp_extract("path", r"shard_(\d+)\.bin$", 1).try_cast("int"), F.lit(0))

    def run(batches):
        for b in batches:
            for shard, name, raw in zip(b["shard_id"].to_pylist(), b["path"].to_pylist(), b["content"], strict=True):
                x = decode(raw.as_buffer().to_pybytes(), name)
                for lo in range(0, len(x), 10_000):
                    yield _batch(shard, lo, x[lo : lo + 10_000])

    return files.select(number.alias("shard_id"), "path", "content").mapInArrow(run, SCHEMA)


def located(path: str) -> tuple[files.FileSystem, str]:
    """The file system of an address or plain path, and the path in it."""
    if ":/" in path:
        # Spark writes file:/x, Arrow reads file:///x
        return files.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return files.LocalFileSystem(), path


def _size(fs: files.FileSystem, path: str) -> int | None:
    """A file's bytes, None if there is none."""
    info = fs.get_file_info(path)
    return info.size if info.is_file else None


def header(fs: files.FileSystem, path: str) -> tuple[int, int]:
    with fs.open_input_file(path) as f:
        return parse_header(f.read(HEADER.size), f.size(), path)


def discover(folder: str) -> list[str]:
    """shard_0.bin, shard_1.bin and so on up to the first gap, as paths of the folder's file system; all must have one dimension."""
    fs, root = located(folder)
    found: list[str] = []
    while _size(fs, name := f"{root}/shard_{len(found)}.bin") is not None:
        found.append(name)
    dims = {name: header(fs, name)[1] for name in found}
    for name in found[1:]:
        if dims[name] != dims[found[0]]:
            raise DimensionMismatch(dims[found[0]], dims[name])
    return found


class Range(InputPartition):
    def __init__(self, path: str, shard: int, first: int, last: int, dim: int):
        super().__init__((path, shard, first, last, dim))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsPerPartition", 1_000_000))

    def partitions(self) -> list[Range]:
        fs, path = located(self.path)
        names = discover(self.path) if fs.get_file_info(path).type == files.FileType.Directory else [path]
        out = []
        for shard, name in enumerate(names):
            n, dim = header(fs, name)
            out += [Range(name, shard, lo, min(n, lo + self.rows), dim) for lo in range(0, max(n, 1), self.rows)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, shard, first, last, dim = partition.value
        with located(self.path)[0].open_input_file(path) as f:
            f.seek(HEADER.size + 4 * dim * first)
            for lo in range(first, last, 10_000):
                n = min(10_000, last - lo)
                yield _batch(shard, lo, np.frombuffer(f.read(4 * n * dim), "<f4").reshape(n, dim))


class Written(WriterCommitMessage):
    def __init__(self, partition: int, path: str, rows: int):
        self.partition, self.path, self.rows = partition, path, rows


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its own; the commit names those with rows shard_0.bin and so on, in the tasks' order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        name, rows, dim = f"{root}/.part-{task.partitionId()}-{task.taskAttemptId()}", 0, 0
        # the header tells the rows, which are known at the end: they wait in the task's scratch file
        with tempfile.TemporaryFile() as scratch:
            for b in iterator:
                if not len(b):
                    continue
                column = b["embedding"]
                sizes = set(np.diff(column.offsets.to_numpy()).tolist())
                if column.null_count or len(sizes) != 1 or dim not in (0, *sizes):
                    raise DimensionMismatch(dim or min(sizes), max(sizes))
                dim = sizes.pop()
                scratch.write(matrix(column, dim).astype("<f4").tobytes())
                rows += len(b)
            scratch.seek(0)
            with fs.open_output_stream(name) as f:
                f.write(HEADER.pack(MAGIC, rows, dim))
                while part := scratch.read(1 << 22):
                    f.write(part)
        return Written(task.partitionId(), name, rows)

    def commit(self, messages: list[Written]) -> None:
        fs, root = located(self.path)
        if self.overwrite:
            for old in fs.get_file_info(files.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("shard_") and old.base_name.endswith(".bin"):
                    fs.delete_file(old.path)
        first, number = len(discover(self.path)), 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            if m.rows:
                fs.move(m.path, f"{root}/shard_{first + number}.bin")
                number += 1
            else:
                fs.delete_file(m.path)

    def abort(self, messages: list[Written]) -> None:
        fs, _ = located(self.path)
        for m in messages:
            if m and _size(fs, m.path) is not None:
                fs.delete_file(m.path)


class VectorFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    share_path(spark)
    spark.dataSource.register(VectorFileSource)


#: Rows that one written file is meant to hold.
FILE_ROWS = 1_000_000


def write_vectors(vectors: DataFrame, folder: str, shards: int | None = None) -> None:
    """Writes (id, embedding) in the order of ids to ``shards`` files at most, over what the folder held; each task writes one.

    Without ``shards`` there are as many as give each FILE_ROWS rows or fewer.
    """
    dimension(vectors)
    register(vectors.sparkSession)
    own = vectors.select("id", "embedding")
    shards = shards or max(1, -(-own.count() // FILE_ROWS))
    ordered = own.repartitionByRange(shards, "id") if shards > 1 else own.coalesce(1)
    ordered.sortWithinPartitions("id").write.format("vector_file").mode("overwrite").save(folder)
