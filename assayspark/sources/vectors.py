"""One vector per ``.npy`` file: a data source that plans its partitions by file sizes, and the sink for it.

    spark.dataSource.register(VectorFiles)
    spark.read.format("npy").load(folder)             # name, vector, problem

The planner lists the folder (or takes listed paths) and packs neighbouring files into partitions of
about ``bytesPerPartition``; a task opens only its own files. A file that cannot be read, or is no
one-dimensional array of numbers, is a row with a null vector and the reason in ``problem``. Files are
reached through pyarrow, so local, mounted and object-store paths work where its drivers do; for
stores that only Spark can open, ``read_through_spark`` decodes the same format from Spark's own file
scan, which plans partitions by size as well.
"""

from __future__ import annotations

import ast
import posixpath
import struct
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x93NUMPY"  # fixed value: the signature of the format
SUFFIX = ".npy"
SCHEMA = "name string, vector array<float>, problem string"
PARTITION_BYTES = 16 << 20
OPEN_COST = 4096  # what a file counts beside its bytes
ROWS_PER_BATCH = 256

# Planning runs in a process beside the driver, which does not get the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decode(data: bytes) -> np.ndarray:
    """The one-dimensional numeric array of a file, as 32-bit floats; ``ValueError`` tells what is wrong."""
    if data[:6] != MAGIC:
        raise ValueError("no .npy signature" if data else "empty file")
    wide = len(data) > 6 and data[6] >= 2
    lead = 12 if wide else 10
    if len(data) < lead:
        raise ValueError("header cut short")
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    try:
        header = ast.literal_eval(data[lead : lead + size].decode("utf-8" if data[6] >= 3 else "latin-1"))
        shape, kind = header["shape"], np.dtype(header["descr"])
    except (ValueError, SyntaxError, KeyError, TypeError, UnicodeDecodeError) as error:
        raise ValueError(f"header not understood: {type(error).__name__}") from None
    if kind.kind not in "fiu":
        raise ValueError(f"not numbers: {kind}")
    if len([n for n in shape if n != 1]) > 1:
        raise ValueError(f"not one vector: shape {shape}")
    values = data[lead + size :]
    if len(values) != kind.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{len(values)} bytes of data for shape {shape}")
    return np.frombuffer(values, dtype=kind).astype(np.float32)


def encode(vector: Sequence[float]) -> bytes:
    """A vector of 32-bit floats as the bytes of a file, version 1 of the format."""
    values = np.asarray(vector, dtype="<f4")
    header = str({"descr": "<f4", "fortran_order": False, "shape": (len(values),)}).encode()
    header += b" " * (-(len(header) + 11) % 64) + b"\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(header)) + header + values.tobytes()


def _batch(names: list[str], files: Iterator[bytes | Exception]) -> pa.RecordBatch:
    vectors, problems = [], []
    for data in files:
        try:
            if isinstance(data, Exception):
                raise data
            vectors.append(decode(data))
            problems.append(None)
        except (ValueError, OSError) as error:
            vectors.append(None)
            problems.append("missing" if isinstance(error, FileNotFoundError) else str(error)[:200])
    arrays = [pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float32())), pa.array(problems, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["name", "vector", "problem"])


def _open(path: str):
    """The pyarrow file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def stem(path: str) -> str:
    return posixpath.basename(path).removesuffix(SUFFIX)


@dataclass
class FileShare(InputPartition):
    """Neighbouring files and what they hold together."""

    paths: tuple[str, ...]
    size: int


def plan(files: Sequence[tuple[str, int]], per_partition: int) -> list[FileShare]:
    """Files in order, in shares of at most ``per_partition`` bytes; a larger file has a share of its own."""
    shares, paths, size = [], [], 0
    for path, own in files:
        if paths and size + own + OPEN_COST > per_partition:
            shares.append(FileShare(tuple(paths), size))
            paths, size = [], 0
        paths.append(path)
        size += own + OPEN_COST
    return [*shares, FileShare(tuple(paths), size)] if paths else shares


class VectorFiles(DataSource):
    """``name`` (the file's without its suffix), ``vector`` and ``problem`` of every ``.npy`` file below a folder.

    Options: ``path``; ``names``, one per line, to read just these (a missing one is reported); ``bytesPerPartition``.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options)


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a folder is needed")
        self.names = [n for n in options.get("names", "").split("\n") if n] if "names" in options else None
        self.per_partition = int(options.get("bytesPerPartition", PARTITION_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.path)
        if self.names is None:
            found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(SUFFIX)]
        else:
            found = system.get_file_info([f"{root.rstrip('/')}/{n}{SUFFIX}" for n in self.names])
        return plan(sorted((f.path, f.size or 0) for f in found), self.per_partition) or [FileShare((), 0)]

    def read(self, partition: FileShare) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)

        def load(path: str) -> bytes | Exception:
            try:
                with system.open_input_stream(path) as file:
                    return file.read()
            except OSError as error:
                return error

        for first in range(0, len(partition.paths), ROWS_PER_BATCH):
            paths = partition.paths[first : first + ROWS_PER_BATCH]
            yield _batch([stem(p) for p in paths], map(load, paths))


def read_vectors(spark: SparkSession, folder: str, names: Sequence[str] | None = None, bytes_per_partition: int = PARTITION_BYTES) -> DataFrame:
    """name, vector and problem of the vector files below a folder, or of the named ones."""
    spark.dataSource.register(VectorFiles)
    reader = spark.read.format("npy").option("bytesPerPartition", bytes_per_partition)
    return (reader if names is None else reader.option("names", "\n".join(names))).load(folder)


def read_through_spark(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows from Spark's own scan of the files, for stores that Python has no driver for.

    Files without a byte, which that scan passes over, have no row here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(first, ROWS_PER_BATCH)
                yield _batch([stem(p) for p in part.column(0).to_pylist()], iter(part.column(1).to_pylist()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def write_vectors(df: DataFrame, name: str, vector: str, folder: str) -> None:
    """One file per row that has both. A file appears whole, by renaming, so a task that runs again does no harm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        written = 0
        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as file:
                    file.write(encode(values.values.to_numpy(zero_copy_only=False)))
                system.move(draft, f"{root}/{key}{SUFFIX}")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    rows = df.where(F.col(name).isNotNull() & F.col(vector).isNotNull())
    rows.select(F.col(name).cast("string"), F.col(vector).cast("array<float>")).mapInArrow(run, "written bigint").agg(F.sum("written")).collect()
