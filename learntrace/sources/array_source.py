"""Array files (.npy, .npz) as a Spark data source: read by ranges of rows, written in place by many tasks.

Reading: the driver reads headers alone. A partition is a range of rows, and reads of each member that the schema names its own
bytes; filters on ``pos`` leave out ranges before any is read. Members of different lengths stand side by side,
null beyond their ends. Members that are compressed cannot be entered in the middle and are one partition.

Writing: rows carry their place ``pos``. The file's layout follows from the number of rows, so the driver lays out a new file next to
the target and every task writes its rows where they belong; a task that comes again writes the same bytes. The commit
checks that the tasks' rows cover the file once, joins their checksums, which the .npz format asks for, and renames the file; an abort deletes
it. So a killed task or job never leaves half a file under the target's name. The folder has to be shared by driver and executors, with
writes in the middle of files; other stores are read alone.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "arrays"
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 1 << 16
LOCAL_HEADER = 30
#: Types of columns by the kind of numbers.
KINDS = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType()}
WIDE = {"bigint": "<i8", "double": "<f8", "boolean": "|b1"}


@dataclass(frozen=True)
class Member:
    """An array in a file: where its numbers start (None: compressed), their type and its shape."""

    name: str
    start: int | None
    dtype: str
    shape: tuple[int, ...]

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * self.width

    @property
    def column(self) -> T.DataType:
        kind = KINDS.get(np.dtype(self.dtype).kind)
        if kind is None:
            raise ValueError(f"{self.name}: no column type for {self.dtype}")
        return kind if len(self.shape) < 2 else T.ArrayType(kind)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for reads in the middle."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _header(f: io.IOBase) -> tuple[str, tuple[int, ...]]:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or fortran and len(shape) > 1:
        raise ValueError("arrays of objects or in columns' order are not read")
    return dtype.str, shape


def members(path: str) -> list[Member]:
    """The arrays of a file, from its headers."""
    with opened(path) as f:
        if path.endswith(".npy"):
            dtype, shape = _header(f)
            return [Member("value", f.tell(), dtype, shape)]
        found = []
        with zipfile.ZipFile(f) as z:
            for info in z.infolist():
                with z.open(info) as m:
                    dtype, shape = _header(m)
                    before = m.tell()
                f.seek(info.header_offset)
                name, extra = struct.unpack("<HH", f.read(LOCAL_HEADER)[26:30])
                stored = info.compress_type == zipfile.ZIP_STORED
                found.append(Member(info.filename.removesuffix(".npy"), info.header_offset + LOCAL_HEADER + name + extra + before if stored else None, dtype, shape))
        return found


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class ArrayReader(DataSourceReader):
    """Ranges of rows of the members that the schema names."""

    def __init__(self, path: str, schema: T.StructType, partition_rows: int | None) -> None:
        self.path, self.names = path, schema.names
        known = {m.name: m for m in members(path)}
        missing = [n for n in schema.names if n != "pos" and n not in known]
        if missing:
            raise ValueError(f"{path} has no {missing}; it has {sorted(known)}")
        self.chosen = [known[n] for n in schema.names if n != "pos"] or list(known.values())
        self.first, self.end = 0, max(m.rows for m in self.chosen)
        widest = max(1, sum(m.row_bytes for m in self.chosen))
        self.step = partition_rows or max(1, PARTITION_BYTES // widest)
        if any(m.start is None for m in self.chosen):
            self.step = max(1, self.end)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of ``pos`` become the range that is read; all other filters are left to Spark."""
        for f in filters:
            at = getattr(f, "attribute", None) == ("pos",)
            value = getattr(f, "value", None)
            if not at or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or not isinstance(value, int):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.end = min(self.end, value + (not isinstance(f, LessThan)))

    def partitions(self) -> list[InputPartition]:
        return [Rows(at, min(at + self.step, self.end)) for at in range(self.first, self.end, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            held = {m.name: self._whole(f, m) for m in self.chosen if m.start is None and partition.first < partition.end}
            for at in range(partition.first, partition.end, BATCH_ROWS):
                end = min(at + BATCH_ROWS, partition.end)
                columns = {"pos": pa.array(np.arange(at, end))}
                columns |= {m.name: _column(m, held[m.name][at:end] if m.name in held else self._range(f, m, at, end), end - at) for m in self.chosen}
                yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)

    @staticmethod
    def _range(f: pa.NativeFile, m: Member, at: int, end: int) -> np.ndarray:
        end = min(end, m.rows)
        if end <= at:
            return np.empty(0, dtype=m.dtype).reshape(0, m.width)
        f.seek(m.start + at * m.row_bytes)
        return np.frombuffer(f.read((end - at) * m.row_bytes), dtype=m.dtype).reshape(end - at, m.width)

    @staticmethod
    def _whole(f: pa.NativeFile, m: Member) -> np.ndarray:
        f.seek(0)
        with zipfile.ZipFile(f) as z, z.open(f"{m.name}.npy") as one:
            return np.lib.format.read_array(one, allow_pickle=False).reshape(m.rows, m.width)


def _column(m: Member, rows: np.ndarray, n: int) -> pa.Array:
    """Values as the column's type, null from the member's end on."""
    kind = m.column
    plain = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[(kind.elementType if isinstance(kind, T.ArrayType) else kind).simpleString()]
    native = rows.astype(rows.dtype.newbyteorder("="), copy=False)
    if isinstance(kind, T.ArrayType):
        flat = pa.array(native.ravel()).cast(plain)
        found = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.width), flat)
    else:
        found = pa.array(native[:, 0]).cast(plain)
    return found if len(rows) == n else pa.concat_arrays([found, pa.nulls(n - len(rows), found.type)])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the one of CRC-32, highest power in the lowest bit."""
    product = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two stretches of bytes from their own, ``size`` being the second's length."""
    power, base = 1 << 31, 1 << 23  # x^0 and x^8
    while size:
        power = _times(power, base) if size & 1 else power
        base, size = _times(base, base), size >> 1
    return _times(power, first) ^ second


@dataclass
class Written(WriterCommitMessage):
    """Stretches of rows that a task wrote: (first, rows, the columns' checksums)."""

    stretches: list[tuple[int, int, tuple[int, ...]]]


@dataclass(frozen=True)
class Layout:
    """Where a file of ``rows`` rows has its columns: (name, type, header, start of its header, start of its numbers)."""

    columns: tuple[tuple[str, str, bytes, int, int], ...]
    rows: int
    size: int
    zipped: bool


def laid_out(names: list[str], kinds: list[str], rows: int, zipped: bool) -> Layout:
    columns, at = [], 0
    for name, kind in zip(names, kinds, strict=True):
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": WIDE[kind], "fortran_order": False, "shape": (rows,)})
        start = at + (LOCAL_HEADER + len(f"{name}.npy".encode()) + 20 if zipped else 0)
        columns.append((name, WIDE[kind], head.getvalue(), at, start + len(head.getvalue())))
        at = start + len(head.getvalue()) + rows * np.dtype(WIDE[kind]).itemsize
    return Layout(tuple(columns), rows, at, zipped)


def _zip_tail(layout: Layout, checksums: list[int]) -> tuple[list[tuple[int, bytes]], bytes]:
    """Each member's header with its place, and the directory at the end of the file, with sizes of 64 bits."""
    heads, directory, full = [], b"", 0xFFFFFFFF
    for (name, dtype, head, at, _), crc in zip(layout.columns, checksums, strict=True):
        file, size = f"{name}.npy".encode(), len(head) + layout.rows * np.dtype(dtype).itemsize
        heads.append((at, struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0x21, crc, full, full, len(file), 20) + file + struct.pack("<HHQQ", 1, 16, size, size)))
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0x21, crc, full, full, len(file), 28, 0, 0, 0, 0, full) + file + struct.pack("<HHQQQ", 1, 24, size, size, at)
    n, at = len(layout.columns), layout.size
    end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    return heads, directory + end + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, min(len(directory), full), full, 0)


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, rows: int, overwrite: bool) -> None:
        path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        names = [f.name for f in schema.fields if f.name != "pos"]
        kinds = [f.dataType.simpleString() for f in schema.fields if f.name != "pos"]
        if "pos" not in schema.names or not names or set(kinds) - set(WIDE):
            raise ValueError(f"rows to write have a pos and columns of {sorted(WIDE)}, not {schema.simpleString()}")
        if not path.endswith((".npy", ".npz")) or path.endswith(".npy") and len(names) > 1:
            raise ValueError(f"{path}: one column goes to a .npy file, any number to a .npz file")
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} is there already")
        self.path, self.layout = path, laid_out(names, kinds, rows, path.endswith(".npz"))
        self.draft = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.writing-{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(self.draft, "wb") as f:
            f.truncate(self.layout.size)
            for _, _, head, _, start in self.layout.columns:
                f.seek(start - len(head))
                f.write(head)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows, each stretch of following places by one write a column."""
        stretches: list[tuple[int, int, tuple[int, ...]]] = []
        with open(self.draft, "r+b") as f:
            for batch in iterator:
                pos = batch.column("pos").to_numpy()
                values = [self._numbers(batch.column(name), dtype) for name, dtype, *_ in self.layout.columns]
                cuts = np.flatnonzero(np.diff(pos) != 1) + 1
                for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(pos)].tolist(), strict=True):
                    if a == b:
                        continue
                    first, crcs = int(pos[a]), []
                    if first < 0 or first + b - a > self.layout.rows:
                        raise ValueError(f"row {first} lies outside of {self.layout.rows} rows")
                    going = stretches and stretches[-1][0] + stretches[-1][1] == first
                    for k, (_, dtype, _, _, start) in enumerate(self.layout.columns):
                        data = values[k][a:b].tobytes()
                        f.seek(start + first * np.dtype(dtype).itemsize)
                        f.write(data)
                        crcs.append(zlib.crc32(data, stretches[-1][2][k] if going else 0))
                    if going:
                        stretches[-1] = (stretches[-1][0], stretches[-1][1] + b - a, tuple(crcs))
                    else:
                        stretches.append((first, b - a, tuple(crcs)))
        return Written(stretches)

    @staticmethod
    def _numbers(column: pa.Array, dtype: str) -> np.ndarray:
        if column.null_count and dtype != "<f8":
            raise ValueError("a null has no whole number")
        return column.to_numpy(zero_copy_only=False).astype(dtype)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            parts = sorted(s for m in messages if m is not None for s in m.stretches)
            at = 0
            checksums = [zlib.crc32(head) for _, _, head, _, _ in self.layout.columns]
            for first, n, crcs in parts:
                if first != at:
                    raise ValueError(f"rows {min(first, at)} to {max(first, at) - 1} of {self.path} were written {'twice' if first < at else 'by no task'}")
                at += n
                checksums = [joined_crc(old, new, n * np.dtype(c[1]).itemsize) for old, new, c in zip(checksums, crcs, self.layout.columns, strict=True)]
            if at != self.layout.rows:
                raise ValueError(f"{at} rows of {self.layout.rows} were written to {self.path}")
            if self.layout.zipped:
                heads, tail = _zip_tail(self.layout, checksums)
                with open(self.draft, "r+b") as f:
                    for place, head in (*heads, (self.layout.size, tail)):
                        f.seek(place)
                        f.write(head)
            os.replace(self.draft, self.path)
        except Exception:
            self.abort(messages)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class ArrayFiles(DataSource):
    """``spark.read.format("arrays").load(path)`` and ``df.write.format("arrays").option("rows", n).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("pos", T.LongType()), *[T.StructField(m.name, m.column) for m in members(self.options["path"])]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        rows = self.options.get("partitionRows")
        return ArrayReader(self.options["path"], schema, int(rows) if rows else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(self.options["path"], schema, int(self.options["rows"]), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters on ``pos`` reaching the reader."""
    spark.dataSource.register(ArrayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_arrays(spark: SparkSession, path: str, columns: list[str] | None = None, partition_rows: int | None = None) -> DataFrame:
    """``pos`` and the named members (None: all) of an array file. Only what is named is read."""
    register(spark)
    reader = spark.read.format(FORMAT)
    if partition_rows is not None:
        reader = reader.option("partitionRows", partition_rows)
    if columns is not None:
        known = {m.name: m for m in members(path)}
        missing = [c for c in columns if c not in known]
        if missing:
            raise ValueError(f"{path} has no {missing}; it has {sorted(known)}")
        reader = reader.schema(T.StructType([T.StructField("pos", T.LongType()), *[T.StructField(c, known[c].column) for c in columns]]))
    return reader.load(path)


def write_arrays(rows: DataFrame, path: str, pos: str = "pos", overwrite: bool = True) -> None:
    """Rows with places 0, 1, 2, ... as one array file, a member a column. Places that miss or repeat are a ValueError."""
    register(rows.sparkSession)
    n = rows.count()
    dealt = rows.withColumnRenamed(pos, "pos").withColumn("pos", F.col("pos").cast("long")).repartitionByRange("pos").sortWithinPartitions("pos")
    dealt.write.format(FORMAT).option("rows", n).mode("overwrite" if overwrite else "append").save(path)
