"""Headers of recordings without their samples: a data source that reads a few hundred bytes of each file.

``spark.dataSource.register(WavHeaders)``, then ``spark.read.format("wav_headers").load(root)``, or ``read_headers``. The
driver lists folders only; each folder is dealt to ``split`` tasks, which list it again and take the files whose names hash to
them, so that neither the driver nor one task holds the files of a folder. A file's chunks are walked by ranged reads,
samples are never read; at most ``most_bytes`` bytes of a file are. Columns are pruned by the schema that is asked for
(``read_headers(..., columns)``): where only names and sizes are wanted, no file is opened. The options ``folders`` and ``names``
are patterns of the kind ``week_*``, in any case, that a file's own folder and its name must fit before it is opened.

Defined cases: files that are no RIFF/WAVE files, are cut short, or need more than ``most_bytes`` bytes have an ``error``, and
the fields known so far; names that begin with ``._`` are left out, as are names that don't fit (``*.wav`` unless given); files that vanish while the
source reads have an error; an empty folder gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, parent string, name string, size long, sampling_rate int, channels int, bits int, format int, duration double, bytes_read int, error string"
#: What a listing knows.
LISTED = {"path", "parent", "name", "size"}
MOST_BYTES, SPLIT = 4096, 8


class Counted:
    """Ranged reads of a file, counted."""

    def __init__(self, file, most: int):
        self.file, self.most, self.count = file, most, 0

    def read(self, at: int, n: int) -> bytes:
        if self.count + n > self.most:
            raise ValueError(f"no samples found in {self.most} bytes")
        self.file.seek(at)
        out = self.file.read(n)
        self.count += len(out)
        if len(out) < n:
            raise ValueError("cut short in the header")
        return out


def header(file: Counted, size: int) -> dict:
    """Fields of a file of that size. A fault is a field of its own, beside those known by then."""
    out: dict = {}
    try:
        first = file.read(0, 12)
        if first[:4] not in (b"RIFF", b"RF64") or first[8:] != b"WAVE":
            raise ValueError("not a RIFF/WAVE file")
        at, rate, long = 12, 0, None
        while True:
            if at + 8 > size:
                raise ValueError("no samples")
            name, n = struct.unpack("<4sI", file.read(at, 8))
            if name == b"ds64":  # sizes beyond 32 bits
                long = struct.unpack("<Q", file.read(at + 16, 8))[0]
            elif name == b"fmt ":
                kind, channels, sampling, rate, _, bits = struct.unpack("<HHIIHH", file.read(at + 8, 16))
                if kind == 0xFFFE and n >= 26:  # the true format stands in the extension
                    kind = struct.unpack("<H", file.read(at + 32, 2))[0]
                out |= {"format": kind, "channels": channels, "sampling_rate": sampling, "bits": bits}
            elif name == b"data":
                if "bits" not in out:
                    raise ValueError("samples before the format")
                n = long if n == 0xFFFFFFFF and long is not None else n
                out["duration"] = n / rate if rate else None
                if at + 8 + n > size:
                    raise ValueError(f"{size - at - 8} of {n} bytes of samples")
                return out
            at += 8 + n + n % 2
    except (ValueError, struct.error) as fault:
        return out | {"error": str(fault)}


@dataclass
class Part(InputPartition):
    folder: str
    part: int

    def __init__(self, folder: str, part: int):
        super().__init__((folder, part))
        self.folder, self.part = folder, part


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.fields = options["path"], schema.fieldNames()
        self.split, self.most = int(options.get("split", SPLIT)), int(options.get("most_bytes", MOST_BYTES))
        self.folders, self.names = options.get("folders", "*").lower(), options.get("names", "*.wav").lower()

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Part]:
        store, at = self._open()
        found, left = [at], [at]
        while left:  # folders only are kept
            below = [x.path for x in store.get_file_info(fs.FileSelector(left.pop())) if x.type == fs.FileType.Directory]
            found += below
            left += below
        return [Part(folder, i) for folder in sorted(found) if fnmatchcase(folder.rsplit("/", 1)[-1].lower(), self.folders) for i in range(self.split)]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = self._open()
        for x in store.get_file_info(fs.FileSelector(partition.folder)):
            name = x.base_name
            if x.type != fs.FileType.File or name.startswith("._") or not fnmatchcase(name.lower(), self.names) or zlib.crc32(name.encode()) % self.split != partition.part:
                continue
            row = {"path": x.path, "parent": partition.folder.rsplit("/", 1)[-1], "name": name, "size": x.size}
            if not LISTED.issuperset(self.fields):
                try:
                    with store.open_input_file(x.path) as file:
                        counted = Counted(file, self.most)
                        row |= header(counted, x.size) | {"bytes_read": counted.count}
                except OSError as fault:
                    row["error"] = str(fault)
            yield tuple(row.get(f) for f in self.fields)


class WavHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(dict(self.options), schema)


def read_headers(spark: SparkSession, root: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Headers of the recordings below a folder; of the given columns only."""
    spark.dataSource.register(WavHeaders)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    chosen = list(kinds) if columns is None else columns
    return spark.read.format("wav_headers").schema(", ".join(f"{c} {kinds[c]}" for c in chosen)).options(**options).load(root)


def _written(frames, root: str):
    import pandas as pd

    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            if path is not None and content is not None:
                where = f"{base}/{path}"
                store.create_dir(where.rsplit("/", 1)[0])
                with store.open_output_stream(where) as out:
                    out.write(content)
        yield pd.DataFrame({"path": frame["path"], "size": frame["content"].map(lambda c: None if c is None else len(c))})


def write_files(files: DataFrame, root: str) -> DataFrame:
    """(path, size) of files (path below root, content) that tasks write; one that is written again is the same."""
    return files.select("path", "content").mapInPandas(lambda frames: _written(frames, root), "path string, size long")
