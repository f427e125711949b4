"""Interleaved recordings of 64-bit samples as a Spark data source: read by byte ranges, written by partition.

    spark.dataSource.register(Interleaved)
    spark.read.format("interleaved").option("labels", "channels.csv").option("rate", 1000).load("folder/recording*")

Options: ``labels``, a comma-separated file of channel names beside the recordings (or a full path), or ``channels``, their number, which
wins and names them 0, 1, ...; ``rate`` in samples a second (1000); ``rangebytes``, the size of a partition (64 MB); ``first``, true to read the
first matching file alone; ``wide``, true for rows of a sample with its channels side by side (path, sample, t_s and a column a channel), which lie
side by side in the file too, so nothing is shuffled. Filters on ``channel`` reach the reader, so that only the wanted columns of a range are copied.

A recording that broke off ends with a part of a sample, which is dropped. One with fewer values than channels is an error.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "path string, sample bigint, t_s double, channel string, volts double"
VALUE = 8
#: Rows of a batch that the reader hands on.
BATCH = 1 << 17


def _store(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def matching(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a glob, a folder or a path stands for, by name."""
    from pyarrow import fs

    store, inner = _store(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner) if not re.search(r"[*?\[]", inner) else None
    if info is not None and info.type == fs.FileType.File:
        return [(path, info.size)]
    if info is not None and info.type == fs.FileType.NotFound:
        return []
    fixed = inner if info is not None else posixpath.dirname(re.split(r"[*?\[]", inner)[0])
    pattern = posixpath.join(inner, "*") if info is not None else inner
    depth = pattern.count("/")
    found = store.get_file_info(fs.FileSelector(fixed or ".", recursive="/" in pattern[len(fixed) + 1 :], allow_not_found=True))
    files = [f for f in found if f.type == fs.FileType.File and f.path.count("/") == depth and fnmatch.fnmatchcase(f.path, pattern)]
    return sorted((prefix + f.path, f.size) for f in files if not posixpath.basename(f.path).startswith(("_", ".")))


def read_labels(path: str) -> list[str]:
    """Channel names of a comma-separated file, in one line or one to a line."""
    store, inner = _store(path)
    with store.open_input_stream(inner) as f:
        names = [x.strip() for x in re.split(r"[,\r\n]+", f.read().decode()) if x.strip()]
    if not names:
        raise ValueError(f"{path} names no channel")
    return names


def is_wide(options) -> bool:
    return str(options.get("wide", "false")).lower() == "true"


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    samples: int

    def __init__(self, path: str, first: int, samples: int):
        self.path, self.first, self.samples = path, first, samples


class Ranges(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rate = float(options.get("rate", 1000))
        if not self.rate > 0:
            raise ValueError("rate must be greater than zero")
        n = options.get("channels")
        if n is not None and int(n) < 1:
            raise ValueError("channels must be at least 1")
        labels = options.get("labels")
        if n is None and labels is None:
            raise ValueError("a recording has labels or a number of channels")
        if n is None:
            path = labels if "/" in labels else posixpath.join(posixpath.dirname(self.path), labels)
            if not matching(path):
                raise FileNotFoundError(f"there is no channel file {path}, and no number of channels")
            self.names = read_labels(path)
        else:
            self.names = [str(i) for i in range(int(n))]
        self.wanted = list(range(len(self.names)))
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.first = str(options.get("first", "false")).lower() == "true"
        self.wide = is_wide(options)
        if self.wide and len({x.lower() for x in ("path", "sample", "t_s", *self.names)}) < 3 + len(self.names):
            raise ValueError(f"channels side by side need names of their own, not {self.names}")

    def pushFilters(self, filters) -> Iterator:
        """Takes what picks channels; all else stays with Spark."""
        for f in filters:
            values = None if self.wide else (f.value,) if isinstance(f, EqualTo) and f.attribute == ("channel",) else f.value if isinstance(f, In) and f.attribute == ("channel",) else None
            if values is None:
                yield f
            else:
                self.wanted = [i for i in self.wanted if self.names[i] in values]

    def partitions(self) -> list[Stretch]:
        files = matching(self.path)
        if not files:
            raise FileNotFoundError(f"no recording matches {self.path}")
        width = VALUE * len(self.names)
        step = max(1, self.range_bytes // width)
        out = []
        for path, size in files[:1] if self.first else files:
            samples = size // width
            if samples == 0:
                raise ValueError(f"{path} has {size // VALUE} values, fewer than its {len(self.names)} channels")
            out += [Stretch(path, lo, min(step, samples - lo)) for lo in range(0, samples, step)]
        return out

    def read(self, partition: Stretch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, wanted = len(self.names), self.wanted
        if not wanted:
            return
        store, inner = _store(partition.path)
        per = max(1, BATCH // len(wanted))
        names = pa.array([self.names[i] for i in wanted])
        with store.open_input_file(inner) as f:
            f.seek(partition.first * n * VALUE)
            for lo in range(partition.first, partition.first + partition.samples, per):
                m = min(per, partition.first + partition.samples - lo)
                x = np.frombuffer(f.read(m * n * VALUE), dtype="<f8").reshape(m, n)
                if self.wide:
                    at = np.arange(lo, lo + m)
                    columns = [pa.array([partition.path]).take(pa.array(np.zeros(m, dtype="int64"))), pa.array(at), pa.array(at / self.rate), *(pa.array(np.ascontiguousarray(v)) for v in x.T)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "sample", "t_s", *self.names])
                    continue
                at = np.repeat(np.arange(lo, lo + m), len(wanted))
                columns = [pa.array([partition.path]).take(pa.array(np.zeros(len(at), dtype="int64"))), pa.array(at), pa.array(at / self.rate), names.take(pa.array(np.tile(np.arange(len(wanted)), m))), pa.array(x[:, wanted].ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "sample", "t_s", "channel", "volts"])


class Files(DataSourceWriter):
    """Each task writes its rows as one recording; the columns of numbers are the channels. What a failed job wrote is removed."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        if overwrite:
            raise ValueError("recordings are never overwritten")
        odd = [f.name for f in schema if not isinstance(f.dataType, T.NumericType)]
        if odd:
            raise ValueError(f"only numbers can be recorded, not {odd}")
        self.path, self.names = options["path"].rstrip("/"), schema.names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import numpy as np

        target = f"{self.path}/recording-{uuid.uuid4().hex}.bin"
        store, inner = _store(target)
        store.create_dir(posixpath.dirname(inner), recursive=True)
        held, n = [], 0
        with store.open_output_stream(inner) as f:
            for row in rows:
                held.append([float("nan") if v is None else float(v) for v in row])
                n += 1
                if len(held) == 1 << 14:
                    f.write(np.array(held, dtype="<f8").tobytes())
                    held = []
            f.write(np.array(held, dtype="<f8").tobytes())
        if n == 0:  # nothing to tell of: a recording has a sample at least
            store.delete_file(inner)
            target = ""
        out = WriterCommitMessage()
        out.path = target
        return out

    def commit(self, messages: list) -> None:
        store, inner = _store(f"{self.path}/channels.csv")
        store.create_dir(posixpath.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            f.write((",".join(self.names) + "\n").encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                store, inner = _store(m.path)
                store.delete_file(inner)


class Interleaved(DataSource):
    @classmethod
    def name(cls) -> str:
        return "interleaved"

    def schema(self) -> str:
        if not is_wide(self.options):
            return SCHEMA
        return ", ".join(["path string, sample bigint, t_s double", *(f"`{x.replace('`', '``')}` double" for x in Ranges(self.options).names)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Ranges(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Files(self.options, schema, overwrite)


def read_recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, sample, t_s, channel, volts (``wide``: path, sample, t_s and the channels) of all recordings that a path, folder or glob matches; see the module's options."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Interleaved)
    return spark.read.format("interleaved").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_recordings(df: DataFrame, path: str) -> None:
    """One recording of each partition of df, whose numeric columns are the channels, and the file of their names."""
    df.sparkSession.dataSource.register(Interleaved)
    df.write.format("interleaved").mode("append").save(path)
