"""One- and two-dimensional .npy files as a Spark data source, read by byte ranges: path, row, col, value.

    spark.dataSource.register(Arrays)
    spark.read.format("npyrows").option("rank", 2).load("folder/*.npy")

Options: ``rank``, the number of dimensions that every file must have; ``finite``, true to fail on NaN and infinities (else NaN is missing);
``rangebytes``, the size of a partition (64 MB). Rows of a file in column order come out column by column. Booleans, whole and floating
point numbers are read; pickled objects never are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .interleaved import BATCH, _store, matching

SCHEMA = "path string, row bigint, col bigint, value double"
#: Bytes that hold any header of a numeric array.
HEADER = 1 << 16


def header(path: str) -> tuple[tuple[int, ...], bool, str, int]:
    """Shape, whether in column order, type and where the numbers begin."""
    import numpy as np

    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        raw = io.BytesIO(f.read(HEADER))
    try:
        version = np.lib.format.read_magic(raw)
        shape, columns, kind = np.lib.format.read_array_header_1_0(raw) if version == (1, 0) else np.lib.format.read_array_header_2_0(raw)
    except ValueError as e:
        raise ValueError(f"{path} is no array: {e}") from e
    if kind.kind not in "biuf":
        raise ValueError(f"{path} holds {kind}, not numbers")
    return shape, columns and len(shape) > 1, kind.str, raw.tell()


@dataclass
class Stretch(InputPartition):
    path: str
    kind: str
    begin: int
    first: int
    lines: int
    width: int
    columns: bool

    def __init__(self, path: str, kind: str, begin: int, first: int, lines: int, width: int, columns: bool):
        self.path, self.kind, self.begin, self.first, self.lines, self.width, self.columns = path, kind, begin, first, lines, width, columns


class Lines(DataSourceReader):
    def __init__(self, options):
        self.path, self.rank = options["path"], options.get("rank")
        self.finite = str(options.get("finite", "false")).lower() == "true"
        self.range_bytes = int(options.get("rangebytes", 64 << 20))

    def partitions(self) -> list[Stretch]:
        import numpy as np

        files = matching(self.path)
        if not files:
            raise FileNotFoundError(f"no array matches {self.path}")
        out = []
        for path, size in files:
            shape, columns, kind, begin = header(path)
            if len(shape) not in (1, 2) or self.rank is not None and len(shape) != int(self.rank):
                raise ValueError(f"{path} has {len(shape)} dimensions, not {self.rank or '1 or 2'}")
            shape = shape if len(shape) == 2 else (1, *shape)
            lines, width = (shape[1], shape[0]) if columns else shape
            item = np.dtype(kind).itemsize
            if size < begin + lines * width * item:
                raise ValueError(f"{path} is cut off: {size} bytes")
            if lines == 1:  # a single line is cut across
                step = max(1, self.range_bytes // item)
                out += [Stretch(path, kind, begin + lo * item, lo, 0, min(step, width - lo), columns) for lo in range(0, width, step)]
            else:
                step = max(1, self.range_bytes // max(1, width * item))
                out += [Stretch(path, kind, begin + lo * width * item, lo, min(step, lines - lo), width, columns) for lo in range(0, lines, step)]
        return out

    def read(self, p: Stretch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not isinstance(p, Stretch):  # arrays without values have no stretches
            return
        kind = np.dtype(p.kind)
        n = p.width * max(1, p.lines)
        store, inner = _store(p.path)
        with store.open_input_file(inner) as f:
            f.seek(p.begin)
            for lo in range(0, n, BATCH):
                m = min(BATCH, n - lo)
                x = np.frombuffer(f.read(m * kind.itemsize), dtype=kind).astype(float)
                if self.finite and not np.isfinite(x).all():
                    raise ValueError(f"{p.path} holds values that are not finite")
                at = np.arange(lo, lo + m)
                line, place = (np.zeros(m, dtype=int), p.first + at) if p.lines == 0 else (p.first + at // p.width, at % p.width)
                row, col = (place, line) if p.columns else (line, place)
                name = pa.array([p.path]).take(pa.array(np.zeros(m, dtype="int64")))
                yield pa.RecordBatch.from_arrays([name, pa.array(row.astype("int64")), pa.array(col.astype("int64")), pa.array(x, mask=np.isnan(x))], names=["path", "row", "col", "value"])


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npyrows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Lines(self.options)


def read_array(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, row, col, value of all arrays that a path, folder or glob matches; see the module's options. A file may have any size."""
    spark.dataSource.register(Arrays)
    return spark.read.format("npyrows").options(**{k: str(v) for k, v in options.items()}).load(path)
