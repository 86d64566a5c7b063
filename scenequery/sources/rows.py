"""A row source for Spark: the rows of Parquet files, with columns, a limit and filters pushed into the reading.

    spark.dataSource.register(RowSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.read.format("scene_rows").option("columns", "id,task").option("limit", 100).load(path)

A partition is a row group. Wanted columns that the files lack are left out, as are their bytes; a limit plans only as many row groups
as hold so many rows, and cuts the last; filters on numbers and texts drop row groups by their statistics, and Spark applies them to the
rows. Paths may be any that Arrow's file systems open. All files must have the first one's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from .files import opened


def parquet_files(path: str) -> tuple[object, list[str]]:
    """The file system and the data files of a path, a file or a folder, in the order of their names."""
    from pyarrow import fs

    system, root = opened(path)
    if system.get_file_info(root).is_file:
        return system, [root]
    found = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file]
    return system, sorted(f for f in found if f.endswith(".parquet") and not f.rsplit("/", 1)[-1].startswith(("_", ".")))


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int
    rows: int


class RowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_rows"

    def _wanted(self, names: list[str]) -> list[str]:
        wanted = self.options.get("columns")
        return names if wanted is None else [c for c in (x.strip() for x in wanted.split(",")) if c in names]

    def schema(self) -> T.StructType:
        system, files = parquet_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Parquet files in {self.options['path']}")
        with system.open_input_file(files[0]) as f:
            whole = pq.ParquetFile(f).schema_arrow
        return from_arrow_schema(pa.schema([whole.field(c) for c in self._wanted(whole.names)]), prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        limit = self.options.get("limit")
        return RowReader(self.options["path"], schema.names, None if limit is None else int(limit))


#: Whether a row group whose values lie between low and high may have a row that passes.
_MAY = {
    EqualTo: lambda low, high, x: low <= x <= high, GreaterThan: lambda low, high, x: high > x, GreaterThanOrEqual: lambda low, high, x: high >= x,
    LessThan: lambda low, high, x: low < x, LessThanOrEqual: lambda low, high, x: low <= x, In: lambda low, high, xs: any(low <= x <= high for x in xs),
}


class RowReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], limit: int | None) -> None:
        self.path, self.columns, self.limit, self.filters = path, columns, limit, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Row groups are dropped by these; all are given back, as Spark still has to look at the rows. Under a limit, which comes before filters, none is used."""
        self.filters = [] if self.limit is not None else [f for f in filters if type(f) in _MAY and len(f.attribute) == 1]
        yield from filters

    def _passes(self, group: pq.RowGroupMetaData) -> bool:
        columns = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for f in self.filters:
            held = columns.get(f.attribute[0])
            value = f.value
            if held is not None and held.has_min_max and isinstance(held.min, (int, float, str)):
                kinds = {type(x) for x in (value if isinstance(value, (tuple, list)) else [value])}
                if kinds <= {int, float} and isinstance(held.min, (int, float)) or kinds == {str} and isinstance(held.min, str):
                    if not _MAY[type(f)](held.min, held.max, value):
                        return False
        return True

    def partitions(self) -> list[RowGroup]:
        system, files = parquet_files(self.path)
        out, left = [], self.limit
        for name in files:
            if left == 0:
                break
            with system.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                rows = meta.row_group(g).num_rows if left is None else min(left, meta.row_group(g).num_rows)
                if rows and self._passes(meta.row_group(g)):
                    out.append(RowGroup(name, g, rows))
                left = None if left is None else left - rows
        return out or [RowGroup("", 0, 0)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        left = partition.rows
        if not left:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=min(left, 8192), row_groups=[partition.group], columns=self.columns):
                yield batch.slice(0, left)
                left -= min(left, batch.num_rows)
                if not left:
                    break


def row_source(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a path's Parquet files, of the wanted columns those that there are, and no more than the limit."""
    spark.dataSource.register(RowSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    reader = spark.read.format("scene_rows")
    reader = reader if columns is None else reader.option("columns", ",".join(columns))
    return (reader if limit is None else reader.option("limit", limit)).load(path)
