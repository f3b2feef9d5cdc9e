"""The data source blob: an archive's items with their bytes, one task for each bin.

It has no filters, as Python data sources see none; Archive.read() filters the index before bytes are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ..schemas import CORE
from .archive import index_path
from .ranges import Ranges

SCHEMA = StructType([*CORE.fields, StructField("payload", BinaryType())])


@dataclass
class _Bin(InputPartition):
    number: int


class Blob(DataSource):
    """spark.read.format("blob").load(folder of an archive)."""

    @classmethod
    def name(cls) -> str:
        return "blob"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _index(self) -> ds.Dataset:
        return ds.dataset(index_path(self.path), format="parquet", exclude_invalid_files=False)

    def partitions(self) -> list[_Bin]:
        numbers: set[int] = set()
        for batch in self._index().to_batches(columns=["bin_index"]):
            numbers.update(pc.unique(batch.column(0)).to_pylist())
        return [_Bin(n) for n in sorted(numbers)]

    def read(self, partition: _Bin) -> Iterator[pa.RecordBatch]:
        arrow, ranges = to_arrow_schema(SCHEMA), Ranges()
        table = self._index().to_table(columns=CORE.names, filter=pc.field("bin_index") == partition.number).sort_by("start_byte")
        rows: list[dict] = []
        held = 0
        for row in table.to_pylist():
            row["payload"] = ranges.read(row["path"], row["start_byte"], row["end_byte"])
            rows.append(row)
            held += len(row["payload"])
            if held >= 16 << 20 or len(rows) >= 1024:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)
        ranges.close()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Blob)
