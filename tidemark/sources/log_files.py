"""Stored contract logs as a source for Spark, in tables and streams, whose offsets are block numbers.

The folder holds Parquet files with the columns of LOGS, to which files with later blocks are added. A stream begins a number
of blocks before the latest one (all if there are fewer), reads each block once, and goes on at the block after the last one
after a restart. Tasks read ranges of blocks; of the files, those that can hold them, by the statistics in their footers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LOGS = "blockNumber long, transactionHash string, logIndex long, address string, topics array<string>, data string"
NAME = "contract_logs"
#: Blocks before the latest one that a new stream begins with, and blocks that one task reads.
BACKFILL, BLOCKS = 500, 200


class Blocks(InputPartition):
    """Blocks from first up to, and without, end."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.backfill, self.blocks = int(options.get("backfill", BACKFILL)), int(options.get("blocks", BLOCKS))
        self.addresses = [a for a in options.get("addresses", "").split(",") if a]

    def _files(self) -> pads.Dataset:
        return pads.dataset(self.path, format="parquet")

    def bounds(self) -> tuple[int, int] | None:
        """The first and the latest block there is; None for an empty folder."""
        low, high = [], []
        for file in self._files().get_fragments():
            for group in file.row_groups:
                known = (group.statistics or {}).get("blockNumber")
                if known:
                    low.append(known["min"])
                    high.append(known["max"])
        return (min(low), max(high)) if low else None

    def ranges(self, first: int, end: int) -> list[Blocks]:
        return [Blocks(at, min(at + self.blocks, end)) for at in range(first, end, self.blocks)]

    def rows(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        number = pads.field("blockNumber")
        wanted = (number >= part.first) & (number < part.end)
        if self.addresses:
            wanted &= pads.field("address").isin(self.addresses)
        columns = [c.split()[0] for c in LOGS.split(", ")]
        yield from (b for b in self._files().to_batches(columns=columns, filter=wanted) if b.num_rows)


class LogReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Blocks]:
        known = self.bounds()
        return self.ranges(known[0], known[1] + 1) if known else []

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LogStreamReader(_Folder, DataSourceStreamReader):
    """Offsets say which block comes next."""

    def initialOffset(self) -> dict:
        known = self.bounds()
        return {"next": max(known[1] - self.backfill, 0) if known else 0}

    def latestOffset(self) -> dict:
        known = self.bounds()
        return {"next": known[1] + 1 if known else 0}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return self.ranges(start["next"], end["next"])

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LogSource(DataSource):
    """Options: path; backfill and blocks, see above; addresses, separated by commas, in whose logs alone one is interested."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LOGS

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session under NAME."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this module
    spark.dataSource.register(LogSource)
