"""Result cache: three Parquet tables per strategy, named by its slug and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.operators.compare import fingerprint, slug
from tallyfold.sources.bars import _folder

KINDS = ("metrics", "equity", "trades")


class ResultCache:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, reg, kind: str) -> str:
        return f"{self.folder}/{slug(reg.name)}__{fingerprint(reg)}__{kind}.parquet"

    def read(self, reg) -> tuple[DataFrame, ...] | None:
        """The three tables, or None unless all of them are there."""
        for kind in KINDS:
            fs, place = _folder(self.spark, self.path(reg, kind) + "/_SUCCESS")
            if not fs.exists(place):
                return None
        return tuple(self.spark.read.parquet(self.path(reg, kind)) for kind in KINDS)

    def write(self, reg, tables: tuple[DataFrame, ...]) -> tuple[DataFrame, ...]:
        """Writes the tables unless there are no metrics, and gives them back as read."""
        if tables[0].isEmpty():
            return tables
        for kind, table in zip(KINDS, tables, strict=True):
            table.write.mode("overwrite").parquet(self.path(reg, kind))
        return self.read(reg)
