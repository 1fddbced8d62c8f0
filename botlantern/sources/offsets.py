"""How far log files were read: the table log_offset, with an older table behind it for names that it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.facts import offsets_with_legacy
from .tables import Tables


class LogOffsets:
    def __init__(self, tables: Tables):
        self.tables = tables

    def rows(self) -> DataFrame:
        """fileName, size, lastOffset and mtimeMs of all files; those of the older table have no time (0)."""
        return offsets_with_legacy(self.tables.read("log_offset"), self.tables.read("log_offset_v2"))

    def get_many(self, names: list[str]) -> dict[str, dict]:
        """Offsets by file name; names without one are left out."""
        found = self.rows().where(F.col("fileName").isin(names)).collect() if names else []
        return {r["fileName"]: r.asDict() for r in found}

    def get(self, name: str) -> dict | None:
        return self.get_many([name]).get(name)

    def row(self, name: str, size: int, last_offset: int, mtime_ms: int) -> DataFrame:
        row = self.tables.spark.createDataFrame([(name, size, last_offset, mtime_ms)], "fileName string, size long, lastOffset long, mtimeMs long")
        return row.withColumn("updatedAt", F.current_timestamp()).select(*[part.split(" ")[0] for part in schemas.LOG_OFFSET.split(", ")])

    def update(self, name: str, size: int, last_offset: int, mtime_ms: int) -> None:
        self.tables.upsert_small("log_offset", self.row(name, size, last_offset, mtime_ms))
