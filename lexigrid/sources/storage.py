"""Where an index is kept: a folder, tables of the catalog, or a driver of one's own.

A driver has ``get(spark)``, which gives (description, tables) or None,
``persist(spark, description, tables)`` and ``delete(spark)``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .tables import byte_size, delete, exists, hadoop_path, read_text, write_text

Stored = tuple[dict, dict[str, DataFrame]]


class StorageDriver(Protocol):
    def get(self, spark: SparkSession) -> Stored | None: ...

    def persist(self, spark: SparkSession, description: dict, tables: dict[str, DataFrame]) -> None: ...

    def delete(self, spark: SparkSession) -> None: ...


@dataclass(frozen=True)
class FolderDriver:
    """Parquet tables under any URI that Spark reaches.

    Tables go to a folder of their own first; then the description, which names it, is
    replaced.  So an index may be written over the one it was read from.
    """

    path: str

    def get(self, spark: SparkSession) -> Stored | None:
        if not exists(spark, f"{self.path}/description.json"):
            return None
        found = json.loads(read_text(spark, f"{self.path}/description.json"))
        return found["description"], {t: spark.read.parquet(f"{self.path}/{found['folder']}/{t}") for t in found["tables"]}

    def persist(self, spark: SparkSession, description: dict, tables: dict[str, DataFrame]) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        for name, table in tables.items():
            if name == "postings":  # sorted by term, so that a term's scan skips row groups
                table = table.repartitionByRange("term").sortWithinPartitions("term", "internal_id")
            table.write.parquet(f"{self.path}/{folder}/{name}")
        write_text(spark, f"{self.path}/description.json", json.dumps({"description": description, "folder": folder, "tables": sorted(tables)}))

    def delete(self, spark: SparkSession) -> None:
        delete(spark, self.path)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete the tables of former versions, once nothing reads them; gives their number."""
        current = json.loads(read_text(spark, f"{self.path}/description.json"))["folder"]
        system, at = hadoop_path(spark, self.path)
        old = [str(s.getPath()) for s in system.listStatus(at) if s.getPath().getName().startswith("data-") and s.getPath().getName() != current]
        return sum(bool(delete(spark, path)) for path in old)

    def byte_size(self, spark: SparkSession) -> int:
        """Bytes of the current version; 0 if there is none."""
        if not exists(spark, f"{self.path}/description.json"):
            return 0
        folder = json.loads(read_text(spark, f"{self.path}/description.json"))["folder"]
        return byte_size(spark, f"{self.path}/description.json") + byte_size(spark, f"{self.path}/{folder}")


@dataclass(frozen=True)
class CatalogDriver:
    """Tables ``<database>.<store>_<table>`` of the session's catalog."""

    database: str = "default"
    store: str = "search_index"

    def _name(self, table: str) -> str:
        return f"{self.database}.{self.store}_{table}"

    def get(self, spark: SparkSession) -> Stored | None:
        if not spark.catalog.tableExists(self._name("description")):
            return None
        found = json.loads(spark.table(self._name("description")).first().description)
        return found["description"], {t: spark.table(self._name(f"{t}_{found['version']}")) for t in found["tables"]}

    def persist(self, spark: SparkSession, description: dict, tables: dict[str, DataFrame]) -> None:
        old = self._tables(spark)
        version = uuid.uuid4().hex
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for name, table in tables.items():
            table.write.saveAsTable(self._name(f"{name}_{version}"))
        text = json.dumps({"description": description, "version": version, "tables": sorted(tables)})
        spark.createDataFrame([(text,)], "description string").write.mode("overwrite").saveAsTable(self._name("description"))
        for name in old:
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _tables(self, spark: SparkSession) -> list[str]:
        if not spark.catalog.tableExists(self._name("description")):
            return []
        found = json.loads(spark.table(self._name("description")).first().description)
        return [self._name(f"{t}_{found['version']}") for t in found["tables"]]

    def delete(self, spark: SparkSession) -> None:
        for name in [*self._tables(spark), self._name("description")]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def storage_driver(spec: object) -> StorageDriver | None:
    """The driver of a short name, a path, a ``{"type": ...}`` dictionary, or itself."""
    if spec is None or all(hasattr(spec, m) for m in ("get", "persist", "delete")) and not isinstance(spec, dict):
        return spec  # type: ignore[return-value]
    if spec == "catalog":
        return CatalogDriver()
    if isinstance(spec, str) and ("/" in spec):
        return FolderDriver(spec)
    if isinstance(spec, dict):
        more = {k: v for k, v in spec.items() if k != "type"}
        if spec.get("type") == "folder":
            return FolderDriver(**more)
        if spec.get("type") == "catalog":
            return CatalogDriver(**more)
        if spec.get("type") == "custom":
            return storage_driver(more["driver"])
    raise ValueError("Unknown storage driver type.")
