"""Catalog tables that change by a log: versions of rows are added, the last one of a key counts, no file is updated in place.

A table has its rows (the base) and, beside it, a table ``<name>_changes`` with a partition for each change. A change is
written to a folder of its own and counts from the moment that its partition is added, which is one step of the catalog;
a compacted base counts from the moment that the table's location is set to it, and its folder's name says up to which change it
holds them. So whatever step a job dies at, readers see the state before it or after it, and :meth:`Log.vacuum` removes
what was written in vain. One writer at a time; readers need not wait.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]


def partitions(spark: SparkSession, table: str) -> list[dict[str, str]]:
    return [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def add_partition(df: DataFrame, table: str, root: str, **where: str | int) -> None:
    """Rows written beside the others, then made a partition of the table in one step."""
    place = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    spec = ", ".join(f"{k} = {v!r}" for k, v in where.items())
    df.sparkSession.sql(f"ALTER TABLE {table} ADD PARTITION ({spec}) LOCATION '{place}'")


class Log:
    """The table ``name`` (of a database) whose rows have a key.

    Rows to insert have new keys, rows to change stored ones; either holds a key once (of repeated ones in one change the
    greatest row counts). A key that is null never equals another: such rows can be inserted, not changed.
    """

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.name, self.key, self.changes = spark, name, key, f"{name}_changes"

    @staticmethod
    def create(spark: SparkSession, name: str, columns: str) -> None:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_changes ({columns}, seq BIGINT, kind STRING) USING parquet PARTITIONED BY (seq, kind)")

    @property
    def columns(self) -> list[str]:
        return self.spark.table(self.name).columns

    def folded(self) -> int:
        """The number of the last change that the base holds."""
        found = re.search(r"/base-(\d+)-[0-9a-f]+/?$", location(self.spark, self.name))
        return int(found[1]) if found else 0

    def numbers(self) -> list[int]:
        """Changes after the base, in order."""
        folded = self.folded()
        return sorted({n for p in partitions(self.spark, self.changes) if (n := int(p["seq"])) > folded})

    def last(self) -> int:
        return max([*self.numbers(), self.folded()])

    def at(self, number: int) -> DataFrame:
        """The rows that one change wrote."""
        return self.spark.table(self.changes).where(F.col("seq") == number).select(self.columns)

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as it is, or as it was after a change that isn't compacted yet.

        Without changed rows this is a plain scan; with them, their keys are taken out of it by an anti join, which Spark
        broadcasts where they are few. Inserted rows are never shuffled for being inserted.
        """
        folded, columns = self.folded(), self.columns
        since = [(int(p["seq"]), p["kind"]) for p in partitions(self.spark, self.changes)]
        since = [(n, kind) for n, kind in since if n > folded and (upto is None or n <= upto)]
        rows, log = self.spark.table(self.name), self.spark.table(self.changes)
        if not since:
            return rows
        log = log.where((F.col("seq") > folded) & (F.col("seq") <= max(n for n, _ in since)))
        rows = rows.unionByName(log.where("kind = 'insert'").select(columns))
        if all(kind == "insert" for _, kind in since):
            return rows
        changed = log.where("kind = 'change'")
        newest = changed.groupBy(self.key).agg(F.max(F.struct("seq", *[c for c in columns if c != self.key])).alias("r"))
        newest = newest.select(*[F.col(c) if c == self.key else F.col(f"r.{c}") for c in columns])
        return rows.join(changed.select(self.key).distinct(), self.key, "left_anti").select(columns).unionByName(newest)

    def _add(self, rows: DataFrame, kind: str) -> int:
        number = self.last() + 1
        add_partition(rows.select(self.columns), self.changes, location(self.spark, self.changes), seq=number, kind=kind)
        return number

    def insert(self, rows: DataFrame) -> int:
        return self._add(rows, "insert")

    def change(self, rows: DataFrame) -> int:
        return self._add(rows, "change")

    def replace(self, rows: DataFrame) -> None:
        """All rows anew; they may be made from the table itself."""
        upto = self.last()
        place = f"{location(self.spark, self.changes)}/base-{upto:012d}-{uuid.uuid4().hex}"
        rows.select(self.columns).write.parquet(place)
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{place}'")
        self.forget()

    def compact(self) -> None:
        """Bring the changes into the base."""
        if self.numbers():
            self.replace(self.read())

    def forget(self) -> None:
        """Drop the changes that the base holds; reading doesn't need that, as it takes only later ones."""
        folded = self.folded()
        for p in partitions(self.spark, self.changes):
            if int(p["seq"]) <= folded:
                self.spark.sql(f"ALTER TABLE {self.changes} DROP IF EXISTS PARTITION (seq = {p['seq']}, kind = '{p['kind']}')")

    def vacuum(self) -> int:
        """Delete the folders that no partition or base stands for any more; none may be read or written meanwhile. Their number."""
        self.forget()
        root = location(self.spark, self.changes)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        used = {location(self.spark, self.name).rstrip("/").rpartition("/")[2]}
        for p in partitions(self.spark, self.changes):
            told = self.spark.sql(f"DESCRIBE FORMATTED {self.changes} PARTITION (seq = {p['seq']}, kind = '{p['kind']}')").where("col_name = 'Location'").first()
            used.add(told["data_type"].rstrip("/").rpartition("/")[2])
        place = jvm.org.apache.hadoop.fs.Path(root)
        store = place.getFileSystem(conf)
        gone = [f.getPath() for f in (store.listStatus(place) if store.exists(place) else []) if f.isDirectory() and f.getPath().getName() not in used]
        for path in gone:
            store.delete(path, True)
        return len(gone)
