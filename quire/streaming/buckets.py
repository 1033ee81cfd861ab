"""A canonical table in buckets, merged batch by batch: a batch rewrites only the buckets it changes.

Rows are dealt to buckets by the hash of their id. A second table, dealt by the hash of the DOI, says
which id holds a DOI, so a batch finds the rows it touches without reading the others. A manifest
names for each bucket the version that wrote it last; it is committed after the data together with
the number of the batch, so a batch that comes again is a no-op.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.operators.merge import merge
from quire.sources.versions import Store

BUCKETS = 64
_KEYS = "doi string, id string"


class MergeTable:
    """Publications under a path: rows ``id``, ``doi``, ``ord``, content and ``side`` (0 for the first version, then the version that added the row)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, base: DataFrame, buckets: int = BUCKETS) -> MergeTable:
        """The table under ``path``; if there is none, ``base`` becomes its version 0.

        Choose ``buckets`` so that one is read and written by one task with ease: 100 to 500 MB each.
        """
        table = cls(spark, path)
        if table.store.current() is None:
            rows = base.drop("side").withColumn("side", F.lit(0))
            table._write("rows", 0, rows, "id", buckets)
            table._write("keys", 0, base.filter("doi IS NOT NULL").select("doi", "id"), "doi", buckets)
            table.store.commit(0, {"batches": {}, "buckets": buckets, "schema": rows.schema.json(), "rows": [0] * buckets, "keys": [0] * buckets,
                                   "written": {"rows": list(range(buckets)), "keys": list(range(buckets))}})
        return table

    def _write(self, part: str, version: int, rows: DataFrame, key: str, buckets: int) -> None:
        dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store.path}/{part}/v={version}")

    def _read(self, manifest: dict, part: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the given buckets (all by default). A bucket without rows has no folder."""
        schema = _KEYS if part == "keys" else _schema(manifest)
        wanted = range(manifest["buckets"]) if buckets is None else buckets
        there = {v: set(self.store.names(f"{part}/v={v}")) for v in {manifest[part][b] for b in wanted}}
        paths = [f"{self.store.path}/{part}/v={manifest[part][b]}/bucket={b}" for b in wanted if f"bucket={b}" in there[manifest[part][b]]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The current version."""
        return self._read(self.store.current()[1], "rows")

    def written(self) -> dict[str, list[int]]:
        """Buckets that the current version wrote: of ``rows`` and of ``keys``."""
        return self.store.current()[1]["written"]

    def merge_batch(self, batch: DataFrame, batch_id: int, source: str = "") -> bool:
        """Merge one batch as ``operators.merge.merge`` does over the whole table; returns whether it was new.

        Batches of one ``source`` have rising numbers; give each stream its own name. The merge runs on the rows that hold an id or DOI of the batch. Only sets of bucket
        numbers reach the driver. Data of a batch that failed before its commit is overwritten when
        it comes again.
        """
        number, now = self.store.current()
        if batch_id <= now["batches"].get(source, -1):
            return False
        version, n = number + 1, now["buckets"]
        batch = self._kept(batch, "work/batch")
        dois = batch.filter("doi IS NOT NULL").select("doi").distinct()
        held = self._read(now, "keys", _numbers(dois, "doi", n))
        ids = batch.select("id").unionByName(held.join(dois, "doi", "left_semi").select("id")).filter("id IS NOT NULL").distinct()
        near = self._read(now, "rows", _numbers(ids, "id", n))
        touched = self._kept(near.join(ids, "id", "left_semi"), "work/touched")
        merged, _ = merge(touched.drop("side"), batch)
        added = merged.filter("side = 1").withColumn("side", F.lit(version))
        kept = merged.drop("side").join(touched.select("id", "side"), "id")
        merged = self._kept(kept.select(*added.columns).unionByName(added), "work/merged")
        changed = merged.exceptAll(touched.select(*merged.columns))
        after = {"rows": _numbers(changed, "id", n)}
        pairs = [df.filter("doi IS NOT NULL").select("doi", "id") for df in (touched, merged)]
        gone, come = pairs[0].exceptAll(pairs[1]), pairs[1].exceptAll(pairs[0])
        after["keys"] = _numbers(gone.unionByName(come), "doi", n)
        if after["rows"]:
            rest = self._read(now, "rows", after["rows"]).join(touched.select("id"), "id", "left_anti")
            rows = rest.unionByName(merged.filter(_bucket("id", n).isin(after["rows"])))
            self._write("rows", version, rows.select(*_schema(now).names), "id", n)
        if after["keys"]:
            keys = self._read(now, "keys", after["keys"])
            self._write("keys", version, keys.join(gone, ["doi", "id"], "left_anti").unionByName(come), "doi", n)
        follow = {part: [version if b in set(after[part]) else v for b, v in enumerate(now[part])] for part in ("rows", "keys")}
        self.store.commit(version, now | follow | {"batches": now["batches"] | {source: batch_id}, "written": after})
        self.store.delete("work")
        self.store.retire(_live, self._folders)
        return True

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once beside the table, for the steps of one batch."""
        df.write.mode("overwrite").parquet(f"{self.store.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{name}")

    def _folders(self) -> list[str]:
        """All bucket folders, of any version."""
        return [f"{part}/{v}/{b}" for part in ("rows", "keys") for v in self.store.names(part) for b in self.store.names(f"{part}/{v}") if b.startswith("bucket=")]


def _schema(manifest: dict) -> StructType:
    return StructType.fromJson(json.loads(manifest["schema"]))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _numbers(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Buckets that hold a key of ``df``: at most as many numbers as there are buckets."""
    return sorted(r[0] for r in df.select(_bucket(key, buckets).alias("b")).distinct().collect())


def _live(manifest: dict) -> set[str]:
    return {f"{part}/v={v}/bucket={b}" for part in ("rows", "keys") for b, v in enumerate(manifest[part])}
