"""Versioned folders: data first, then one small manifest that makes it the current version.

A manifest is a numbered JSON file under ``_versions``; the greatest number is the current version.
It comes into place by a rename, so readers see a whole version or the one before. One writer at a
time is assumed; a second one that commits the same number gets an error and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Versions that stay readable: the current one and the one that running readers may still hold.
KEPT = 2


class Store:
    """The few file operations that manifests need, by the file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder; none if it does not exist."""
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are in place, ascending."""
        return sorted(int(n[:-5]) for n in self.names("_versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{number:012d}.json", wholetext=True).first()[0])

    def current(self) -> tuple[int, dict] | None:
        """Number and manifest of the current version."""
        found = self.numbers()
        return (found[-1], self.manifest(found[-1])) if found else None

    def commit(self, number: int, manifest: dict) -> None:
        """Put manifest ``number`` in place; it must be new."""
        draft, final = f"_versions/_draft-{uuid.uuid4().hex}", f"_versions/{number:012d}.json"
        if self._fs.exists(self._at(final)):
            raise FileExistsError(f"{self.path}: version {number} is already committed")
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(self._at(draft), self._at(final)):
            self.delete(draft)
            raise FileExistsError(f"{self.path}: version {number} is already committed")

    def retire(self, live: Callable[[dict], set[str]], folders: Callable[[], list[str]], kept: int = KEPT) -> None:
        """Delete all manifests but the last ``kept`` and every folder that none of those names."""
        numbers = self.numbers()
        used = set().union(*[live(self.manifest(n)) for n in numbers[-kept:]])
        for n in numbers[:-kept]:
            self.delete(f"_versions/{n:012d}.json")
        for folder in folders():
            if folder not in used:
                self.delete(folder)


@dataclass
class Part:
    """One table of a version: its rows as they are to be written, and the write itself.

    Rows must already be dealt and sorted, so that nothing but the write follows their digest. The
    content of a part that is only ``about`` the others, such as a date, makes no new version.
    """

    rows: DataFrame
    write: Callable[[DataFrame, str], None]
    about: bool = False


def _digest(df: DataFrame) -> list[Column]:
    """Row count and the sum of row hashes, the same for any order and partitioning of the rows."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string").alias(f"h{seed}") for seed in (1, 2)]]


def publish(spark: SparkSession, path: str, parts: dict[str, Part], extra: dict | None = None) -> bool:
    """Write all parts as one new version under ``path``; returns whether it became the current one.

    Each part is scanned once: its digest is observed while it is written. A version whose digests
    and schemas equal the current ones is taken back, so the same content twice makes one version. A write
    that fails leaves the current version as it was; its remains go with the next version.
    """
    store = Store(spark, path)
    before = store.current()
    number = before[0] + 1 if before else 0
    folder, made = f"v={number}", {}
    store.delete(folder)  # remains of a failed write
    for name, part in parts.items():
        seen = Observation()
        part.write(part.rows.observe(seen, *_digest(part.rows)), f"{store.path}/{folder}/{name}")
        made[name] = {"rows": seen.get["n"], "hash": [seen.get["h1"], seen.get["h2"]], "schema": part.rows.schema.simpleString()}
    compared = [n for n, p in parts.items() if not p.about]
    if before and [made[n] for n in compared] == [before[1]["parts"].get(n) for n in compared] and made.keys() == before[1]["parts"].keys():
        store.delete(folder)
        return False
    store.commit(number, {"folder": folder, "parts": made} | (extra or {}))
    store.retire(lambda m: {m["folder"]}, lambda: [n for n in store.names() if n.startswith("v=")])
    return True


def current_folder(spark: SparkSession, path: str) -> str:
    """Folder of the current version."""
    found = Store(spark, path).current()
    if not found:
        raise FileNotFoundError(f"{path}: nothing has been published")
    return f"{path.rstrip('/')}/{found[1]['folder']}"
