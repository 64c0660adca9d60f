"""Tables in versions: staged writes, a manifest a version, published by one rename.

A table is a folder. ``data/<id>/<part>`` holds rows that were written once and are never changed; ``versions/<n>.json`` lists which of these folders a version consists of. A write puts its
rows into a new folder first and then publishes a manifest by renaming it into place. The rename fails if another writer has published that version meanwhile, and a write that breaks
off before it leaves nothing that a reader sees. Readers take the newest manifest, or any older one by its number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{self.path} has no version {version or ''}")
        at = self._fs.open(self._at(f"{self.path}/versions/{(version or known[-1]):010d}.json"))
        try:
            return json.loads(bytes(at.readAllBytes()).decode())
        finally:
            at.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        m = self.manifest(version)
        schema = self.spark.createDataFrame([], m["schema"]).schema
        return self.spark.read.schema(schema).parquet(*m["parts"].values()) if m["parts"] else self.spark.createDataFrame([], schema)

    def _publish(self, schema: str, parts: dict[str, str], by: list[str], base: int) -> int:
        version = base + 1
        staged, final = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._at(f"{self.path}/versions/{version:010d}.json")
        out = self._fs.create(staged)
        out.write(json.dumps({"version": version, "schema": schema, "by": by, "parts": parts}).encode())
        out.close()
        # Not every file system's rename refuses an existing name, so it is looked at first; object stores need a conditional put here.
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    def _staged(self, df: DataFrame, by: list[str]) -> dict[str, str]:
        """Writes df to a new folder, a part for each value of by; returns the parts' folders by their name."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        if not by:
            df.write.parquet(folder)
            return {"": folder}
        copies = {f"_part_{c}": F.coalesce(F.col(c).cast("string"), F.lit("__null__")) for c in by}
        df.withColumns(copies).repartition(*copies).write.partitionBy(*copies).parquet(folder)
        found: dict[str, str] = {}

        def down(at: str, name: str, depth: int) -> None:
            for s in self._fs.listStatus(self._at(at)):
                own = s.getPath().getName()
                if s.isDirectory() and own.startswith("_part_"):
                    down(f"{at}/{own}", f"{name}/{own}", depth + 1)
            if depth == len(by):
                found[name] = at

        down(folder, "", 0)
        return found

    def write(self, df: DataFrame, by: Iterable[str] = ()) -> int:
        """A version of just these rows, in parts by the columns; returns its number."""
        by, base = list(by), (self.versions() or [0])[-1]
        return self._publish(df._jdf.schema().toDDL(), self._staged(df, by), by, base)

    def replace(self, df: DataFrame, emptied: DataFrame | None = None) -> int:
        """A version in which the parts that df has rows of, and those that emptied names by the columns, are df's; other parts stay."""
        m = self.manifest()
        gone = set()
        if emptied is not None:
            names = emptied.select(F.concat(*[x for c in m["by"] for x in (F.lit(f"/_part_{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__null__")))]).alias("name")).distinct()
            gone = {r["name"] for r in names.toLocalIterator()}  # a name a part
        parts = {k: v for k, v in m["parts"].items() if k not in gone} | self._staged(df.select(*self.read().columns), m["by"])
        return self._publish(m["schema"], parts, m["by"], m["version"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but for the newest ones, and the folders that none of these names; returns how many folders went."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at(f"{self.path}/versions/{v:010d}.json"), False)
        used = {p.split("/data/", 1)[1].split("/", 1)[0] for v in known[-keep:] for p in self.manifest(v)["parts"].values()}
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data"))]
        for name in folders:
            if name not in used:
                self._fs.delete(self._at(f"{self.path}/data/{name}"), True)
        return sum(name not in used for name in folders)


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: dict[str, DataFrame], owners: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The rows that stay of each table. links: (child, its column, parent, its column), parents before children; gone: rows to delete, of each table that has some.

    A row goes if it is to be deleted or if a parent of it goes. A row of an owner table goes if all rows that referred to it went, and there were some.
    """
    dead: dict[str, list[DataFrame]] = {name: [df] for name, df in gone.items()}
    stay = dict(tables)
    for name, df in gone.items():
        stay[name] = stay[name].join(df, df.columns, "left_anti").select(*tables[name].columns)
    for child, column, parent, key in links:
        if parent in dead:
            went = dead[parent][0].select(F.col(key).alias(column))
            for more in dead[parent][1:]:
                went = went.unionByName(more.select(F.col(key).alias(column)))
            dead.setdefault(child, []).append(tables[child].join(went.distinct(), column, "left_semi"))
            stay[child] = stay[child].join(went.distinct(), column, "left_anti").select(*tables[child].columns)
    for owner in owners:
        refers = [(child, column, key) for child, column, parent, key in links if parent == owner]
        if not refers:
            continue
        # An owner has many rows that refer to it, so keys are made distinct before they are joined, not after.
        had = [tables[child].select(F.col(column).alias(key)).distinct() for child, column, key in refers]
        has = [stay[child].select(F.col(column).alias(key)).distinct() for child, column, key in refers]
        orphans = had[0]
        for x in had[1:]:
            orphans = orphans.unionByName(x)
        for x in has:
            orphans = orphans.join(x, x.columns, "left_anti")
        stay[owner] = stay[owner].join(orphans.distinct(), orphans.columns, "left_anti").select(*tables[owner].columns)
    return stay
