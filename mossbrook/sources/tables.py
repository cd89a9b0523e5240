"""Keyed tables with versions: every change is a new manifest over immutable folders, so it is there wholly or not at all.

A table is a folder with ``data/<commit>/__bucket=<n>/`` and ``log/<version>.json``. Rows lie in buckets by the hash of the table's key,
so replacing some keys rewrites only their buckets, and the replacement stays in the buckets it touches. A writer claims the next
version by creating a file; who comes second starts again from the version that won.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossbrook import schema as S

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first; a version lock is held by another job."""


@dataclass
class Table:
    """A keyed table in a folder that all executors share."""

    spark: SparkSession
    path: str
    key: Sequence[str]
    buckets: int = 64

    # -- files
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _names(self, folder: str, end: str) -> list[int]:
        fs, at = self._fs(), self._path(folder)
        if not fs.exists(at):
            return []
        return sorted(int(n[: -len(end)]) for f in fs.listStatus(at) if (n := f.getPath().getName()).endswith(end) and n[: -len(end)].isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        versions = self._names("log", ".json")
        version = (versions[-1] if versions else None) if version is None else version
        if version is None:
            return None
        stream = self._fs().open(self._path(f"log/{version}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    # -- versions
    def versions(self) -> list[int]:
        return self._names("log", ".json")

    def _commit(self, change: Callable[[dict], dict], attempts: int = 5, wait: float = 1.0) -> int:
        for n in range(attempts):
            base = self._manifest()
            version = max([0, *self.versions(), *self._names("log", ".claim")]) + 1
            manifest = change(base) | {"version": version, "at": time.time()}
            fs = self._fs()
            fs.mkdirs(self._path("log"))
            newest = self._manifest()
            if (newest or {}).get("version") == (base or {}).get("version") and fs.createNewFile(self._path(f"log/{version}.claim")):
                self._write(f"log/{version}.tmp", json.dumps(manifest))
                if fs.rename(self._path(f"log/{version}.tmp"), self._path(f"log/{version}.json")):
                    return version
            time.sleep(wait * (n + 1))
        raise Conflict(f"{self.path}: no commit in {attempts} attempts")

    def ensure(self, schema: str) -> T.StructType:
        """Creates the table, or adds the columns that it lacks; what it has keeps its type."""
        wanted = T.StructType.fromDDL(schema)
        base = self._manifest()
        if base is None:
            self._commit(lambda _: {"schema": wanted.json(), "parts": []})
            return wanted
        have = T.StructType.fromJson(json.loads(base["schema"]))
        more = [f for f in wanted.fields if f.name not in have.names]
        for f in wanted.fields:
            if f.name in have.names and have[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        if more:
            grown = T.StructType(have.fields + more)
            self._commit(lambda m: m | {"schema": grown.json()})
            return grown
        return have

    @property
    def schema(self) -> T.StructType:
        base = self._manifest()
        if base is None:
            raise FileNotFoundError(self.path)
        return T.StructType.fromJson(json.loads(base["schema"]))

    # -- reading
    def _read(self, parts: list[dict], schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{p['dir']}/{BUCKET}={b}" for p in parts for b in p["buckets"] if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest without one."""
        m = self._manifest(version)
        if m is None:
            raise FileNotFoundError(self.path)
        return self._read(m["parts"], T.StructType.fromJson(json.loads(m["schema"])))

    # -- writing
    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int"))

    def _store(self, df: DataFrame, salts: int = 1) -> dict:
        """Writes the rows into a new folder, hot buckets over ``salts`` tasks; returns its part of a manifest."""
        name = uuid.uuid4().hex
        by = [F.col(BUCKET)] + ([F.pmod(F.xxhash64(*df.columns), F.lit(salts))] if salts > 1 else [])
        self._bucketed(df).repartition(*by).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        folder = self._path(f"data/{name}")
        buckets = sorted(int(f.getPath().getName().split("=")[1]) for f in self._fs().listStatus(folder) if f.getPath().getName().startswith(f"{BUCKET}="))
        if not buckets:
            self._fs().delete(folder, True)
        return {"dir": name, "buckets": buckets}

    def _writable(self, new: DataFrame) -> DataFrame:
        ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in self.key])
        return S.conform(new, self.schema).where(ok)

    def append(self, new: DataFrame, salts: int = 1) -> int:
        """Adds rows; those with a null or blank key aren't written."""
        part = self._store(self._writable(new), salts)
        return self._commit(lambda m: m | {"parts": [*m["parts"], part] if part["buckets"] else m["parts"]})

    def replace(self, new: DataFrame, also: DataFrame | None = None) -> int:
        """Replaces all rows of the new rows' keys, and empties the keys of ``also``. Only their buckets are read and written."""
        fresh = self._writable(new).persist()
        keys = fresh.select(*self.key)
        keys = (keys if also is None else keys.unionByName(also.select(*self.key))).distinct()

        def change(m: dict) -> dict:
            touched = {r[BUCKET] for r in self._bucketed(keys).select(BUCKET).distinct().collect()}
            schema = T.StructType.fromJson(json.loads(m["schema"]))
            kept = self._read(m["parts"], schema, touched).join(keys, list(self.key), "left_anti").select(*schema.names)
            part = self._store(kept.unionByName(fresh))
            rest = [{"dir": p["dir"], "buckets": [b for b in p["buckets"] if b not in touched]} for p in m["parts"]]
            return m | {"parts": [p for p in [*rest, part] if p["buckets"]]}

        try:
            return self._commit(change)
        finally:
            fresh.unpersist()

    def upsert(self, new: DataFrame, keep: Sequence[str] = ()) -> int:
        """Replaces by key; a null in the columns ``keep`` takes over what the row had, as vectors that weren't computed again."""
        rows = S.conform(new, self.schema)
        if keep:
            old = self.read().join(rows.select(*self.key).distinct(), list(self.key), "left_semi").select(*self.key, *[F.col(c).alias(f"__{c}") for c in keep])
            rows = rows.join(old, list(self.key), "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in keep else F.col(c) for c in self.schema.names])
        return self.replace(rows)

    def delete(self, keys: DataFrame) -> int:
        """Takes out all rows of the keys."""
        return self.replace(self.spark.createDataFrame([], self.schema), keys)

    def delete_where(self, condition: Column) -> int:
        """Takes out the rows that fulfil a condition; rows for which it is null stay."""
        hit = self.read().where(condition).select(*self.key).distinct()
        left = self.read().join(hit, list(self.key), "left_semi").where(~F.coalesce(condition, F.lit(False)))
        return self.replace(left, hit)

    def by_key(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; files of other buckets aren't opened."""
        k = keys.select(*self.key).distinct()
        m = self._manifest()
        touched = {r[BUCKET] for r in self._bucketed(k).select(BUCKET).distinct().collect()}
        return self._read(m["parts"], self.schema, touched).join(k, list(self.key), "left_semi").select(*self.schema.names)

    # -- upkeep
    def compact(self, salts: int = 1) -> int:
        """One folder with one file per bucket (``salts`` for hot ones) in place of many; readers of older versions aren't disturbed."""

        def change(m: dict) -> dict:
            schema = T.StructType.fromJson(json.loads(m["schema"]))
            return m | {"parts": [self._store(self._read(m["parts"], schema), salts)] if m["parts"] else []}

        return self._commit(change)

    def expire(self, keep: int = 1) -> list[int]:
        """Forgets all versions but the newest ``keep`` and deletes the folders that no version left names."""
        versions = self.versions()
        gone, stay = versions[: max(0, len(versions) - keep)], versions[max(0, len(versions) - keep) :]
        used = {p["dir"] for v in stay for p in self._manifest(v)["parts"]}
        named = {p["dir"] for v in gone for p in self._manifest(v)["parts"]}
        fs = self._fs()
        for v in gone:
            fs.delete(self._path(f"log/{v}.json"), False)
        for name in named - used:
            fs.delete(self._path(f"data/{name}"), True)
        return gone


def lake(spark: SparkSession, root: str) -> dict[str, Table]:
    """All tables of the lake under their names, created or grown to their declared columns."""
    keys = {
        "documents": ["doc_id"], "evidence_chunks": ["document_id"], "knowledge_claims": ["document_id"], "obs_tool_io": ["trace_id"], "obs_decision": ["decision_id"],
        "obs_span": ["span_id"], "er_observations": ["observation_id"], "ingest_quarantine": ["doc_id", "plane"],
    }
    out = {name: Table(spark, f"{root}/{name}", keys[name]) for name in S.TABLES}
    for name, t in out.items():
        t.ensure(S.TABLES[name])
    return out


def open_catalog(spark: SparkSession, name: str, uri: str, warehouse: str, kind: str = "rest", **options: str) -> dict[str, str]:
    """Settings of a table catalog for the session; needs the catalog's own library on the class path. Returns what was set."""
    base = f"spark.sql.catalog.{name}"
    conf = {base: "org.apache.iceberg.spark.SparkCatalog", f"{base}.type": kind, f"{base}.uri": uri, f"{base}.warehouse": warehouse, **{f"{base}.{k}": v for k, v in options.items()}}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
