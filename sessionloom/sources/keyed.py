"""Tables with keys, written to again and again: insert-or-ignore and merge over versioned Parquet files.

A version is a small file in ``_versions`` that lists the Parquet folders it
consists of, by bucket of the hashed keys.  It is written under another name
and then given its number, which fails if that number is taken: a reader sees
the old or the new version whole, a writer that dies in between leaves the old
one, and of two writers one does its work again on the other's version.  Needs
a file system with an atomic rename (HDFS, a local or shared disk; no object
store).  Folders of failed writers and of old versions stay.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """One row for each key; a null key is a key like others.

    A bucket is what one task writes: choose ``buckets`` for about 1 GB each.
    They are fixed by the first version.  Of rows with equal keys in one write
    the one with the least hash counts.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def insert_new(self, rows: DataFrame) -> int:
        """Add the rows whose keys are not there yet; the version that holds them (no new one if nothing is new)."""

        def part(old: dict, name: str) -> list[dict]:
            fresh = self._one_each(rows, old)
            if old["parts"]:
                fresh = self._without(fresh, self._frame(old))
            return [*old["parts"], *self._written(fresh, name)]

        return self._changed(rows, part)

    def merge(self, rows: DataFrame) -> int:
        """Add the rows; those of equal keys are replaced.  Only buckets that the rows touch are written anew."""

        def part(old: dict, name: str) -> list[dict]:
            staged = self._written(self._one_each(rows, old), f"{name}-staged")
            if not staged or not old["parts"]:
                return [*old["parts"], *staged]
            touched = set(staged[0]["buckets"])
            fresh = self._frame({**old, "parts": staged})
            kept = self._without(self._frame(old, touched), fresh)
            rest = [{**p, "buckets": [b for b in p["buckets"] if b not in touched]} for p in old["parts"]]
            return [*(p for p in rest if p["buckets"]), *self._written(kept.unionByName(fresh).withColumn(BUCKET, self._bucket(old)), name)]

        return self._changed(rows, part)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest or an older version."""
        v = self.version() if version is None else version
        if not v:
            raise ValueError(f"no table at {self.path}")
        return self._frame(self._manifest(v))

    def version(self) -> int:
        """The number of the latest version; 0 without any."""
        fs, at = self._fs(), self._at("_versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _changed(self, rows: DataFrame, part) -> int:
        while True:
            v = self.version()
            old = self._manifest(v) if v else {"schema": json.loads(rows.schema.json()), "keys": list(self.keys), "buckets": self.buckets, "parts": []}
            if tuple(old["keys"]) != self.keys or set(rows.columns) != {f["name"] for f in old["schema"]["fields"]}:
                raise ValueError(f"rows or keys are not those of {self.path}")
            parts = part(old, uuid.uuid4().hex)
            if parts == old["parts"] and v:
                return v
            if self._published(v + 1, {**old, "parts": parts}):
                return v + 1

    def _one_each(self, rows: DataFrame, old: dict) -> DataFrame:
        d = rows.select(*StructType.fromJson(old["schema"]).names)
        one = d.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).agg(F.min_by(F.struct(*d.columns), F.xxhash64(*d.columns)).alias("_row"))
        return one.select("_row.*").withColumn(BUCKET, self._bucket(old))

    def _bucket(self, old: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(old["buckets"])).cast("int")

    def _without(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        """Rows whose keys are not in ``other``, of which only the keys are read."""
        equal = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys))
        return rows.alias("l").join(other.select(*self.keys).alias("r"), equal, "left_anti")

    def _written(self, rows: DataFrame, name: str) -> list[dict]:
        """Write rows by bucket; the folder as a part of a version, none if there were no rows."""
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        found = sorted(int(n.split("=")[1]) for s in self._fs().listStatus(self._at(name)) if (n := s.getPath().getName()).startswith(f"{BUCKET}="))
        return [{"name": name, "buckets": found}] if found else []

    def _frame(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{p['name']}/{BUCKET}={b}" for p in manifest["parts"] for b in p["buckets"] if only is None or b in only]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._at("_versions", f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _published(self, version: int, manifest: dict) -> bool:
        """Is the number taken by this writer?"""
        fs, draft, final = self._fs(), self._at("_versions", f"draft-{uuid.uuid4().hex}"), self._at("_versions", f"{version:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())  # fails if it is there, in one step
            else:
                hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
                how = gateway.new_array(hadoop.Options.Rename, 1)
                how[0] = hadoop.Options.Rename.NONE
                hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, final, how)
        except (FileExistsError, Py4JJavaError):
            if fs.exists(final):
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
