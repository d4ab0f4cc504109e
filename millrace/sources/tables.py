"""Managed tables for ingest: an append-only log of versioned rows under numbered manifests.

A write adds one small file set and a manifest; it never rewrites the table.  The
manifest with the highest number is current, and creating a number that exists
fails, so that of two writers one has to try again.  A reader that finds a manifest
half written takes the one before.  Readers pin a manifest: a
snapshot.  Answers and receipts are files of their own, so a manifest stays small.  `compact` folds the log into a new base.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import Dataset, Field
from .encodings import physical_name

META = [T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())]


class Conflict(RuntimeError):
    """Another writer was first."""


def physical(f: Field) -> T.DataType:
    amount = T.DecimalType(f.precision, f.scale) if f.precision else T.StringType()
    simple = {"integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "instant": T.TimestampType(), "decimal": amount}
    if f.kind == "money":
        return T.StructType([T.StructField("currency", T.StringType()), T.StructField("amount", amount)])
    return simple.get(f.kind, T.StringType())


def schema(dataset: Dataset) -> T.StructType:
    own = [T.StructField(f.local, physical(f)) for f in dataset.fields.values()]
    vectors = [T.StructField(f"embedding:{s}", T.ArrayType(T.FloatType())) for s in dataset.embeddings.values()]
    return T.StructType([*own, *vectors, *META])


@dataclass
class Table:
    spark: SparkSession
    root: str
    dataset: Dataset

    def __post_init__(self) -> None:
        jvm = self.spark._jvm  # noqa: SLF001
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([self.root, physical_name("table", self.dataset.id), *p]))
        self._fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        self.schema = schema(self.dataset)

    # -- manifests -------------------------------------------------------------------

    def number(self) -> int:
        place = self._path("manifests")
        if not self._fs.exists(place):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if not number:
            return {"number": 0, "base": None, "deltas": [], "state": {}}
        stream = self._fs.open(self._path("manifests", f"{number:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))  # noqa: SLF001
        except json.JSONDecodeError:
            return self.manifest(number - 1)
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Publish the next manifest, if no other writer has: whole at once on local disks, by exclusive creation elsewhere."""
        number = manifest["number"] + 1
        out = {**manifest, "number": number}
        aside, place = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"{number:012d}.json")
        body = json.dumps(out).encode()
        if self._fs.getUri().getScheme() == "file":
            self._write(aside, body)
            try:  # a link is made whole or not at all, and never over another
                os.link(aside.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                raise Conflict(place.toString()) from None
            finally:
                self._fs.delete(aside, False)
            return out
        try:  # stores refuse to create what exists; rename may replace it
            self._write(place, body)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e) or "412" in str(e) or self._fs.exists(place):
                raise Conflict(place.toString()) from None
            raise
        return out

    def _write(self, place, body: bytes) -> None:
        stream = self._fs.create(place, False)
        stream.write(bytearray(body))
        stream.close()

    # -- small files beside the manifests: each is written once -----------------------

    def put_file(self, body: dict, *at: str) -> None:
        self._write(self._path(*at), json.dumps(body).encode())

    def get_file(self, *at: str) -> dict | None:
        place = self._path(*at)
        if not self._fs.exists(place):
            return None
        stream = self._fs.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))  # noqa: SLF001
        finally:
            stream.close()

    def files(self, *at: str) -> list[str]:
        place = self._path(*at)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    # -- rows ------------------------------------------------------------------------

    def append(self, df: DataFrame, manifest: dict) -> dict:
        name = uuid.uuid4().hex
        df.select(*self.schema.fieldNames()).coalesce(1).write.parquet(self._path("data", name).toString())
        return {**manifest, "deltas": [*manifest["deltas"], name]}

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(self._path("data", n).toString() for n in names))

    def versions(self, manifest: dict | None = None) -> DataFrame:
        """The newest row of each id, deleted ones too."""
        manifest = manifest or self.manifest()
        key = self.dataset.fields[self.dataset.id_field].local
        base = self._read([manifest["base"]] if manifest["base"] else [])
        if not manifest["deltas"]:
            return base
        # a later file set may hold the same version again, with other vectors
        order = F.array_position(F.array(*map(F.lit, manifest["deltas"])), F.element_at(F.split(F.input_file_name(), "/"), -2))
        log = self._read(manifest["deltas"]).withColumn("__set", order)
        newest = log.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in self.schema.fieldNames()]), F.struct("_version", "__set")).alias("r")).select("r.*")
        return base.join(newest.select(F.col(key).alias("__changed")), F.col(key) == F.col("__changed"), "left_anti").unionByName(newest)

    def rows(self, manifest: dict | None = None) -> DataFrame:
        return self.versions(manifest).where(~F.col("_deleted"))

    def compact(self) -> dict:
        """Fold the log into a base, partitioned files and all; old file sets stay for readers that pinned them."""
        manifest = self.manifest()
        name = uuid.uuid4().hex
        self.versions(manifest).write.parquet(self._path("data", name).toString())
        return self.commit({**manifest, "base": name, "deltas": []})
