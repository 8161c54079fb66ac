"""Tables published as a whole.

A load writes its tables into a new version folder below the root and, as its very last step, appends one
row to the root's manifest, a file that Spark's committer makes visible at once. Readers take the newest
row of the manifest and never list the version folders, so a load that dies half-way changes nothing for
them, and a reader that has begun keeps the version it began with. Paths in the manifest are relative
to the root. Versions no longer wanted are removed by whoever owns the folder; nothing is deleted here.

Two loads that publish at one time both write whole versions; the one with the higher (seq, version) is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest"
ROW = "seq long, version string, tables array<struct<name: string, rows: long, schema: string>>"


@dataclass(frozen=True)
class Version:
    root: str
    name: str
    seq: int
    tables: dict  # name -> (rows or None, schema as JSON)

    def path(self, table: str) -> str:
        return f"{self.root}/{self.name}/{table}"


def begin(root: str) -> str:
    """The folder of a new version (nothing is written yet)."""
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, base: str, tables: dict[str, tuple[StructType, int | None]]) -> Version:
    """Publish the tables written below `base`, a folder from `begin`: name -> (schema, rows if known)."""
    root, name = base.rsplit("/", 1)
    before = current(spark, root)
    seq = before.seq + 1 if before else 1
    listed = [(t, rows, schema.json()) for t, (schema, rows) in sorted(tables.items())]
    spark.createDataFrame([(seq, name, listed)], ROW).coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")
    return Version(root, name, seq, {t: (rows, schema) for t, rows, schema in listed})


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest published version (None before the first)."""
    root = root.rstrip("/")
    try:
        manifest = spark.read.schema(ROW).json(f"{root}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = manifest.agg(F.max(F.struct("seq", "version", "tables")).alias("m")).first()["m"]
    if newest is None:
        return None
    return Version(root, newest["version"], newest["seq"], {t["name"]: (t["rows"], t["schema"]) for t in newest["tables"]})


def table(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame:
    """A published table, of the newest version unless one is given."""
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    if name not in version.tables:
        raise KeyError(f"no table {name!r} in version {version.name}")
    schema = StructType.fromJson(json.loads(version.tables[name][1]))
    return spark.read.schema(schema).parquet(version.path(name)).select(*schema.fieldNames())
