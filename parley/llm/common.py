"""Small helpers shared by the operators: tables, shared scratch folders, row ids, batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "__llm_rid"  # row id used inside the operators; no input column may have this name
ROWS_A_FILE = 500_000  # of narrow tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode without it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors.

    It is read only after the write returned, so no marker file is made on the driver."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about `rows` narrow rows, in no more partitions than these or the cores need: a small table
    written with hundreds of shuffle partitions is hundreds of files to create, list and open again."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def ship_package(spark: SparkSession) -> None:
    """Once per application: send this package to the executors, whose Python may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_package_sent", False):
        return
    here = Path(__file__).parent.parent
    with zipfile.ZipFile(archive := Path(tempfile.mkdtemp(prefix="llm-package-")) / "parley.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._llm_package_sent = True


def with_row_id(df: DataFrame) -> DataFrame:
    """A row id, so that rows with equal or missing ids stay apart; one that is there is kept.

    It depends on the file splits, and those on the cores registered when a job starts: for one
    evaluation only. What is joined or counted again needs `numbered` or `placed`."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str = "rows") -> DataFrame:
    """df with its row ids, written once to the shared folder: the same in every later job."""
    return df if RID in df.columns else written(with_row_id(df), name)


def placed(df: DataFrame) -> DataFrame:
    """df with a row id made of file name and position in the file, whatever the splits; rows may
    share one by chance. Frames that are no file scan are written once instead."""
    try:
        return df.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias(RID))
    except AnalysisException:
        return numbered(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: a column named inside a lambda is otherwise
    evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def crc_remainder(id_col: str, mod: int):
    """crc32 of the id written as text, modulo `mod`; NULL ids give NULL."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def texts_of(column: pa.Array) -> list[str]:
    """NULL texts read as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed sizes stay under `most` (single larger rows stand alone)."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def one_row_each(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of each doc_id, the one with the smallest text hash (column `text_hash`)."""
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "text_hash").alias("of")).select("doc_id", "of.*")


def labelled_sample(labels: DataFrame, label: str, mod: int, held: int, per_class: int, seed: int) -> DataFrame:
    """(doc_id, y) of about `per_class` ids of each class, the held-out remainder left out.

    Ids are kept by a seeded hash under a per-class share, so the sample does not depend on the
    order of rows; an id labelled twice counts once with its larger label; NULL labels are out.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()
                        & (crc_remainder("doc_id", mod) != held))
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}  # two rows
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, per_class / c))) for y, c in n.items()],
                       F.lit(0.0))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return one.where(unit < share)
