from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from parley.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[4]").appName("parley-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="parley-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def export_tables(spark):
    from parley.sources import export

    return export.load_dir(spark, os.path.join(FIXTURES, "export"))


@pytest.fixture(scope="session")
def jctx(spark, export_tables):
    from parley.config import Config
    from parley.plans.base import context_for_tables

    return context_for_tables(spark, export_tables, Config(tz="UTC"))


@pytest.fixture(scope="session")
def tctx(spark):
    """Context over the driver tables at sf0.001 (materialised once)."""
    from parley.config import Config
    from parley.plans.base import context_for_testdata

    return context_for_testdata(spark, SF_SMALL, Config())


def rows(df, *cols):
    """Collect a (small, test-sized) frame as sorted tuples."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, "" if x is None else x) for x in t))


def one(df):
    r = df.collect()
    assert len(r) == 1, r
    return r[0].asDict()
