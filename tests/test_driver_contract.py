"""The driver contract in a fresh process with a near-default session (non-UTC zone)."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import sys
sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
import __spark_entry__ as E
from parley.oracle.compare import compare, connect
sf = "/root/testdata/sf0.01"
con = connect(sf)
q, o = E.queries(), E.oracle_sql()
assert set(o) <= set(q) and len(o) >= 158
bad = [k for k in ["m03_monthly", "m04_heatmap", "m06_gaps", "m12_post_error", "overview_portrait"]
       if not compare(q[k](s, sf), con, o[k], strict=True)[0]]
assert not bad, bad
df = E.entry(s)
assert df.count() > 0 and df.columns == ["metric", "bucket_index", "bucket", "n", "pct"]
print("OK")
""".replace("ROOT", repr(ROOT))


def test_driver_contract_fresh_process():
    r = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=600, cwd="/tmp")
    assert r.returncode == 0 and r.stdout.strip().endswith("OK"), r.stderr[-2000:]
