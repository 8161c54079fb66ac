"""Order-insensitive comparison of a Spark frame with a DuckDB result (local correctness gate)."""

from __future__ import annotations

import hashlib
import math
import os

SPARK2DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
              "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = bool(int(os.environ.get("ORACLE_STRICT", "0")))  # compare floats bit for bit


def norm(v, strict: bool = STRICT):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if strict else round(v, 6))
    if hasattr(v, "item"):
        return norm(v.item(), strict)
    return v


def digest(cols, rows, strict: bool = STRICT):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i], strict) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12], lines


def compare(df, con, sql: str, strict: bool = STRICT) -> tuple[bool, str]:
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    rel = con.sql(sql)
    ocols, otypes = rel.columns, dict(zip(rel.columns, [str(t) for t in rel.types]))
    orows = rel.fetchall()
    stypes = {f.name: SPARK2DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if sorted(scols) != sorted(ocols):
        return False, f"columns differ: {sorted(scols)} vs {sorted(ocols)}"
    tbad = {c: (stypes.get(c), otypes.get(c)) for c in scols if stypes.get(c) != otypes.get(c)}
    if tbad:
        return False, f"types differ: {tbad}"
    if len(srows) != len(orows):
        return False, f"rows differ: {len(srows)} vs {len(orows)}"
    sh, sl = digest(scols, srows, strict)
    oh, ol = digest(ocols, orows, strict)
    if sh != oh:
        so = set(ol)
        return False, f"values differ, e.g. spark-only {[x for x in sl if x not in so][:3]}"
    return True, f"{len(srows)} rows"
