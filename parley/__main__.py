"""Command line: python -m parley EXPORT_DIR OUT_DIR [--modules m01,m12] [--tz ZONE] [--jsonl]

Parses the export once, publishes the normalised and stat tables (W5) as a version below OUT_DIR/tables, and
writes every requested module's frames as CSV + JSON plus a summary document (W1/W2/W6).
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="parley")
    ap.add_argument("export_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--modules", default="", help="comma list (default: all)")
    ap.add_argument("--tz", default=None, help="wall-clock zone for local-time columns")
    ap.add_argument("--jsonl", action="store_true", help="read .json inputs as JSON Lines too (.jsonl and folders are)")
    a = ap.parse_args(argv)

    from parley import sinks
    from parley.config import Config
    from parley.plans import REGISTRY
    from parley.plans.base import context_for_export
    from parley.session import get_spark

    spark = get_spark()
    cfg = Config(tz=a.tz) if a.tz else Config()
    # normalised and stat tables are written once, into a new version below OUT_DIR/tables
    ctx = context_for_export(spark, a.export_dir, cfg, multiline=False if a.jsonl else None,
                             tables_dir=f"{a.out_dir.rstrip('/')}/tables")
    modules = [m for m in a.modules.split(",") if m] or sorted({m for m, _ in REGISTRY.values()})
    for m in modules:
        keys = sinks.write_module(m, ctx, f"{a.out_dir.rstrip('/')}/reports")
        print(f"{m}: {len(keys)} frames", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
