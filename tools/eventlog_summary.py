"""Summarise a Spark event log per job group (bench.py tags each query's jobs with its key).

usage: python tools/eventlog_summary.py EVENT_LOG (file, or a v2 rolling-log folder) [--md]
Per group: jobs, stages, tasks, summed task time, and the worst ratio of max to median task
time inside one stage with at least 4 tasks (a skew indicator; 1.0 = even).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
from collections import defaultdict


def main():
    path = sys.argv[1]
    md = "--md" in sys.argv
    stage_group: dict[int, str] = {}
    groups: dict[str, dict] = defaultdict(lambda: {"jobs": 0, "stages": set(), "tasks": 0, "task_ms": 0})
    task_times: dict[int, list[int]] = defaultdict(list)
    files = ([os.path.join(path, n) for n in sorted(os.listdir(path)) if n.startswith("events_")]
             if os.path.isdir(path) else [path])
    for fp in files:
        with open(fp, encoding="utf-8") as f:
            for line in f:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id", "(none)")
                    groups[g]["jobs"] += 1
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = g
                        groups[g]["stages"].add(sid)
                elif ev == "SparkListenerTaskEnd":
                    sid = e["Stage ID"]
                    info = e.get("Task Info", {})
                    ms = info.get("Finish Time", 0) - info.get("Launch Time", 0)
                    task_times[sid].append(ms)
                    g = stage_group.get(sid, "(none)")
                    groups[g]["tasks"] += 1
                    groups[g]["task_ms"] += ms
    rows = []
    for g, d in groups.items():
        skew = 1.0
        for sid in d["stages"]:
            t = task_times.get(sid, [])
            if len(t) >= 4 and statistics.median(t) > 0:
                skew = max(skew, max(t) / statistics.median(t))
        rows.append((g, d["jobs"], len(d["stages"]), d["tasks"], d["task_ms"], round(skew, 1)))
    rows.sort(key=lambda r: -r[4])
    if md:
        print("| group | jobs | stages | tasks | task ms | max/median task |")
        print("|---|---|---|---|---|---|")
        for r in rows:
            print("| " + " | ".join(str(x) for x in r) + " |")
    else:
        for r in rows:
            print(*r, sep="\t")


if __name__ == "__main__":
    main()
