"""DuckDB SQL text for the shared report shapes (oracle side of the correctness gate).

Independent of the Spark operators: plain aggregate SQL with FILTER clauses.
A series is (keys: dict, value_sql, cond_sql | None[, total_cond_sql]).
"""

from __future__ import annotations

import math

QS = (0.5, 0.9, 0.95, 0.99)


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + str(v).replace("'", "''") + "'"


def _key_names(series) -> list[str]:
    names: list[str] = []
    for s in series:
        for k in s[0]:
            if k not in names:
                names.append(k)
    return names


def _num(x) -> str:
    return "CAST('Infinity' AS DOUBLE)" if isinstance(x, float) and math.isinf(x) else repr(x)


def _filt(cond: str | None) -> str:
    return "" if cond is None else f" FILTER (WHERE {cond})"


def summary(src: str, series) -> str:
    keys = _key_names(series)
    parts = []
    for s in series:
        kv, val, cond = s[0], s[1], s[2]
        v = f"CAST({val} AS DOUBLE)"
        f = _filt(cond)
        cols = [f"{_lit(kv.get(k))} AS {k}" for k in keys]
        cols.append(f"CAST(count({v}){f} AS BIGINT) AS n")
        for q in QS:
            cols.append(f"round(quantile_cont({v}, {q}){f}, 6) AS p{int(q * 100)}")
        cols += [f"round(avg({v}){f}, 6) AS mean", f"round(max({v}){f}, 6) AS max",
                 f"round(min({v}){f}, 6) AS min"]
        parts.append(f"SELECT {', '.join(cols)} FROM {src}")
    return "\nUNION ALL\n".join(parts)


def buckets(src: str, series, edges, closed: bool = False) -> str:
    keys = _key_names(series)
    parts = []
    for s in series:
        kv, val, cond = s[0], s[1], s[2]
        tcond = s[3] if len(s) > 3 and s[3] is not None else cond
        v = f"CAST({val} AS DOUBLE)"
        base = cond or "TRUE"
        for j, (label, lo, hi) in enumerate(edges):
            up = f"{v} <= {_num(hi)}" if closed else f"{v} < {_num(hi)}"
            inside = f"({base}) AND {v} >= {_num(lo)} AND {up}"
            cols = [f"{_lit(kv.get(k))} AS {k}" for k in keys]
            cols += [f"CAST({j} AS INTEGER) AS bucket_index", f"{_lit(label)} AS bucket",
                     f"CAST(count(*) FILTER (WHERE {inside}) AS BIGINT) AS n",
                     f"CASE WHEN count(*) FILTER (WHERE {tcond or 'TRUE'}) = 0 THEN 0.0 "
                     f"ELSE round(100.0 * count(*) FILTER (WHERE {inside}) / "
                     f"count(*) FILTER (WHERE {tcond or 'TRUE'}), 6) END AS pct"]
            parts.append(f"SELECT {', '.join(cols)} FROM {src}")
    return "\nUNION ALL\n".join(parts)


def cohort(src: str, flag: str, metrics: dict[str, str], labels=("with", "without"), base: str | None = None) -> str:
    series = []
    b = base or "TRUE"
    for side, cond in ((labels[0], f"coalesce({flag}, FALSE)"), (labels[1], f"NOT coalesce({flag}, TRUE)")):
        for name, col in metrics.items():
            series.append(({"cohort": side, "metric": name}, col, f"({b}) AND {cond}"))
    return summary(src, series)


def bucket_case(val: str, edges, closed: bool = False, what: str = "index") -> str:
    v = f"CAST({val} AS DOUBLE)"
    whens = []
    for j, (label, lo, hi) in enumerate(edges):
        up = f"{v} <= {_num(hi)}" if closed else f"{v} < {_num(hi)}"
        out = str(j) if what == "index" else _lit(label)
        whens.append(f"WHEN {v} >= {_num(lo)} AND {up} THEN {out}")
    return "CASE " + " ".join(whens) + " END"
