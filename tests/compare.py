"""Run a query on Spark and its SQL on DuckDB and compare the two results as sorted rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from valora.sources.views import TABLES  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 6)) if v is not None else (True, "", 0) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return a == b and type(a) is type(b)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    cols = sorted(df.columns)
    res = con.execute(f"SELECT * FROM ({sql}) LIMIT 0")
    want_cols = [d[0] for d in res.description]
    if sorted(want_cols) != cols:
        return f"columns {cols} vs {sorted(want_cols)}"
    types = {n: str(t) for n, t in con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall()}
    for f in df.schema.fields:
        if TYPES.get(f.dataType.simpleString()) != types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}"
    quoted = ", ".join(f'"{c}"' for c in cols)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    want = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ {cols}; first {bad[0][0]} vs {bad[0][1]}"[:700]
    return None


def main() -> None:
    from valora.plans.catalog import ORACLES, QUERIES
    from valora.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("compare")
    con = oracle(sf_dir)
    names = [n for n in QUERIES if not prefixes or any(n.startswith(p) for p in prefixes)]
    failed = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                diff = compare(df, con, ORACLES[name])
                n = ""
            else:
                n, diff = f"rows={df.count()}", None
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", ""
        failed += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {n} {diff or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
