"""Compare every catalog query with its SQL twin: python tools/check_oracles.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runtally.plans.catalog import QUERIES  # noqa: E402
from runtally.plans.oracles import ORACLES  # noqa: E402
from runtally.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("∅" if v is None or v is pd.NaT or v != v else str(v) for v in row))
    return sorted(rows)


def differences(spark, con, name: str, sf_dir: str) -> str | None:
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    left, right = canonical(_same_types(ours)), canonical(_same_types(theirs))
    if left == right:
        return None
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return f"{len(left)} vs {len(right)} rows; only ours {only_left}; only theirs {only_right}"


def _same_types(df: pd.DataFrame) -> pd.DataFrame:
    """Nullable integers become floats in pandas on one side only; dates become text."""
    out = df.copy()
    for column in out.columns:
        kind = out[column].dtype.kind
        if kind in "iuf":
            out[column] = out[column].astype("float64")
        elif kind == "M":
            out[column] = out[column].astype("datetime64[us]")
        elif kind == "O":
            seen = out[column].dropna()
            if len(seen) and hasattr(seen.iloc[0], "isoformat"):
                out[column] = pd.to_datetime(out[column]).astype("datetime64[us]")
            elif len(seen) and isinstance(seen.iloc[0], (int, float)) and not isinstance(seen.iloc[0], bool):
                out[column] = out[column].astype("float64")
    return out


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = build_session("local[8]", **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            fault = differences(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += fault is not None
        print(f"{'ok  ' if fault is None else 'FAIL'} {name} {time.time() - start:.1f}s {fault or ''}", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
