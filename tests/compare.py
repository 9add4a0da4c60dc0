"""Compare a Spark result with DuckDB SQL over the same tables, as bags of rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _types(con, relation: str) -> dict[str, str]:
    described = con.execute(f"DESCRIBE SELECT * FROM {relation}").fetchall()
    return {row[0]: row[1] for row in described}


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows under the same names and types."""
    con.register("mine", spark_df.toArrow())
    try:
        con.execute(f"CREATE OR REPLACE TEMP TABLE theirs AS {sql}")
        left, right = _types(con, "mine"), _types(con, "theirs")
        if left != right:
            return f"columns {sorted(set(left.items()) ^ set(right.items()))}"
        columns = ", ".join(f'"{c}"' for c in sorted(left))
        only = {}
        for name, a, b in (("spark", "mine", "theirs"), ("sql", "theirs", "mine")):
            query = f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}"
            only[name] = con.execute(f"SELECT count(*) FROM ({query})").fetchall()[0][0]
            if only[name]:
                only[name] = (only[name], con.execute(f"{query} LIMIT 3").fetchall())
        return f"rows only in {only}" if any(only.values()) else None
    finally:
        con.unregister("mine")
