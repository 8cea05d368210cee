"""Run registered queries and their oracles side by side and report differences."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _sorted_by_name(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, fn, sql: str, sf_dir: str) -> str:
    """"ok ..." or a description of the first difference."""
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = _sorted_by_name(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - t
    want_cols, want = _sorted_by_name(*oracle_rows(sql, sf_dir))
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} vs {want_cols}"
    if got == want:
        return f"ok {len(got)} rows {seconds:.1f}s"
    extra = [r for r in got if r not in set(map(tuple, want))][:3] if len(got) < 200_000 else []
    missing = [r for r in want if r not in set(map(tuple, got))][:3] if len(got) < 200_000 else []
    return f"DIFF {len(got)} vs {len(want)} rows; only spark: {extra} only sql: {missing} {seconds:.1f}s"


def main(names: list[str], sf_dir: str) -> None:
    from acclaim.session import build_session
    from acclaim.testing.oracles import all_oracles
    from acclaim.testing.queries import all_queries

    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = all_oracles()
    for name, fn in all_queries().items():
        if names and name not in names:
            continue
        try:
            if name in oracles:
                verdict = compare(spark, fn, oracles[name], sf_dir)
            else:
                verdict = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"ERROR {str(error)[:1500]}"
        print(f"{name}: {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
