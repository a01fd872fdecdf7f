"""Every query that has SQL against DuckDB over one folder of tables: ``python tests/compare.py [folder] [name...]``.

The tests do this on the smallest tables; rules that hang on sizes (such as tokens of more than four digits) show on larger ones.
"""

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x) -> str:
    """Floats to twelve digits: the two engines may add in another order."""
    import pandas as pd

    return "" if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else f"{x:.12g}" if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def main(folder: str, names: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    differ = []
    for name, sql in entry.oracle_sql().items():
        if names and name not in names:
            continue
        at = time.time()
        got, want = rows(entry.queries()[name](spark, folder).toPandas()), rows(con.execute(sql).df())
        same = got == want
        differ += [] if same else [name]
        print(f"{name}: {len(got)} rows, {'equal' if same else f'DIFFERENT, {len(want)} by SQL'}, {time.time() - at:.1f} s", flush=True)
    print("different:", ", ".join(differ) or "none")
    return bool(differ)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", sys.argv[2:]))
