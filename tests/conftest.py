import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from threatloom.runtime import session

    return session("4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})


@pytest.fixture(scope="session")
def small():
    return SMALL


def same_rows(spark_df, duck_sql: str, folder: str) -> None:
    """The two engines' rows are equal as multisets, values compared as text with six places."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    a, b = spark_df.toPandas(), con.sql(duck_sql).df()
    assert sorted(a.columns) == sorted(b.columns)

    def text(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT or v is pd.NA:
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6f}"
        return str(int(v)) if isinstance(v, (bool, int)) or type(v).__name__ in ("bool_", "int32", "int64") else str(v)

    rows = [sorted(tuple(text(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]
