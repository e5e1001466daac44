import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows_equal_sql(df, sql: str, sf_dir: str) -> None:
    """The rows of df and of DuckDB's sql over the tables in sf_dir, order aside."""
    import duckdb

    c = duckdb.connect()
    for t in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    cols = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(f'"{x}"' for x in cols)} FROM ({sql})").fetchall()
    show = lambda r: tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(show, df.select(*cols).collect())) == sorted(map(show, want))
