import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(df, relation) -> None:
    """The rows of a DataFrame and of a DuckDB relation, in any order."""
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)

    def rows(data):
        return sorted(repr(tuple(None if v is None or v != v else float(v) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else v for v in r)) for r in data)

    assert rows([tuple(r[c] for c in cols) for r in df.collect()]) == rows(relation.select(*cols).fetchall())
