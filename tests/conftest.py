import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a Spark query and of its SQL over one scale's tables, column by column."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def text(value):
        if isinstance(value, float):
            return repr(round(value, 6))
        return str(value)

    def run(spark, query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        df = query(spark, folder)
        order = sorted(df.columns)
        mine = sorted(tuple(text(r[c]) for c in order) for r in df.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == order
        at = [names.index(c) for c in order]
        theirs = sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
        assert mine == theirs

    return run
