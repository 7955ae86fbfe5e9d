import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pagedrift.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("pagedrift-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of argument tuples."""

    def run(function, rows, types):
        names = [f"a{i}" for i in range(len(types))]
        schema = "n int, " + ", ".join(f"{n} {t}" for n, t in zip(names, types))
        from pyspark.sql import functions as F

        data = [(i, *row) for i, row in enumerate(rows)]
        frame = spark.createDataFrame(data, schema)
        out = frame.select("n", function(*[F.col(n) for n in names]).alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["n"])]

    return run
