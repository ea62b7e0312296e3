import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("riskloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def transactions(spark, n):
    """Labelled transactions whose classes can be told apart; one in 16 is fraud."""
    import numpy as np

    from riskloom.schema import FEATURES, LABELLED_TX

    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        fraud = i % 16 == 0
        v = rng.normal(-2.0 if fraud else 0.0, 1.0, 28)
        amount = round(float(rng.uniform(1, 50) if fraud else rng.lognormal(4, 1)), 2)
        rows.append((i, float(rng.integers(0, 172800)), *map(float, v), amount, int(fraud)))
    df = spark.createDataFrame(rows, LABELLED_TX)
    assert df.columns[1:-1] == FEATURES
    return df.cache()


@pytest.fixture(scope="session")
def separable(spark):
    """360 legit, 24 fraud."""
    return transactions(spark, 384)


@pytest.fixture(scope="session")
def learnable(spark):
    """1500 legit, 100 fraud: enough to train on."""
    return transactions(spark, 1_600)
