import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="millrace-tests-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="millrace-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hot(spark):
    """Series where one key holds most rows, one key is null and times repeat."""
    import random

    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None])
        rows.append((key, i, rnd.randint(0, 4000), round(rnd.uniform(-5, 40), 2)))
    return spark.createDataFrame(rows, "key string, id long, sec int, value double").selectExpr(
        "key", "id", "timestamp_seconds(1700000000 + sec) AS ts", "value")
