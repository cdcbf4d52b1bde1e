import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file:{tmp_path_factory.mktemp('staged')}")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sources(spark):
    """``source_files`` from ``{service: {path: text}}``."""

    def make(services):
        rows = [
            (service, path, text)
            for service, files in services.items()
            for path, text in files.items()
        ]
        return spark.createDataFrame(rows, "service STRING, path STRING, content STRING")

    return make


@pytest.fixture
def env(spark):
    rows = [
        ("backend", "USERS_URL", "users"),
        ("backend", "BILLING_URL", "billing"),
        ("frontend", "VITE_USERS_URL", "users"),
        ("frontend", "USERS_API", "users"),
        ("frontend", "billingUrl", "billing"),
    ]
    return spark.createDataFrame(rows, "side STRING, env STRING, target STRING")


@pytest.fixture
def wrappers(spark):
    rows = [
        ("object", "usersApi", "users", "/api/v1"),
        ("function", "billingRequest", "billing", "/api/v2"),
    ]
    return spark.createDataFrame(rows, "kind STRING, name STRING, target STRING, prefix STRING")


def rows(df, *columns):
    """Sorted plain tuples of some columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
