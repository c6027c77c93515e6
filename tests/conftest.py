from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("contest-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Treat every key with more than five rows as too large for one task."""
    spark.conf.set("contest_analytics.hotRows", "5")
    spark.conf.set("contest_analytics.tileRows", "7")
    yield
    spark.conf.unset("contest_analytics.hotRows")
    spark.conf.unset("contest_analytics.tileRows")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
