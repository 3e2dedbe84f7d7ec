import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names
    clash with those that operators make."""

    def make(*rows, extra=True):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (", score string, n_lines string, `a b` int" if extra else "")
        tail = ("old", "old", 7) if extra else ()
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *tail) for i, t in rows], schema)

    return make
