import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_nodes(spark, rows):
    """Nodes from dicts with defaults; edges as (target, relation)."""
    from graphloom.schema import NODES

    full = []
    for r in rows:
        source = r.get("source") or ("", [0, 0], "")
        full.append((
            r["id"], r.get("type", "function"), r.get("namespace", ""), r.get("status", "active"), r.get("valid_from", ""), r.get("valid_until", ""), r.get("superseded_by", ""),
            source, r.get("edges", []), r.get("tags", []), r.get("summary", "about " + r["id"]), r.get("context", ""), None, r.get("file_path", r["id"] + ".md"),
        ))
    return spark.createDataFrame(full, NODES)


@pytest.fixture()
def nodes_of(spark):
    return lambda rows: make_nodes(spark, rows)
