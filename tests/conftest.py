import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sleuthgraph.plans.session import tune
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


INGEST = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from short dicts: missing fields are null."""
    from sleuthgraph.schema import EVENT_DDL

    def build(rows):
        schema = spark.createDataFrame([], EVENT_DDL).schema
        base = {"source": "splunk", "severity": 2, "status": "success", "activity": "logon", "message": "", "mitre": [], "raw": "{}",
                "time": INGEST}
        full = []
        for i, row in enumerate(rows):
            one = {f.name: None for f in schema} | base | {"uid": f"{i:04d}"} | row
            for part in ("src", "dst", "device", "actor", "process", "file", "email"):
                if one[part] is not None:
                    one[part] = {f.name: None for f in schema[part].dataType} | one[part]
            full.append(one)
        return spark.createDataFrame(full, schema)

    return build
