import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: A ship's log: a text field, two keywords and two numbers.
VOYAGES = [
    ("v01", "Calm seas and a slow morning", "ines", 42, 9, "lagos"),
    ("v02", "Storm warning near the cape", "ines", 118, 21, "sagres"),
    ("v03", "Fog at the harbour mouth, slow going", "jonas", 17, 6, "kiel"),
    ("v04", "Second storm of the week", "jonas", 260, 40, "kiel"),
    ("v05", "Whales seen off the cape", "mara", 75, 14, "sagres"),
    ("v06", "Engine trouble, towed to harbour", "mara", 8, 5, "lagos"),
    ("v07", "Night crossing under a full moon", "mara", 310, 52, "brest"),
    ("v08", "Storm-bound in harbour", "otto", 3, 2, "brest"),
    ("v09", "Fast reach with following wind", "otto", 190, 23, "brest"),
    ("v10", "Light wind, drifting past the lighthouse", "pia", 29, 11, "kiel"),
    ("v11", "Fog again; whales heard, not seen", "pia", 55, 16, "brest"),
    ("v12", "Race day: fast start, slow finish", "quinn", 96, 12, "lagos"),
]


@pytest.fixture(scope="session")
def voyages(spark):
    from findling import Catalog

    frame = spark.createDataFrame(VOYAGES, "_id string, log string, skipper string, miles long, hours long, harbour string")
    catalog = Catalog(spark)
    catalog.register("voyages", frame, ("log",))
    return catalog
