"""Tables in the shared folder, also where no spark.checkpoint.dir is set."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from veilspark.sources import shared

ROOT = Path(__file__).resolve().parents[1]


def test_rounds_keep_only_what_is_wanted(spark):
    tables = shared.Rounds(spark, "rounds-test")
    first, second, third = (tables(spark.range(n)) for n in (3, 4, 5))
    tables.only(second)
    assert second.count() == 4 and len(tables.paths) == 1
    for gone in (first, third):
        with pytest.raises(Exception, match="(?i)not.exist|not.found"):
            gone.collect()


def test_without_a_checkpoint_folder(tmp_path):
    """A bare local session writes to a folder of its own and leaves the setting alone; a cluster without one is an error."""
    script = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from veilspark.sources import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared.settled(spark.range(5)).count() == 5 and shared.shared_dir(spark) == shared.shared_dir(spark)
class Cluster:
    conf = spark.conf
    class sparkContext: master = "spark://host:7077"
try: shared.shared_dir(Cluster)
except ValueError: print("done")
"""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=env, timeout=180)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
