"""The driver's entry, from a process that knows the repository by sys.path alone."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ENTRY", e.entry(spark).count(), e.queries()["one_pole"](spark, "/root/testdata/sf0.001").count())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ENTRY 5 1000" in done.stdout, done.stderr[-2000:]
