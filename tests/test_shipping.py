"""Workers that start elsewhere, without the repository on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as entry
print("ROWS", entry.queries()["predict_stub"](spark, "/root/testdata/sf0.001").count())
"""


def test_a_predictor_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS 100" in done.stdout, done.stderr[-2000:]
