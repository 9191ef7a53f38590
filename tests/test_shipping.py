"""The package reaches Python workers whatever the working directory is."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
for name in ("win_topic_runs", "st_topic_runs"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
spark.stop()
"""


def test_queries_with_python_functions_run_from_another_directory(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=environment,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "win_topic_runs True" in done.stdout and "st_topic_runs True" in done.stdout
