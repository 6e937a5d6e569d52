"""Grouped Python steps must run on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("st_12_forests", "st_11_leave_one_out", "geo_08d_split_by_buffered_lines"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_queries_run_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
