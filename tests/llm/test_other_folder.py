"""All queries of the subpackage must run on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
names = sys.argv[1:] or sorted(entry.LLM)
assert len(names) > 2
for name in names:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_queries_run_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-2000:]
