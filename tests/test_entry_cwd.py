"""The driver imports __spark_entry__ from elsewhere with its own plain session:
queries that run Python on executors must still find the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
q = E.queries()
print("COUNTS", q["f1_score_batches"](spark, "/root/testdata/sf0.001").count(),
      q["e10_fuzzy_reward"](spark, "/root/testdata/sf0.001").count(), E.entry(spark).count())
"""


def test_udf_queries_run_from_another_directory(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True,
                         text=True, timeout=600)
    line = [l for l in out.stdout.splitlines() if l.startswith("COUNTS")]
    assert line, out.stderr[-2000:]
    f1, e10, entry = map(int, line[0].split()[1:])
    assert f1 > 0 and e10 > 0 and entry > 0
