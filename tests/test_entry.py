"""The entry as the driver runs it: a fresh process, the registry before any session, then the flagship query."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert names and set(sql) <= set(names), sorted(set(sql) - set(names))
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
df = e.entry(spark)
assert df.columns and len(df.collect()) >= 0
spark.stop()
"""


def test_the_entry_loads_before_any_session_and_runs():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=HERE, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
