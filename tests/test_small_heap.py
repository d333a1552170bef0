"""Queries of forecast windows in a heap of 1 GB: a row of a window must not hold its chunk (8,192 times half a MB a task)."""

import os
import subprocess
import sys

import pytest

QUERIES = [
    "dlinear_forecast",
    "hybrid_loss_terms",
    "multiscale_pools",
    "overlap_average",
    "patch_unfold",
    "revin_window",
    "rolling_values",
    "strongest_bins",
    "window_mse",
    "window_sums",
    "forecast_shape_losses",
]

CODE = """
import sys, tempfile
from pyspark.sql import SparkSession, functions as F
from tidewright import catalog
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
folder = tempfile.mkdtemp(prefix="spark-")
i = F.col("id")
at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 30)")
e = spark.range(4 << 16).select(i.alias("event_id"), at.alias("ts"), (i % 7).alias("user_id"), F.when(i % 2 == 0, "click").otherwise("view").alias("event_type"), (1 + (i * 37) % 1000 / 10).alias("value"))
e.write.parquet(folder + "/events.parquet")
for name in sys.argv[1:]:
    catalog.queries()[name](spark, folder).write.parquet(f"{folder}/{name}")
    print("rows", name, spark.read.parquet(f"{folder}/{name}").count(), flush=True)
"""

#: Windows of a segment, 131,072 rows: one in 16 rows of 32 and 8 steps; one in 8 rows of 16 and 4.
BY_16, BY_8 = (131072 - 40) // 16 + 1, (131072 - 20) // 8 + 1
ROWS = {
    "window_sums": 2 * BY_8, "window_mse": 2, "rolling_values": 2 * 100, "hybrid_loss_terms": 2 * BY_16, "multiscale_pools": 2 * 8 * BY_16, "patch_unfold": 2 * 4 * BY_16,
    "revin_window": 2 * BY_16, "strongest_bins": 2 * BY_16, "dlinear_forecast": 2 * BY_16, "forecast_shape_losses": 2 * BY_16, "overlap_average": 2 * 8 * BY_16,
}


@pytest.fixture(scope="module")
def printed():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE, *QUERIES], cwd=root, capture_output=True, text=True, timeout=600)
    return done.stdout + done.stderr[-2000:]


@pytest.mark.parametrize("name", QUERIES)
def test_all_windows_in_a_small_heap(printed, name):
    assert f"rows {name} {ROWS[name]}\n" in printed, printed[-2000:]
