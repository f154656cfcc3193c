"""A driver in another folder, whose workers can't import the package, and tables that it has read itself."""

import subprocess
import sys
from pathlib import Path

SCRIPT = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from auditspark.llm import ranked_search, simhash
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{{t}}.parquet") for t in ("documents", "benchmark"))
print("ROWS", simhash.near_copies(docs).count(), ranked_search.search(docs, items, 1).count())
"""


def test_operators_ship_the_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 200 40" in done.stdout, done.stderr[-2000:]
