"""Every query runs where the Python workers cannot import the package: functions and what they broadcast travel by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).mapInArrow(lambda batches: (__import__("strandline") and b for b in batches), "id long").collect()
    print("IMPORTED")
except Exception:
    pass
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        try:
            print(name, len(query(spark, "/root/testdata/sf0.001").limit(1).collect()))
        except Exception as error:
            print("FAILED", name, str(error)[-400:])
"""


def test_all_operators_run_without_a_copy_of_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED" not in done.stdout and "IMPORTED" not in done.stdout, done.stdout
    assert sum(line.startswith("op") for line in done.stdout.splitlines()) >= 13 and "pipeline" in done.stdout, done.stdout + done.stderr[-500:]
