"""The library starts without the machine's defaults and without the optional packages."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str, tmp_path, **more) -> str:
    """Output of a fresh interpreter whose Spark reads no defaults of this machine."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT), **more}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_steps_are_written_without_a_named_folder(tmp_path):
    code = """
from pyspark.sql import SparkSession
from fleetwake.operators import frames
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = frames.cut(spark.range(5)), frames.cut(spark.range(7))
print("rows", a.count(), b.count(), frames.shared_folder(spark) == frames.shared_folder(spark))
"""
    assert "rows 5 7 True" in run(code, tmp_path, TMPDIR=str(tmp_path))


def test_a_missing_package_leaves_only_the_text_queries_out(tmp_path):
    code = """
import sys, warnings
sys.modules["ahocorasick"] = None
import __spark_entry__ as entry
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    n = entry.queries()
print("queries", len(n) > 100, not any(k.startswith("op") for k in n), len(told) <= 2)
"""
    assert "queries True True True" in run(code, tmp_path)
