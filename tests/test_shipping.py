"""Python workers import the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from transitrisk.session import build_session
from transitrisk.operators.delays import cdf_grids
spark = build_session("local[1]", 1)
law = spark.createDataFrame([("a", 1.0, 0.0, 5.0)], "dist_id string, shape double, loc double, scale double")
print("GRID", len(cdf_grids(law).first()["grid"]) > 5)
spark.stop()
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GRID True" in out.stdout, out.stderr[-2000:]
