"""Run the driver contract the way an outside harness does: a fresh process,
another working directory, the entry module loaded by path (so Python
workers cannot import the package from the current directory)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r'''
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("entry_mod", sys.argv[1])
mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(mod)
assert mod.entry(spark).count() > 0
qs = mod.queries()
for name in ("chi2_p", "annual_totals"):
    assert qs[name](spark, "/root/testdata/sf0.001").count() >= 1, name
assert set(mod.oracle_sql()) <= set(qs)
print("CONTRACT-OK")
'''


def test_contract_from_foreign_cwd():
    work = tempfile.mkdtemp(prefix="ql-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py")],
                         cwd=work, env=env, capture_output=True, text=True, timeout=600)
    assert "CONTRACT-OK" in out.stdout, out.stderr[-3000:]
