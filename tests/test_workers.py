import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from covermetrics.session import build_session
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("rows", e.queries()["vector_topk"](spark, "/root/testdata/sf0.001").count(), e.queries()["bm25_topk"](spark, "/root/testdata/sf0.001").count())
"""


def test_task_functions_reach_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50 200" in out.stdout, out.stderr[-2000:]
