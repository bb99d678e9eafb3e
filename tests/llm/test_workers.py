"""Tasks of the learned operators run where the package is not installed."""

import os
import subprocess
import sys

from ..conftest import SF

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from millrace.session import get_session
from millrace.llm.queries import QUERIES
spark = get_session("workers", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": tempfile.mkdtemp()})

def found(rows):
    import importlib.util
    yield importlib.util.find_spec("millrace") is not None

assert spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect() == [False]
for name in ("op3_toxicity", "op8_language", "op9_quality", "op11_resampling", "op12_secrets", "op13_whitening"):
    assert QUERIES[name](spark, sys.argv[2]).count() > 0, name
print("all ran")
"""


def test_queries_without_the_package_on_the_workers(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(script), REPO, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in got.stdout, got.stderr[-3000:]
