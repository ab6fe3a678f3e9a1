"""Workers that do not have this package."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from drawlytics.llm import queries
from drawlytics.session import local_session
spark = local_session("workers", 4, 4)
found = spark.range(2).mapInPandas(lambda it: (d.assign(id=int(__import__("importlib.util").util.find_spec("drawlytics") is not None)) for d in it), "id long")
assert found.agg({"id": "max"}).first()[0] == 0, "the workers have the package"
queries.registered()[sys.argv[2]](spark, sys.argv[3]).count()
"""


@pytest.mark.parametrize("name", ["op3_lm_scoring", "op4_decontamination", "op7_url_filter", "op11_token_files", "op12_ranked_search", "op13_spelling_variants"])
def test_query_runs(name, sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, name, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
