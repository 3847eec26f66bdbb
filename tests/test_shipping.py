"""Workers get the package from the session, not from the driver's folder or environment."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from gaugeline.session import build_session
spark = build_session(master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
print("ROWS", entry.queries()["doc_chunks"](spark, {FOLDER!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_arrow_query_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
