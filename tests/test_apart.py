"""The library without the training-data operators: a copy without their folders imports, collects and runs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
PROBE = """
import sys
import __spark_entry__ as entry
names = set(entry.queries())
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= names and "ledgerlens.llm" not in sys.modules
from ledgerlens.session import build_session
spark = build_session("local[2]", "apart", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
spark.sparkContext.setLogLevel("ERROR")
assert entry.entry(spark).count() > 0
for name in ("t8_classify_intent", "r3_keyword_topk", "r7_cache_lookup", "e6_admission_batch"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    root = tmp_path_factory.mktemp("apart") / "repo"
    shutil.copytree(HERE, root, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    return root


def run(root, *command):
    env = os.environ | {"PYTHONPATH": ""}
    return subprocess.run([sys.executable, *command], cwd=root, env=env, capture_output=True, text=True, timeout=600)


def test_queries_run(copy):
    done = run(copy, "-c", PROBE)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_tests_are_collected(copy):
    done = run(copy, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert done.returncode == 0 and "error" not in done.stdout.splitlines()[-1], done.stdout[-2000:]
    assert "tests/llm" not in done.stdout


def test_a_missing_package_leaves_the_rest(copy):
    blocked = "import sys; sys.modules['zstandard'] = None; sys.modules['xxhash'] = None\n"
    done = subprocess.run([sys.executable, "-c", blocked + "import __spark_entry__ as e; print(len(e.queries()))"],
                          cwd=HERE, capture_output=True, text=True, timeout=300)
    assert int(done.stdout.strip() or 0) > 170, done.stderr[-2000:]
