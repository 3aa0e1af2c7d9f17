"""The driver's entry points, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 495 and df.columns == ["i0", "i1", "i2", "i3", "s0", "s1", "s2", "res", "nsnps"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_operators(tmp_path):
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(HERE, "cladeweave"), tmp_path / "cladeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    assert "quartet_scores" in said[0].split() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in said[0].split())
    assert set(said[1].split()) <= set(said[0].split())
