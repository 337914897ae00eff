"""The driver's contract, with and without the operators that can be taken away."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["key", "value", "position"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    for name in ("stratalog", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "stratalog" / "llm", ignore_errors=True)
    said = subprocess.run(
        [
            sys.executable, "-c",
            "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))",
        ],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True,
    )
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 60 and said.stdout.split()[1] == "0"
