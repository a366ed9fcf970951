"""The driver's contract, with and without the optional training-data part."""

import ast
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["Type", "xStart"] and out.count() >= 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "strandmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_clusters_need_a_shared_folder():
    from strandmill.storage import shared_path

    class Session:
        def __init__(self, **conf):
            self.sparkContext, self.conf = self, conf

        def getConf(self):
            return {k.replace("_", "."): v for k, v in self.conf.items()}

    assert shared_path(Session(spark_master="local[4]"), "x").startswith("file:///tmp/")
    assert shared_path(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://h/c/"), "x").startswith("hdfs://h/c/x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="share"):
            shared_path(Session(spark_master=master), "x")


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "strandmill", tmp_path / "strandmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
