"""A cross-section of the registered queries against their SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as registry
from verification.compare import check, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["tokenize", "carry_context", "detect_names", "choose_strategy", "bm25_search", "bm25_search_shards", "knn_search",
         "rerank", "expand_section", "dedup_pool", "pack_context", "retrieve", "upsert_status", "stream_labels"]


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    report = check(spark, SF_DIR, name, registry.queries()[name], registry.oracle_sql()[name], connect(SF_DIR))
    assert report.startswith("ok"), report


def test_all_but_the_corpus_operators_works_without_them(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(registry.__file__))
    for folder in ("leafquery", "verification"):
        shutil.copytree(os.path.join(root, folder), tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; names = list(e.queries()); assert len(names) > 90 and not any(n.startswith('op') and n[2].isdigit() for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
