import os
import subprocess
import sys

import pytest

import corpus_pipeline

from .test_operators import brute_classes

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    from scribelake.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF))
        assert after.columns == columns, name
        assert 0 < after.count() <= docs.count()
        if name == "n-gram Jaccard join":
            want = {d for d, (c, _) in brute_classes([(r.doc_id, r.text) for r in docs.collect()]).items() if c == d}
            assert {r.doc_id for r in after.collect()} == want
        docs = after
    mixed = corpus_pipeline.run(spark, SF)
    assert mixed.count() == docs.count() and "taken" in mixed.columns


def test_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry module still gives the other queries."""
    copy = tmp_path / "copy"
    ignore = lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")]
    import shutil

    shutil.copytree(ROOT, copy, ignore=ignore)
    (copy / "scribelake" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
