"""Every core query against its SQL on the smallest tables, and what must hold for those without SQL."""

import pytest

from scriptoria.plans.oracle import ORACLE_SQL
from scriptoria.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, oracle, same, name):
    same(QUERIES[name](spark, sf_dir), oracle, ORACLE_SQL[name])


def test_every_query_with_sql_is_registered():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"pack_chunks", "topic_pages", "clean_text", "page_text", "near_duplicates", "package_files", "debug_files", "line_diffs", "line_alignments"}


def test_entry_without_the_llm_folders(tmp_path):
    """The entry file works in a copy that lacks the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "scriptoria", tmp_path / "scriptoria", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'reference_facts' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_manuals_of_one_small_file_are_spread(spark, sf_dir):
    """A part's row is small and its manual much work: one task for a whole file would leave the other cores idle."""
    from pyspark.sql import functions as F

    from scriptoria.sources import tables

    sizes = [r["count"] for r in tables.manuals(spark, sf_dir).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) <= sum(sizes) / 4
