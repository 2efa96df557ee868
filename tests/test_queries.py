"""Every registered query with SQL equals DuckDB; the others run and give rows."""

import pytest

import __spark_entry__
from relyframe.plans import queries

from compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    extra, missing, n, m = differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)
    assert not extra and not missing and n == m > 0


@pytest.mark.parametrize("name", ["glm_full", "frechet", "mahalanobis", "cv_species", "design_verdicts_scaled", "confidence_study", "difficulty_study", "familiarity_study", "track_linking", "frame_suppression"])
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/relyframe", tmp_path / "relyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_cells' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
