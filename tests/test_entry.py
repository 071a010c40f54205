"""Driver contract: entry() runs and every query key has a builder; oracle keys are a subset."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "earnings_date", "filing_type", "pre_price", "post_price", "price_change_pct",
                          "volume_change_pct", "direction"]
    assert df.count() > 0


def test_registry_shapes():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def test_imports_without_the_training_data_part(tmp_path):
    """With the llm folders deleted, with and without the pipeline's file, the library's own queries remain."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "ledgerlens"), tmp_path / "ledgerlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    show = "import __spark_entry__ as e; names = set(e.queries()); assert 'price_reaction' in names; assert not any(n.startswith('op') or n == 'pipeline' for n in names); e.oracle_sql()"
    for extra in ([], ["corpus_pipeline.py"]):
        for name in extra:
            if os.path.exists(os.path.join(root, name)):
                shutil.copy(os.path.join(root, name), tmp_path)
        subprocess.run([sys.executable, "-c", show], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
