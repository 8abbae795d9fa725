import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["meeting_id", "speaker_id"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_part(tmp_path):
    for name in ("parlance", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "parlance" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'align_segments' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
