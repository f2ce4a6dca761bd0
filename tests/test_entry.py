import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_folders(tmp_path):
    """The rest works when that subpackage and the pipeline are gone."""
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(REPO / "ledgerloom"), str(tmp_path / "x")], check=True)
    copy.mkdir()
    (tmp_path / "x").rename(copy / "ledgerloom")
    subprocess.run(["rm", "-rf", str(copy / "ledgerloom/llm")], check=True)
    (copy / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert 'fiscal_yoy' in e.queries() and not any(x.startswith('op') or x == 'pipeline' for x in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
