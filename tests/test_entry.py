"""What the driver imports, without a session and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code: str, folder: Path) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout


def test_entry_imports_before_there_is_a_session():
    told = run("import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))", ROOT)
    assert told.split() == ["True", "True"]


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "quorana"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (ROOT / "quorana").iterdir():
        if part.name != "llm":
            (tmp_path / "quorana" / part.name).symlink_to(part)
    # the entry file's own folder is searched first, so it is copied
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    told = run("import __spark_entry__ as e; print(len(e.queries()) > 100, any(q.startswith('op1') or q == 'pipeline' for q in e.queries()))", tmp_path)
    assert told.split() == ["True", "False"]
