"""The registry where parts of the repository or its libraries are absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len(q), len(set(o) - set(q)))"


@pytest.mark.parametrize("case", ["whole", "no folder", "no pipeline", "no library"])
def test_engine_queries_without_the_rest(tmp_path, case):
    for name in ("sparsela", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    if not (tmp_path / "sparsela/llm").exists():
        case = "no folder"
    hide = ""
    if case == "no folder":
        shutil.rmtree(tmp_path / "sparsela/llm", ignore_errors=True)
    elif case == "no pipeline":
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    elif case == "no library":
        hide = "import sys; sys.modules['zstandard'] = None; "
    run = subprocess.run([sys.executable, "-c", hide + COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    engine, every, stray = map(int, run.stdout.split())
    assert engine > 180 and stray == 0
    assert every - engine == {"whole": 11, "no folder": 0, "no pipeline": 10, "no library": 0}[case]
