import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "collatio"):
        source = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "collatio" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'semantic_matches' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_queries_have_their_sql():
    sys.path.insert(0, REPO)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 30


def test_library_does_not_import_the_optional_parts():
    for top, _, files in os.walk(os.path.join(REPO, "collatio")):
        if os.path.basename(top) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(top, f)).read())
