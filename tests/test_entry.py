import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"


def run(where):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, capture_output=True, text=True)


def copied(to, *, without=()):
    shutil.copytree(os.path.join(HERE, "pericell"), to / "pericell", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(HERE, name)):
            shutil.copy(os.path.join(HERE, name), to / name)
    return to


def test_entry_without_the_training_data_part(tmp_path):
    where = copied(tmp_path, without=("corpus_pipeline.py",))
    shutil.rmtree(where / "pericell" / "llm", ignore_errors=True)
    out = run(where)
    assert out.returncode == 0, out.stderr
    queries, oracles, some = out.stdout.split()
    assert int(queries) >= 56 and int(oracles) >= 55 and some == "False"


def test_other_import_errors_show(tmp_path):
    where = copied(tmp_path)
    (where / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    out = run(where)
    assert out.returncode and "a_module_that_is_missing" in out.stderr
