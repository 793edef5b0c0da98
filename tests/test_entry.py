import subprocess
import sys

CODE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("auralake.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
"""


def test_entry_works_without_the_optional_part():
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
