"""The contract of the entry module, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_subpackage():
    code = "import sys; sys.modules['meshloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert done.returncode == 0, done.stderr


def test_a_broken_import_in_the_subpackage_is_an_error():
    code = "import sys; sys.modules['unicodedata'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert done.returncode != 0 and "unicodedata" in done.stderr
