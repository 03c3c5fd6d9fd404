import subprocess
import sys


def test_entry_imports_without_a_session_and_pairs_queries_with_sql():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 40; assert not any(k.startswith('p') and k[1:2].isdigit() and not callable(f) for k, f in q.items())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
