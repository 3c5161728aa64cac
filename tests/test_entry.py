import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op1_') for n in q))"


def test_entry_counts_outcomes(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"split", "reason", "n"} == set(rows[0].asDict())


def test_imports_without_training_operators(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "lingweave", tmp_path / "lingweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    n, has = said.stdout.split()
    assert int(n) > 50 and has == "False"


@pytest.mark.parametrize("name", ["clean_reason_counts", "preaudit_dropped", "label_filter_good", "split_token_stats", "top_long_words", "bleu_stats", "audit_settle", "early_stopping"])
def test_queries_match_sql(spark, name):
    from lingweave.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    expected = sorted(map(repr, found.fetchall()))
    df = QUERIES[name](spark, DATA).select(*found.columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected
