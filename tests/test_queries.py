"""Every query with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from assayer.plans.queries import ORACLE_SQL, QUERIES
from assayer.plans.views import load

SF = "/root/testdata/sf0.001"
#: Queries that call a scorer, or read files as streams.
PYTHON = {"judged_predictions", "file_digests", "large_gold_files"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.4f}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    out = QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in out.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_refused_rows_are_failed(spark):
    """A refused row has no output: it is counted with the failed ones, as is one that nothing matches."""
    rows = [(r.model_short, r.condition) for r in load(spark, SF, "v_judged").where("decision_method IN ('unmatched', 'content_filtered')").collect()]
    out = QUERIES["run_stats"](spark, SF).collect()
    assert {(r.model_short, r.condition): r.failed for r in out if r.failed} == {g: rows.count(g) for g in set(rows)}
    assert all(r.content_filtered <= r.failed and r.successful + r.failed == r.total_samples for r in out)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
