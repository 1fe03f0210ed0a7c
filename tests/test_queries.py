"""Every registered query beside its SQL, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemill.plans import registries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
CORE = {name: f for r in registries() for name, f in r.queries.items()}
SQL = {name: s for r in registries() for name, s in r.oracles.items()}


def _unified(spark, got):
    """Every record of the files is in the table once, unless it repeats another of its file."""
    records = CORE["p1_records"](spark, FOLDER).toPandas().set_index("file_id").records
    rows = got[got.file_id.notna()].groupby("file_id").size()
    assert set(rows.index) == set(records.index) and (rows <= records.loc[rows.index]).all() and rows.sum() > 0.8 * records.sum()
    assert {"fund_master_v2", "legacy_fund_master"} <= set(got.source) and got.fund_id.notna().mean() > 0.9 and not got.astype(str).duplicated().any()


def _changes(spark, got):
    """Changes are of the known kinds, once each, and no column is added and renamed, or removed and retyped, at once."""
    assert set(got.change_kind) <= {"added", "removed", "renamed", "retyped"} and not got.duplicated().any()
    kinds = got.groupby(["file_id", "column_name"]).change_kind.apply(set)
    assert all(k in ({"added"}, {"removed"}, {"renamed"}, {"retyped"}, {"renamed", "retyped"}, {"added", "removed"}) for k in kinds)


def _minhash(spark, got):
    """Approximate pairs are a part of the exact ones: their distance is within the threshold."""
    exact = CORE["jaccard_match_exact"](spark, FOLDER).toPandas()
    assert len(got) <= (exact.ids_a * exact.ids_b).sum() and (got.distance <= 0.4 + 1e-9).all() and set(got.distance.round(6)) <= set(exact.distance.round(6))


def _lineage(spark, got):
    import json

    event = json.loads(got.event[0])
    assert event["output"] == "user_orders" and len(event["inputs"]) >= 1 and "o_orderkey" in event["columns"]


#: Queries that SQL does not state, and what their results must hold to.
CHECKS = {"p1_found": _changes, "p1_unified": _unified, "minhash_match": _minhash, "lineage_of_a_plan": _lineage}


def test_contract():
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in CORE


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    from compare import connect, normal

    df = CORE[name](spark, FOLDER)
    mine = df.toPandas()
    if name in SQL:
        theirs = connect(FOLDER).sql(SQL[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert normal(mine) == normal(theirs)
    else:
        CHECKS[name](spark, mine)


def test_the_core_stands_without_the_llm_package(spark, tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p8_ids' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
    # every other test can be imported, and a few that touch most modules pass
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "r", check=True, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "tests/test_history.py", "tests/test_avro.py"], cwd=tmp_path / "r", check=True, stdout=subprocess.DEVNULL)
