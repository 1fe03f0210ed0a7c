from pathlib import Path

import pytest

from hostile import FOLDER, variant
from tidemill.plans import registries

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
QUERIES = {n: f for r in registries() for n, f in r.queries.items() if n[0] == "p" and n[1].isdigit()}


PLAIN: dict = {}


@pytest.mark.parametrize("kind", ["empty", "nulls", "reference nulls", "extra", "repeated"])
def test_no_crash(spark, tmp_path, kind):
    folder = variant(spark, tmp_path, kind)
    for name, query in QUERIES.items():
        if name not in PLAIN:
            PLAIN[name] = query(spark, FOLDER).toPandas()
        plain = PLAIN[name]
        got = query(spark, folder).toPandas()
        assert list(got.columns) == list(plain.columns), name
        if kind == "empty":
            assert len(got) == 0, name
        if kind in ("extra", "repeated") and name != "p1_unified":
            assert sorted(map(str, got.values.tolist())) == sorted(map(str, plain.values.tolist())), name
