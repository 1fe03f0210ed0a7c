from pathlib import Path

import pytest

from hostile import FOLDER, variant
from tidemill.llm.queries import REGISTRY

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


PLAIN: dict = {}


@pytest.mark.parametrize("kind", ["empty", "nulls", "reference nulls", "extra", "repeated"])
def test_no_crash(spark, tmp_path, kind):
    folder = variant(spark, tmp_path, kind)
    for name, query in REGISTRY.queries.items():
        if name not in PLAIN:
            PLAIN[name] = query(spark, FOLDER).toPandas()
        plain = PLAIN[name]
        got = query(spark, folder).toPandas()
        assert list(got.columns) == list(plain.columns), name
        if kind == "empty" and name == "p9_valid":
            assert got.values.tolist() == [[0, 0, 0, 0]]
        elif kind == "empty":
            assert len(got) == 0, name
        if kind in ("extra", "repeated"):
            assert sorted(str([list(v) if hasattr(v, "tolist") else v for v in r]) for r in got.values.tolist()) == sorted(str([list(v) if hasattr(v, "tolist") else v for v in r]) for r in plain.values.tolist()), name
