import math
import os

import pytest

from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
#: One plan of each kind; the driver compares all of them at a larger size.
NAMES = ["engagement_graph", "signed_links_mutual", "cofollow_jaccard", "bits_rollup", "reply_chain", "seeded_walks", "threshold_calibration", "dedup_rollup", "tfidf_terms", "local_metrics"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_plan_is_callable_and_oracles_belong_to_plans():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns

    def ordered(rows):
        clean = [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
        return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))

    assert ordered(map(tuple, df.select(*columns).collect())) == ordered(want.select(*columns).fetchall())
