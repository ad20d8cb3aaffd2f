"""Every registered query of the catalogue against its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sonaril.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("ids", [[0, 1, 2, 767454], [*range(-25, 0)]])
def test_lines_of_rounding_ties_and_of_no_length(spark, tmp_path, ids):
    """-0.0975f * 200 is a tie in single precision only; ids below 0 give lengths of 0 and less."""
    v = pd.DataFrame({"vec_id": ids, "embedding": [[-0.0975, 0.0875] + [0.0] * 62 if i % 2 else [0.2075, -0.0975] + [0.0] * 62 for i in ids]})
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(catalog.SQL["floor_render_line"]).df()
    got = catalog.QUERIES["floor_render_line"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(want)
