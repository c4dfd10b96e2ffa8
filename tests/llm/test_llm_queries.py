"""Registered queries of the text operators against their SQL on the smallest tables."""

import pandas as pd
import pytest

from pagewright.llm import queries as llm
from tests.test_queries import DIR, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    got, want = llm.QUERIES[name](spark, DIR).toPandas(), duck.execute(llm.ORACLE[name]).fetch_df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["page_id"]), ("p2_found", ["page_id", "page_kind"]), ("p4_found", ["msg_id", "defect"]), ("p5_found", ["page_id", "lang"]), ("p6_found", ["page_id", "start_pos", "end_pos"]), ("p8_found", ["doc_id", "item_id"])])
def test_columns_and_distinct_rows(spark, name, columns):
    got = llm.QUERIES[name](spark, DIR).toPandas()
    assert list(got.columns) == columns and not got.duplicated().any() and len(got)
