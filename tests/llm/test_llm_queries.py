"""Every query runs over the smallest tables and has the columns it promises."""

import pytest

from cantorium.llm import queries

ROWS = {"documents": 200, "embeddings": 500}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got)
    if name.split("_")[0] in ("op2", "op3", "op4", "op5", "op7", "op8", "op9"):
        assert len(got) == ROWS["documents"] and got["doc_id"].is_unique
