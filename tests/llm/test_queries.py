"""The registered queries on the small tables, against their SQL where there is one."""

import pytest

from riskmart.llm import queries as Q
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in Q.ORACLES:
        want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall()
        assert sorted(map(str, rows)) == sorted(map(str, want))
    if name != "op5_fuzzy_lines":                # one row per document, vector, page or conversation
        table = {"op2": "embeddings", "op8": "pages", "op11": "conversations"}.get(name.split("_")[0], "documents")
        whole = Q.table(spark, SF_SMALL, table)
        assert len(rows) == (whole.select("conv_id").distinct() if table == "conversations" else whole).count()
