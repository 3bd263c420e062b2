"""Every core query against its SQL, and a smoke run of those without."""

import pytest
from conftest import rows_of, same_as_sql

from leafgauge.plans import candidate_queries, nested_queries, ocr_queries, region_queries, review_queries

MODULES = (nested_queries, ocr_queries, region_queries, candidate_queries, review_queries)
QUERIES = {n: f for m in MODULES for n, f in m.queries().items()}
SQL = {n: s for m in MODULES for n, s in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same_as_sql(duck, df, SQL[name])
    else:
        assert df.columns and rows_of(df) is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())


def test_bootstrap_replicates(spark, data, monkeypatch):
    """Both bootstraps are registered with the reference's replicates."""
    seen = []
    monkeypatch.setattr(candidate_queries.translation, "paired_bootstrap", lambda df, a, b, metric, replicates, seed: seen.append((replicates, seed)) or df.limit(0))
    monkeypatch.setattr(ocr_queries.ocr, "bootstrap", lambda pred, replicates, seed: seen.append((replicates, seed)))
    candidate_queries.paired_bootstrap_ci(spark, data)
    ocr_queries.arbitration_bootstrap_ci(spark, data)
    assert seen == [(5000, 20260815)] * 3 + [(5000, 20260811)]
