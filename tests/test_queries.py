"""Every registered query: the same rows as its SQL, or a plausible result where SQL can't say."""

import pytest

from quarrykit.plans import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()
MODELS = {"model_predictions", "hybrid_model_predictions", "factorised_predictions", "bfr_labels"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE) - MODELS))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_bfr_accounts_for_every_point(spark):
    rounds = registry.queries()["bfr_rounds"](spark, SF).collect()
    assert [r["round"] for r in rounds] == [1, 2, 3, 4, 5]
    assert [r.n_ds + r.n_cs + r.n_rs for r in rounds] == [100, 200, 300, 400, 500]


def test_boosted_model_beats_the_mean(spark):
    rows = registry.queries()["model_predictions"](spark, SF).toPandas()
    assert ((rows.rating - rows.model) ** 2).mean() < ((rows.rating - rows.rating.mean()) ** 2).mean()


def test_factorised_model_beats_the_mean(spark):
    rows = registry.queries()["factorised_predictions"](spark, SF).toPandas()
    assert ((rows.rating - rows.model) ** 2).mean() < ((rows.rating - rows.rating.mean()) ** 2).mean()


def test_flagship(spark):
    assert registry.flagship(spark, SF).limit(1).count() == 1
