"""What the plans hand to the learner: weights, caps, and no weight where the loss takes none."""

import pytest
from pyspark.sql import functions as F

from premia.operators import boost, submit
from premia.plans import fitting, standard
from premia.roles import PRICE_COLS
from premia.sources.quotes import quotes


@pytest.fixture(scope="module")
def rows(spark):
    return quotes(spark, "/root/testdata/sf0.001").cache()


def handed_over(monkeypatch, rows, **how):
    seen = []

    def record(packed, names, binning, params, store=None):
        seen.append(packed.where("NOT _valid").agg(F.min("_w"), F.max("_w"), F.max("_y"), F.count("*")).first())
        return {}

    monkeypatch.setattr(boost, "fit_rows", record)
    standard.fit(rows, boost.preset("rmse"), insurers=("A",), family="dates", **how)
    return seen[0]


def test_recency_weights_reach_the_learner(rows, monkeypatch):
    low, high, _, _ = handed_over(monkeypatch, rows, weighted=True)
    assert (low, high) == (0.5, 1.0)
    assert handed_over(monkeypatch, rows)[:2] == (1.0, 1.0)


def test_caps_reach_the_learner(rows, monkeypatch):
    plain, capped = handed_over(monkeypatch, rows), handed_over(monkeypatch, rows, capped=True)
    assert capped[2] < plain[2] and capped[3] == plain[3]


def test_merge_names_the_table_that_repeats_a_key(spark, rows):
    base = rows.select("quote_id", *PRICE_COLS).limit(20)
    with pytest.raises(ValueError, match="new table"):
        submit.keyed_merge(base, base.union(base.limit(1)))
    with pytest.raises(ValueError, match="Insurer_A_price"):
        submit.keyed_merge(base, base.drop("Insurer_A_price"))
    other = base.withColumnRenamed("quote_id", "id").limit(5)
    assert submit.keyed_merge(base, other, new_key="id").count() == 20
