"""Tokens that are grouped by their text again stay where the text is."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("key", ["d07_pos_tags", "d10_drop_question_reviews", "d23_scored_ngrams", "j12_word_scores", "l04_partial_operator"])
def test_tokens_are_not_shuffled(spark, key):
    p = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in p and "Exchange" not in p[:p.index("Generate")]


def test_repeated_keys_meet_in_one_group(spark):
    from revlens.operators import tokens as K
    from revlens.plans.common import together
    r = spark.createDataFrame([(1, ["a", "b"]), (1, ["c", "d"]), (2, ["e"])], "review_id long, toks array<string>")
    t = together(r, r).select("review_id", F.posexplode("toks").alias("pos", "token"), F.lit(1.0).alias("score"))
    got = K.scored_ngrams(t, 4).collect()
    assert [(x.review_id, x.phrase) for x in got] == [(1, "a c b d")]
