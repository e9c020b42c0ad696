"""Physical-plan checks: pruning and pushdown reach the scan, label tables
are broadcast, and no registered query plans a cross product."""

import pytest

import __spark_entry__ as E
import revlens.plans  # noqa: F401  (fills the registry)
from revlens.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

SKIP_HEAVY = {"j02_logistic_ovr", "j03_boosted_trees", "j04_random_search", "j05_per_dataset_grid",
              "j06_out_of_fold", "j08_batch_scoring", "j13_local_surrogate", "j14_linear_contributions",
              "j15_explanation_table", "d13_bpe_vocabulary", "d14_bpe_encode", "d16_id_token_roundtrip",
              "d21_subword_embeddings", "d22_word2vec", "j07_exclusion_from_models", "j10_model_explanation_flow", "d24_batch_encode", "k03_incremental_pages"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_reaches_scan(spark):
    df = E.queries()["a02_usecols"](spark, SF_SMALL)
    df.collect()
    s = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in s


def test_filter_pushed_to_scan(spark):
    df = E.queries()["e03_semi_join"](spark, SF_SMALL)
    s = df._jdf.queryExecution().toString()
    assert "EqualTo(quality,1)" in s and "ReadSchema: struct<doc_id:bigint,quality:int>" in s


def test_label_tables_are_broadcast(spark):
    df = E.queries()["g02_stratified_kfold"](spark, SF_SMALL)
    df.collect()
    assert "BroadcastHashJoin" in plan(df)


@pytest.mark.parametrize("key", sorted(k for k in REGISTRY if k not in SKIP_HEAVY))
def test_no_cross_products(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.collect()
    p = plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
