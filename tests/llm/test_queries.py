"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from revlens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels", "embeddings", "conversations")
COLUMNS = {
    "op1": ["doc_id", "licenses", "n_units", "best_dice"], "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3": ["doc_id", "item_id"], "op4": ["doc_id", "held_out", "score", "predicted"], "op5": ["doc_id", "fingerprint", "component_id"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9": ["page_id", "url", "text", "n_chars"],
    "op10": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12": ["query_id", "rank", "vec_id", "score"],
    "op13": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


def test_every_operator_is_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"{op}_") for n in names) == 1 for op in COLUMNS) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = E.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = E.queries()[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.split("_")[0] in ("op12", "op13"):
        n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0" if name.startswith("op12") else "true").count()
        assert df.count() == n * (20 if name.startswith("op12") else 16)
    elif name.split("_")[0] not in ("op1", "op3", "op11"):
        table = "pages" if name.startswith("op9") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stage_by_stage(spark):
    from revlens.llm import decontaminate, secrets, simhash, toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = {r["doc_id"]: r for r in docs.collect()}
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        kept = {r["doc_id"]: r for r in out.collect()}
        assert out.schema.simpleString() == docs.schema.simpleString() and set(kept) <= set(ids)
        gone = set(ids) - set(kept)
        if name == "toxicity":
            assert gone == {r["doc_id"] for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
        elif name == "simhash":
            assert gone == {r["doc_id"] for r in simhash.simhash_components(docs).where("doc_id <> component_id").collect()}
        elif name == "decontamination":
            assert gone == {r["doc_id"] for r in decontaminate.contained_items(docs, items).collect()}
        else:
            live = {r["doc_id"] for r in secrets.report(docs).where("n_live > 0").collect()}
            assert not gone and {i for i in ids if kept[i]["text"] != ids[i]["text"]} == live
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
        docs = out
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {i: r["decoded"] for i, r in last.items()} == {r["doc_id"]: r["text"] for r in docs.collect()}
