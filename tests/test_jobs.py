"""Brute-force, round-trip and metamorphic checks of the heavier jobs."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import explain as X
from revlens.operators import subword as SW
from revlens.sources import io
from tests.conftest import SF_ORACLE, SF_SMALL


def _brute_earliest(rows, d):
    out = {}
    for g, r, p in rows:
        best = None
        for g2, r2, p2 in rows:
            if g2 == g and r2 < r and X.Phrase(p2, d).alike(X.Phrase(p, d)):
                best = r2 if best is None else min(best, r2)
        out[(g, r)] = best
    return out


def test_phrase_containment_matches_brute_force(spark):
    random.seed(11)
    words = ["ab", "b", "abc", "ca", "a", "bca"]
    rows = []
    for g in ("g1", "g2"):
        phrases = sorted({" ".join(random.choice(words) for _ in range(4)) for _ in range(80)})
        rows += [(g, i, p) for i, p in enumerate(phrases)]
    df = spark.createDataFrame(rows, "g string, rank int, phrase string")
    for d in (1, 2, 3):
        got = {(r.g, r.rank): r.earliest_similar for r in X.earliest_similar(df, ["g"], "rank", d).collect()}
        assert got == _brute_earliest(rows, d), d
    assert any(v is not None for v in got.values())


def test_phrase_containment_of_long_and_empty_tokens(spark):
    """Tokens of 1,000 characters, empty tokens and short phrases follow the same rule."""
    long = "x" * 1000
    rows = [("g", i, p) for i, p in enumerate([f"{long} b c d", "xxx b c d", f"q{long} bb c d", "b", "", f"a  {long} e", f"zx  {long}{long} e f", "c d", "d c d c"])]
    df = spark.createDataFrame(rows, "g string, rank int, phrase string")
    for d in (2, 3):
        got = {(r.g, r.rank): r.earliest_similar for r in X.earliest_similar(df, ["g"], "rank", d).collect()}
        assert got == _brute_earliest(rows, d), d
    assert X.earliest_similar(df.limit(0), ["g"], "rank", 2).collect() == []


def test_bpe_round_trip(spark):
    texts = ["привіт пан степан", "привіт привіт пане", "the cat sat", "the cats sat on the mat"] * 6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, text string")
    words = SW.word_types(df, "text")
    merges, vocab = SW.train_bpe(words, min_frequency=2, max_merges=30, max_types=7)
    v = {r.token: r.id for r in vocab.collect()}
    assert v["[UNK]"] == 0 and v["[PAD]"] == 1 and len(merges) > 5
    enc = SW.encode_texts(df, "review_id", "text", merges, vocab).collect()
    for r in enc:
        decoded = "".join(r.tokens).replace("</w>", " ").split()
        assert decoded == texts[r.review_id].split()
        assert 0 not in r.ids


def test_language_id_accuracy(spark):
    import __spark_entry__ as E
    rows = E.queries()["d04_language_id"](spark, SF_ORACLE).collect()
    acc = sum(r.lang == r.pred for r in rows) / len(rows)
    assert acc > 0.9, acc


def test_literal_lines_fallback(spark):
    path = io.scratch_path(spark, "t-lit")
    lines = ["{'a': 'x', 'b': '1'}", "", "{'a': True, 'b': None}", "{'a': \"it's\", 'b': '2'}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted((r.a, r.b) for r in io.read_literal_lines(spark, path, "a string, b string").collect())
    assert got == sorted([("x", "1"), ("True", None), ("it's", "2")])
    broken = io.scratch_path(spark, "t-lit-broken")  # a broken line fails the read, it is not left out
    spark.createDataFrame([(x,) for x in [*lines, "not a dict"]], "value string").coalesce(1).write.text(broken)
    with pytest.raises(Exception, match="SyntaxError|invalid syntax"):
        io.read_literal_lines(spark, broken, "a string, b string").collect()


def test_csv_multiline_legacy_charset(spark):
    path = io.scratch_path(spark, "t-csv")
    rows = [("Добре; дуже\nдобре", 5.0), ('Погано "так"', 1.0)]
    df = spark.createDataFrame(rows, "comment string, rating double")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.coalesce(1).write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"') \
        .option("encoding", "windows-1251").csv(path)
    back = io.read_reviews_csv(spark, path, sep=";", encoding="windows-1251", schema="comment string, rating double")
    assert sorted(back.collect()) == sorted(df.collect())


def test_streaming_ingest_resumes(spark):
    from revlens.streaming.resume import ingest_pages_stream
    src, out = io.scratch_path(spark, "t-src"), io.scratch_path(spark, "t-out")
    pages = spark.createDataFrame([("e1", 1, "<article><p>a<p>b</article>"), ("e2", 2, "<article><p>c</article>")],
                                  "entity string, page long, html string")
    pages.write.partitionBy("entity", "page").text(src)
    first = ingest_pages_stream(spark, src, out).count()
    more = spark.createDataFrame([("e3", 3, "<article><p>d</article>")], "entity string, page long, html string")
    more.write.mode("append").partitionBy("entity", "page").text(src)
    second = ingest_pages_stream(spark, src, out)
    assert first == 2 and second.count() == 3
    assert {(r.entity, r.n_blocks) for r in second.collect()} == {("e1", 2), ("e2", 1), ("e3", 1)}


def test_results_independent_of_partition_count(spark):
    import __spark_entry__ as E
    q = E.queries()
    keys = ["g01_stratified_split", "g02_stratified_kfold", "h05_seeded_shuffle", "j10_top_phrases"]
    before = {k: sorted(map(tuple, q[k](spark, SF_SMALL).collect())) for k in keys}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        after = {k: sorted(map(tuple, q[k](spark, SF_SMALL).collect())) for k in keys}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after


def test_tfidf_pipeline_equals_sql_long_form(spark):
    from pyspark.ml.functions import vector_to_array
    from revlens.operators import models as ML
    from revlens.plans.common import cleaned
    from revlens.plans.q_text import D12_STOP
    docs = cleaned(spark, SF_SMALL).select("review_id", "review_translate")
    feats = ML.fit_tfidf(docs, "review_translate", D12_STOP, ngram_max=2, min_df=2.0, max_df=0.848)
    terms = ML.fitted_terms(spark, feats)
    dense = feats.transform(docs).select("review_id", vector_to_array("features").alias("v"))
    long_ml = {(r.review_id, r.term_idx): r.weight for r in
               ML.tfidf_with_vocabulary(docs, "review_translate", D12_STOP, 2, terms).collect()}
    long_sql = {(r.review_id, r.term): r.weight for r in
                ML.tfidf_long(docs, "review_translate", D12_STOP, 2, 2, 0.848).collect()}
    idx = {r.term_idx: r.term for r in terms.collect()}
    assert len(long_ml) == len(long_sql) > 0
    for (rid, j), w in long_ml.items():
        assert abs(long_sql[(rid, idx[j])] - w) < 1e-9
    for r in dense.collect():
        nz = {j: x for j, x in enumerate(r.v) if x != 0.0}
        assert all(abs(long_ml[(r.review_id, j)] - x) < 1e-9 for j, x in nz.items())


def _python_bpe(word_counts, min_frequency, max_merges):
    words = {tuple(list(w[:-1]) + [w[-1] + "</w>"]): n for w, n in word_counts.items()}
    merges = []
    for _ in range(max_merges):
        pairs = {}
        for syms, n in words.items():
            for a, b in zip(syms, syms[1:]):
                pairs[(a, b)] = pairs.get((a, b), 0) + n
        cand = [(-c, a, b) for (a, b), c in pairs.items() if c >= min_frequency]
        if not cand:
            break
        _, a, b = min(cand)
        merges.append((a, b))
        new = {}
        for syms, n in words.items():
            out, i = [], 0
            while i < len(syms):
                if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + n
        words = new
    return merges


def test_bpe_training_matches_python(spark):
    from collections import Counter
    random.seed(2)
    alphabet = "abcab.dé"
    texts = [" ".join("".join(random.choice(alphabet) for _ in range(random.randint(1, 6))) for _ in range(12))
             for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, text string")
    counts = Counter(w for r in SW.word_types(df, "text").collect() for w in [r.word] for _ in range(r.n))
    merges, _ = SW.train_bpe(SW.word_types(df, "text"), min_frequency=3, max_merges=25, max_types=12, max_pairs=3)
    assert merges == _python_bpe(counts, 3, 25)


def test_bpe_two_thousand_merges(spark):
    """The whole run against a plain trainer: gathered rounds, single merges of hot pairs, equal counts, repeated tokens."""
    rng = random.Random(12)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    counts = {}
    while len(counts) < 900:
        counts["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))] = rng.choice([1, 2, 3, 3, 3, 5, 40])
    types = spark.createDataFrame([(w, n, [*w[:-1], w[-1] + SW.SUFFIX]) for w, n in counts.items()], "word string, n long, syms array<string>")
    want = _python_bpe(counts, 3, 2000)
    merges, vocab = SW.train_bpe(types, min_frequency=3, max_merges=2000, max_types=700, max_pairs=400)
    assert len(want) > 900 and merges == want
    tokens = [r["token"] for r in vocab.orderBy("id").collect()]
    assert len(tokens) == len(set(tokens)) and tokens[:2] == SW.SPECIALS and set(tokens) >= {a + b for a, b in merges}
    ranks = {p: i for i, p in enumerate(merges)}
    for w in list(counts)[:200]:
        syms = [*w[:-1], w[-1] + SW.SUFFIX]
        for pair in merges:
            syms = SW.merged_symbols(syms, pair)
        assert SW.bpe_encode_word(w, ranks) == syms


def test_bpe_hot_pairs_share_rounds(spark, monkeypatch):
    """Pairs that stand in more types than the bound are merged many to a round, in the exact order."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwx"
    counts = {}
    while len(counts) < 600:
        counts["".join(rng.choices(letters, [2.0 ** -(i / 2) for i in range(len(letters))], k=rng.randrange(2, 7)))] = rng.randrange(1, 300)
    types = spark.createDataFrame([(w, n, [*w[:-1], w[-1] + SW.SUFFIX]) for w, n in counts.items()], "word string, n long, syms array<string>")
    rounds = []
    pairs = SW._pairs
    monkeypatch.setattr(SW, "_pairs", lambda t: rounds.append(1) or pairs(t))
    merges, _ = SW.train_bpe(types, min_frequency=200, max_merges=200, max_types=100)
    want = _python_bpe(counts, 200, 200)
    assert len(want) == 200 and merges == want
    assert 0 < len(rounds) <= 40, len(rounds)


def test_bpe_runs_and_onward_merges():
    pairs = {("a", "b"), ("b", "c"), ("x", "x")}
    assert SW.runs(list("abcxxxa"), pairs) == [("a", "b", "c"), ("x", "x", "x")] and SW.runs([], pairs) == [] == SW.runs(["a"], pairs)
    ranks = {("abc", "d"): 0, ("a", "b"): 1, ("ab", "c"): 2}
    assert SW.ranked_merges(list("abcd"), ranks) == ["abcd"] and SW.ranked_merges(list("abcd"), ranks, onward=True) == ["abc", "d"]


def test_batch_encode_marks_and_cuts(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [7, 8, 9, 10, 11])], "review_id long, ids array<int>")
    got = {r["review_id"]: (r["input_ids"], r["attention_mask"]) for r in SW.batch_encode(df, 5, 1, 90, 91).collect()}
    assert got == {1: ([90, 5, 6, 91, 1], [1, 1, 1, 1, 0]), 2: ([90, 91, 1, 1, 1], [1, 1, 0, 0, 0]), 3: ([90, 7, 8, 9, 91], [1] * 5)}
    plain = {r["review_id"]: r["input_ids"] for r in SW.batch_encode(df, 4, 0).collect()}
    assert plain == {1: [5, 6, 0, 0], 2: [0] * 4, 3: [7, 8, 9, 10]}


def test_out_of_fold_invariants(spark):
    import __spark_entry__ as E
    rows = E.queries()["j06_out_of_fold"](spark, SF_SMALL).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.member, []).append(r.review_id)
        assert abs(sum(r.y_predicted_proba) - 1.0) < 1e-6
    ids = set(seen["logistic"])
    assert len(seen["logistic"]) == len(ids) and set(seen["bayes"]) == ids


def test_udf_queries_run_from_another_folder(tmp_path):
    """Executors must import the package even when the driver runs elsewhere."""
    import subprocess
    import sys
    import textwrap
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as E
        q = E.queries()
        n = q["l01_row_function"](spark, {SF_SMALL!r}).count() + q["b01_parsed_blocks"](spark, {SF_SMALL!r}).count()
        print("ROWS", n)
    """)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS" in out.stdout


def test_explanation_table_has_the_models_labels(spark):
    """Every test row once, with the label that the fitted model itself predicts."""
    from revlens.plans import q_models as Q
    test, feats, lr = Q.linear_model(spark, SF_SMALL)
    want = {r.review_id: int(r.prediction) for r in lr.transform(feats.transform(test)).select("review_id", "prediction").collect()}
    got = {r.review_id: r for r in Q.j15(spark, SF_SMALL).collect()}
    assert {k: r.predicted_label for k, r in got.items()} == want
    assert all(len(t) <= 10 for r in got.values() for t in r.terms_by_label.values())


def test_surrogate_keeps_every_word(spark):
    """One coefficient per class and word of each test row, in text order."""
    from revlens.functions import text as T
    from revlens.plans import q_models as Q
    d = Q.labelled(spark, SF_SMALL)
    k = int(Q.n_classes(d))
    want = {r.review_id: r.w for r in d.filter("split = 'test'").select("review_id", T.tokenize(F.lower("review_translate")).alias("w")).collect()}
    rows = {}
    for r in Q.j13(spark, SF_SMALL).collect():
        rows.setdefault((r.review_id, r.label), []).append((r.pos, r.word))
    assert {i: [w for _, w in sorted(v)] for (i, c), v in rows.items() if c == 0} == {i: w for i, w in want.items() if w}
    assert {c for _, c in rows} == set(range(k))


def test_batch_scores_are_distributions(spark):
    """Every cleaned review once, probabilities that sum to one, the first arg-max as prediction."""
    from revlens.plans import q_models as Q
    rows = Q.j08(spark, SF_SMALL).collect()
    assert len(rows) == len({r.review_id for r in rows}) == Q.labelled(spark, SF_SMALL).count()
    for r in rows:
        assert abs(sum(r.y_predicted_proba) - 1) < 1e-6 and r.y_pred == max(range(len(r.y_predicted_proba)), key=r.y_predicted_proba.__getitem__)


def test_out_of_fold_covers_each_row_once_a_member(spark):
    """One row per review and member, every fold used, probabilities that sum to one."""
    from collections import Counter
    from revlens.plans import q_models as Q
    rows = Q.j06(spark, SF_SMALL).collect()
    n = Q.labelled(spark, SF_SMALL).count()
    members = Counter(r.member for r in rows)
    assert set(members.values()) == {n} and len({(r.review_id, r.member) for r in rows}) == len(rows)
    assert {r.fold for r in rows} == set(range(5)) and all(abs(sum(r.y_predicted_proba) - 1) < 1e-6 for r in rows)


def test_coefficient_table_reads_saved_models(spark):
    """Multinomial and binomial models, dense and compressed: the same numbers as the model's own matrix."""
    import uuid
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from revlens.operators import models as ML
    from revlens.session import ensure_checkpoint_dir
    rng = random.Random(1)
    for labels, sparse in ((3, 0.0), (2, 0.0), (3, 0.9)):
        rows = [(float(i % labels), Vectors.sparse(40, {(7 * (i % labels) + k): 1.0 for k in rng.sample(range(6), 2)})) for i in range(60)]
        model = LogisticRegression(maxIter=20, regParam=0.05, elasticNetParam=sparse).fit(spark.createDataFrame(rows, ["label", "features"]))
        path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
        model.write().save(path)
        got = {(r.label, r.term_idx): r.coef for r in ML.coefficient_table(spark.read.schema(ML.SAVED_MATRIX).parquet(path + "/data")).collect()}
        m = model.coefficientMatrix.toArray()
        want = {(i, j): m[i, j] for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]}
        assert got == want and want


def test_contributions_of_a_stored_table(spark):
    weights = spark.createDataFrame([(1, "a", 0, 0.5), (1, "b", 1, 0.5), (1, "c", 2, 0.1), (2, "a", 0, 1.0)], "review_id long, term string, term_idx int, weight double")
    coefs = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 0, 9.0), (0, 1, -2.0)], "term_idx int, label int, coef double")
    from revlens.operators.models import contributions
    got = sorted(map(tuple, contributions(weights, coefs, 2).collect()))
    assert got == [(1, 0, 0, "c", 0.9), (1, 0, 1, "a", 0.5), (1, 1, 0, "a", -1.0), (2, 0, 0, "a", 1.0), (2, 1, 0, "a", -2.0)]



def test_table_function_takes_texts_by_the_batch(spark):
    """l03: one call of the table function serves a whole batch, longer than the texts it holds tokens of at a time."""
    import pyarrow as pa
    from revlens.functions import udfs as U
    texts = [None, "", "Good room, bad-tempered cat!", " \n", *[f"w{i} x" for i in range(2 * U.TEXT_SLICE)], None, "é_1 ?!"]
    ids = [*range(len(texts) - 2), None, 0]
    want = [(i, p, m.group(0)) for i, t in zip(ids, texts) if t is not None for p, m in enumerate(U.PY_TOKEN.finditer(t))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["review_id", "review"])
    tables = list(U.TokensUDTF.func().eval(batch))
    assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == want
    assert len(tables) == 3
    from revlens.session import ship_package
    ship_package(spark)
    got = U.TokensUDTF(spark.createDataFrame(list(zip(ids, texts)), "review_id bigint, review string").asTable())
    assert got.schema.simpleString() == "struct<review_id:bigint,pos:int,token:string>"
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_texts_are_encoded_where_they_lie(spark):
    """No word is shuffled: one exchange deals the texts.  A key of several texts has their pieces by place, a text without words no row."""
    merges = [("t", "h"), ("th", "e</w>"), ("c", "a")]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "[PAD]", "c", "a", "t</w>", "th", "the</w>", "ca"])], "token string, id int")
    df = spark.createDataFrame([(1, "The cat"), (2, "cat"), (2, "the the"), (3, "  "), (4, None), (None, "cax")], "k long, text string")
    enc = SW.encode_texts(df, "k", "text", merges, vocab)
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r.k: (r.ids, r.tokens) for r in enc.collect()} == {
        1: ([6, 7, 4], ["the</w>", "ca", "t</w>"]), 2: ([6, 7, 4, 6], ["the</w>", "ca", "t</w>", "the</w>"]), None: ([7, 0], ["ca", "x</w>"])}


def test_words_of_long_texts_cross_batches(spark):
    """Words and texts that go on in the next Arrow batch are whole, whatever the batch."""
    from revlens.operators import tokens as K
    rows = [(k, p, "b</w>" if p % 7 == 6 else "a", float(p)) for k in (1, 2) for p in range(700 * k)] + [(None, 0, "c", None)]
    df = spark.createDataFrame(rows, "review_id long, pos int, token string, score double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {(r.review_id, r.pos): (r.token, r.score) for r in K.word_scores(df).collect()}
        lists = {r.review_id: (r.token, r.score) for r in K.word_scores(df, lists=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {**{(k, g): ("aaaaaab", sum(range(7 * g, 7 * g + 7))) for k in (1, 2) for g in range(100 * k)}, (None, 0): ("c", None)}
    assert lists == {**{k: (["aaaaaab"] * 100 * k, [float(sum(range(7 * g, 7 * g + 7))) for g in range(100 * k)]) for k in (1, 2)}, None: (["c"], [None])}


def _stored_rows(spark):
    """Rows that stand in the tables written by ``stored``."""
    import glob
    from revlens.session import ensure_checkpoint_dir
    folders = glob.glob(ensure_checkpoint_dir(spark).removeprefix("file://").rstrip("/") + "/stored-*")
    return sum(spark.read.parquet(f).count() for f in folders if glob.glob(f + "/*.parquet"))


def test_tables_that_nothing_reads_any_more_are_removed(spark):
    """A ranking keeps its rows once, the containment and the diversification none of their passing tables."""
    from revlens.operators.ranking import rank_within
    rows = [("g", f"w{i} x{i % 7} y{i % 5} z", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, phrase string, score double").repartition(4)
    before = _stored_rows(spark)
    ranked = rank_within(df, ["g"], [F.col("score").desc(), F.col("phrase")], pos="rank", size=None)
    assert _stored_rows(spark) - before < 2 * len(rows)
    assert [r.rank for r in ranked.orderBy(F.desc("score")).collect()] == list(range(400))
    before = _stored_rows(spark)
    best = X.diversify(df, ["g"], 5, 2, first_batch=16)
    assert _stored_rows(spark) == before and best.count() == 5
    similar = X.earliest_similar(ranked, ["g"], "rank", 2)
    assert _stored_rows(spark) - before < 3 * len(rows) and similar.count() == 400
