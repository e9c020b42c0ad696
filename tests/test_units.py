"""Literal unit fixtures (FIXTURES.md section 4) and invariants."""

import random

import pytest

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from revlens.functions import arrays as A
from revlens.functions import text as T
from revlens.operators import explain as X
from revlens.operators import metrics as M
from revlens.operators import sampling as S
from revlens.operators import tokens as K
from revlens.operators.ranking import rank_within


def one(spark, expr, **cols):
    df = spark.createDataFrame([Row(**cols)]) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_bubble_rating(spark):
    df = spark.createDataFrame([("bubble_45",), ("bubble_5",), ("bubble_50",)], "c string")
    assert [r.v for r in df.select(T.bubble_rating("c").alias("v")).collect()] == [4.5, 5.0, 5.0]


def test_path_segment(spark):
    assert one(spark, T.path_segment("u", -3), u="https://a/ua/foo/p123/comments/") == "p123"
    assert one(spark, T.path_segment("u", -3), u="a/b") is None


def test_strip_ordinal_and_locale(spark):
    assert one(spark, T.strip_ordinal("t"), t="12. Name. Two") == "Name. Two"
    assert one(spark, T.locale_number("p"), p="4,5 of 5") == 4.5
    assert one(spark, T.locale_number("p"), p="3,0 из 5") == 3.0


def test_page_url(spark):
    u = ".../Hotel_Review-g1-d2-Reviews-X.html"
    assert one(spark, T.page_url("u", F.lit(3), 5), u=u) == ".../Hotel_Review-g1-d2-Reviews-or15-X.html"


def test_newline_and_punct(spark):
    assert one(spark, T.drop_newlines("t"), t="a\nb") == "ab"
    assert one(spark, T.collapse_ws(T.space_punct_text("t")), t="добре,а п'ять") == "добре , а п'ять"


def test_tokenizer_and_split(spark):
    toks = one(spark, T.split_punct_tokens(T.tokenize("t")), t="Привіт, п'ять-шість!! ok")
    assert toks == ["Привіт", ",", "п'ять", "-", "шість", "!", "!", "ok"]
    assert one(spark, T.tokenize("t"), t="Привіт, п'ять-шість!! ok") == ["Привіт", ",", "п'ять-шість", "!!", "ok"]


def test_argmax_pad_onehot(spark):
    assert one(spark, A.argmax_first(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))) == 1
    assert one(spark, A.pad_truncate(F.array(F.lit(1), F.lit(2)), 3)) == [1, 2, 0]
    assert one(spark, A.pad_truncate(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), 3)) == [2, 3, 4]
    v = one(spark, A.one_hot(F.lit(1), 3, 0.3))
    assert [round(x, 9) for x in v] == [0.1, 0.8, 0.1]


def test_is_question(spark):
    q = K.is_question(F.array(F.lit("це"), F.lit("?")), F.array(F.lit("NPRO"), F.lit(None).cast("string")))
    assert one(spark, q) is True
    assert one(spark, K.is_question(F.array().cast("array<string>"), F.array().cast("array<string>"))) is False


def test_drop_all_questions(spark):
    df = spark.createDataFrame([(1, [True, True]), (2, []), (3, [True, False])], "id int, is_question array<boolean>")
    assert [r.id for r in K.drop_all_questions(df).collect()] == [3]


def test_decode_groups(spark):
    df = spark.createDataFrame([(1, 0, "при"), (1, 1, "віт</w>"), (1, 2, "пан</w>")], "review_id int, pos int, token string")
    g = K.decode_groups(df).orderBy("pos").collect()
    assert [r.group for r in g] == [0, 0, 1]
    w = K.word_scores(df.withColumn("score", F.lit(1.0))).orderBy("pos").collect()
    assert [(r.token, r.score) for r in w] == [("привіт", 2.0), ("пан", 1.0)]


def test_scored_ngrams(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 3.0), (1, 2, "c", 5.0)],
                               "review_id int, pos int, token string, score double")
    out = K.scored_ngrams(df, 2, "mean").orderBy("pos").collect()
    assert [(r.phrase, r.score) for r in out] == [("a b", 2.0), ("b c", 4.0)]


def test_percentile_matches_numpy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    v = d.select(F.percentile(F.length("text"), F.lit(0.002))).first()[0]
    assert abs(v - 7.996) < 1e-9


def test_class_weights(spark):
    df = spark.createDataFrame([(c,) for c in [0] * 2 + [1] * 6 + [2] * 2], "y int")
    w = {r.y: r.weight for r in S.balanced_class_weights(df, "y").collect()}
    assert abs(w[0] - 10 / 6) < 1e-12 and abs(w[1] - 10 / 18) < 1e-12


def test_kfold_allocation(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([0, 0, 0, 1, 1])], "review_id int, y int")
    f = {r.review_id: r.fold for r in S.stratified_kfold(df, "y", 2).collect()}
    assert [f[i] for i in range(5)] == [0, 0, 1, 0, 1]


def test_quota_take(spark):
    sizes = F.array(F.lit(2), F.lit(20), F.lit(20))
    assert one(spark, S.quota_take(sizes, 15)) == [2, 6, 7]


def test_early_stop(spark):
    h = spark.createDataFrame([("m", e, float(v)) for e, v in enumerate([1, 3, 2, 2, 2, 2])],
                              "model string, epoch int, val_f1 double")
    r = M.early_stop(h, patience=4).first()
    assert r.best_epoch == 1 and r.stop_epoch == 5


def test_crawl_ratio():
    assert 5 / (5 + 1) > 0.8


def test_similarity_window_one_short():
    assert X.Phrase("a b c d", 2).alike(X.Phrase("x b c y", 2))    # "b c" stands in the other text
    assert not X.Phrase("p q c d", 2).alike(X.Phrase("c d", 2))    # "c d" holds the last token


def test_similarity_column_equals_values(spark):
    random.seed(4)
    rows = [tuple(" ".join(random.choice("ab bc c abc".split()) for _ in range(random.randint(1, 5))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p string, q string")
    for d in (1, 2, 3):
        got = [r[0] for r in df.select(X.alike(F.col("p"), F.col("q"), d)).collect()]
        assert got == [X.Phrase(p, d).alike(X.Phrase(q, d)) for p, q in rows]


def test_rank_within_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, None, 6), (4, "a", 9)], "id int, key string, v int")
    got = {(r.id, r.p, r.n) for r in rank_within(df, ["key"], ["v"], pos="p", size="n").collect()}
    assert got == {(1, 0, 2), (4, 1, 2), (3, 0, 2), (2, 1, 2)}


def test_scope_all_and_null_dataset(spark):
    df = spark.createDataFrame([("test", "a", True, 1, 1), ("test", None, True, 1, 0), ("test", "b", False, 0, 0)],
                               "split string, dataset_name string, translated boolean, y_true int, y_pred int")
    got = {(r.scope, r.value): (r.n, round(r.micro_f1, 6)) for r in M.f1_by_scopes(df).collect()}
    assert got[("all", "all")] == (3, 0.666667) and got[("dataset_name", None)] == (1, 0.0)


def test_vocabulary_has_no_cap(spark):
    from revlens.operators import models as ML
    n = (1 << 18) + 5000
    df = spark.range(0, 300).selectExpr("id AS review_id", f"array_join(transform(sequence(id, {n} - 1, 300L), x -> concat('w', x)), ' ') AS t")
    feats = ML.fit_tfidf(df, "t", [], ngram_max=1)
    assert len(next(s for s in feats.stages if hasattr(s, "vocabulary")).vocabulary) == n


def test_short_texts_have_a_language(spark):
    from revlens.operators import lang as LG
    df = spark.createDataFrame([(1, "en", "the cat"), (2, "de", "der hund"), (3, "en", "a"), (4, "de", "")], "k int, lang string, t string")
    g = LG.char_grams(df, ["k", "lang"], "t", 3)
    prof, floor = LG.train_profiles(g)
    assert {r.k for r in LG.identify(g, ["k"], prof, floor).collect()} == {1, 2, 3, 4}


def test_language_of_rows_without_label(spark):
    """A row without a language is scored as any other; its null is no candidate."""
    from revlens.operators import lang as LG
    df = spark.createDataFrame([(1, "en", "the cat the cat"), (2, "de", "der hund der hund"), (3, None, "der hund")], "k int, lang string, t string")
    g = LG.char_grams(df, ["k", "lang"], "t", 3)
    prof, floor = LG.train_profiles(g)
    found = LG.identify(g, ["k", "lang"], prof, floor)
    assert {(r.k, r.lang, r.pred) for r in found.collect()} == {(1, "en", "en"), (2, "de", "de"), (3, None, "de")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gram" not in plan and "hashpartitioning(k#" in plan


def test_language_beyond_the_broadcast(spark, monkeypatch):
    from revlens.operators import lang as LG
    df = spark.createDataFrame([(i, ("en", "de")[i % 2], ("the cat sat", "der hund bellt")[i % 2] * (1 + i % 3)) for i in range(20)], "k int, lang string, t string")
    g = LG.char_grams(df, ["k"], "t", 3).join(df.select("k", "lang"), "k")
    prof, floor = LG.train_profiles(g)
    near = sorted(map(tuple, LG.identify(g, ["k"], prof, floor).collect()))
    monkeypatch.setattr(LG, "MOST_GRAMS", 0)
    assert near == sorted(map(tuple, LG.identify(g, ["k"], prof, floor).collect())) == [(i, ("en", "de")[i % 2]) for i in range(20)]


def test_ranked_rows_are_not_moved_to_their_offsets(spark):
    df = spark.range(3000).selectExpr("id", "IF(id < 2000, 'hot', NULL) AS key", "id % 17 AS v")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = rank_within(df, ["key"], ["v", "id"], pos="p", size="n")
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.p, r.n) for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "ExistingRDD" not in plan
    for part, n in ((range(2000), 2000), (range(2000, 3000), 1000)):
        assert {i: got[i] for i in part} == {i: (p, n) for p, i in enumerate(sorted(part, key=lambda i: (i % 17, i)))}


def test_top_per_group_ranks_by_one_window(spark):
    from revlens.operators.ranking import top_per_group
    df = spark.range(3000).selectExpr("id", "IF(id < 2900, 'hot', NULL) AS key", "id % 17 AS v")
    top = top_per_group(df, ["key"], [F.col("v").desc(), F.col("id")], 5, pos="p")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "ExistingRDD" not in plan
    want = {(k, p, i) for k, part in (("hot", range(2900)), (None, range(2900, 3000)))
            for p, i in enumerate(sorted(part, key=lambda i: (-(i % 17), i))[:5])}
    assert {(r.key, r.p, r.id) for r in top.collect()} == want
    salted = top_per_group(df, ["key"], [F.col("v").desc(), F.col("id")], 5, pos="p", salts=4)
    assert {(r.key, r.p, r.id) for r in salted.collect()} == want


def test_literal_lines_keep_empty_records(spark, tmp_path):
    from revlens.sources import io
    (tmp_path / "a.txt").write_text("{'a': 'x', 'b': None}\n\n{'a': None, 'b': None}\n{'a': 'y', 'b': True}\n")
    got = sorted((r.a or "", r.b or "") for r in io.read_literal_lines(spark, str(tmp_path), "a string, b string").collect())
    assert got == [("", ""), ("x", ""), ("y", "True")]
    (tmp_path / "b.txt").write_text("{'a': 'z'\n")
    with pytest.raises(Exception):
        io.read_literal_lines(spark, str(tmp_path), "a string, b string").collect()


def test_compute_once_shows_faults(spark, tmp_path):
    from revlens.sources import io
    path = str(tmp_path / "t")
    io.compute_once(spark, path, lambda: spark.range(3))
    assert io.compute_once(spark, path, lambda: spark.range(9)).count() == 3
    part = next((tmp_path / "t").glob("part-*"))
    part.write_bytes(b"damaged")
    (tmp_path / "t" / f".{part.name}.crc").unlink()
    with pytest.raises(Exception):
        io.compute_once(spark, path, lambda: spark.range(9)).collect()


def test_rank_within_equals_row_number_on_skew(spark):
    random.seed(3)
    rows = [(i, "hot" if random.random() < 0.4 else f"k{random.randint(0, 30)}", random.randint(0, 50))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, key string, v int")
    ours = rank_within(df, ["key"], [F.col("v").desc(), "id"], pos="p", size="n")
    w = Window.partitionBy("key").orderBy(F.col("v").desc(), "id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("p"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n"))
    a = {(r.id, r.p, r.n) for r in ours.select("id", "p", "n").collect()}
    b = {(r.id, r.p, r.n) for r in ref.collect()}
    assert a == b


def test_folds_partition_rows(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else 4) for i in range(500)], "review_id int, y int")
    f = S.stratified_kfold(df, "y", 5)
    assert f.count() == 500 and f.select("review_id").distinct().count() == 500
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 5


def _brute_diversify(items, n_top, d):
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    kept = []
    for p, s in items:
        if any(X.Phrase(p, d).alike(X.Phrase(k, d)) for k, _ in kept):
            continue
        kept.append((p, s))
    return kept[:n_top]


def test_diversify_matches_brute_force(spark):
    random.seed(5)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows = []
    for g in ("g1", "g2"):
        seen = set()
        while len(seen) < 120:
            seen.add(" ".join(random.choice(words) for _ in range(4)))
        rows += [(g, p, round(random.random(), 4)) for p in sorted(seen)]
    df = spark.createDataFrame(rows, "g string, phrase string, score double")
    out = X.diversify(df, ["g"], n_top=5, d=2, first_batch=4)
    for g in ("g1", "g2"):
        got = [(r.phrase, r.score) for r in out.filter(F.col("g") == g).orderBy("div_rank").collect()]
        exp = _brute_diversify([(p, s) for gg, p, s in rows if gg == g], 5, 2)
        assert got == exp


def test_html_blocks_parser():
    from revlens.operators.extract import _Blocks
    doc = ('<html><head><script>var t="</p>";</script></head><body><article><p>one &amp; <b>two</b><br>'
           '<p>three</article><footer><p class="x">four</p></footer></body></html>')
    p = _Blocks("p", None)
    p.feed(doc)
    p.close()
    assert p.out == ["one & two", "three", "four"]
    q = _Blocks("p", "x")
    q.feed(doc)
    q.close()
    assert q.out == ["four"]


def test_blocks_of_all_containers(spark):
    """Blocks of later and nested containers and blocks with attributes, against the pieces that the pages are built from."""
    from revlens.operators import extract as XT
    rng, rows, want = random.Random(8), [], {}
    for page in range(60):
        html, kept, k = "<html><body><p>menu", [], 0
        for depth in (rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 3))):
            for _ in range(depth):
                html += rng.choice(["<article>", "<article class='a b'>", "<ARTICLE\nid=x>"]) + rng.choice(["", "<h1>no block</h1>", "<pre>no</pre>"])
                for _ in range(rng.randint(0, 3)):
                    kept.append(f"text {k} <b>x</b>" + rng.choice(["", "</p>"]))
                    html += rng.choice(["<p>", '<p class="r">', "<p\n id=1 >", "<P>"]) + kept[-1]
                    k += 1
            html += "</article>".join(["", *["<p>after" if depth == 2 and i == 1 else "" for i in range(1, depth)], ""])
            kept += ["after"] * (depth == 2)
            html += "<p>between</p><articles><p>other</p></articles>"
        rows.append((page, html))
        want[page] = kept
    df = spark.createDataFrame(rows + [(98, None), (99, "")], "page_id int, html string")
    got = {r.page_id: r.b for r in df.select("page_id", XT.blocks(F.col("html")).alias("b")).collect()}
    assert {p: got[p] for p in want} == want and got[98] is None and got[99] == []
    two = "<article><p>one</article><article class=x><p class=y>two<p>three</article>"
    assert one(spark, XT.blocks(F.col("h")), h=two) == ["one", "two", "three"]


def test_stratified_split_sizes(spark):
    rows = [(i, "d" + str(i % 2), float(1 + i % 5)) for i in range(1, 1001) if not (i % 5 == 0 and i % 7)]
    df = spark.createDataFrame(rows, "review_id long, dataset_name string, rating double")
    s = S.stratified_split(df, ["dataset_name", "rating"]).groupBy("dataset_name", "rating", "split").count().collect()
    got = {}
    for r in s:
        got.setdefault((r.dataset_name, r.rating), {})[r.split] = r["count"]
    for key, c in got.items():
        n = sum(c.values())
        held = (n + 4) // 5
        assert c.get("train", 0) == n - held
        assert c.get("test", 0) == (held + 1) // 2 and c.get("val", 0) == held - (held + 1) // 2
