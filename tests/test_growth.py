"""What must not grow: plans that broadcast, shuffle or hold more than the result needs."""

from pyspark.sql import functions as F

from lectern.operators import lexicon


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_grams_are_never_the_broadcast_side(spark):
    forms = spark.createDataFrame([("abab", 2), ("ab", 3), ("a", 5), ("", 1)], "lowercase_form string, tokens long")
    out = lexicon.mean_gram_frequency(forms, 2, "m")
    assert "BuildLeft" not in plan(out)
    # ab: 2 * 2 + 3 = 7, ba: 2
    assert {r[0]: round(r[1], 6) for r in out.collect()} == {"abab": round(16 / 3, 6), "ab": 7.0, "a": 0.0, "": 0.0}


def test_rollups_of_sentences_and_paragraphs_move_no_rows(spark):
    from lectern.queries import QUERIES

    for name in ("a02_sentence_rollup", "a03_paragraph_rollup"):
        shown = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert shown.count("Exchange") - shown.count("REPARTITION_BY_NUM") == 0, name


def test_rollups_in_the_row_equal_rollups_of_words(spark):
    from lectern.operators import hierarchy
    from lectern.plans import corpus

    texts = spark.createDataFrame([(1, "a bb. ! c\n\n .x y"), (2, ""), (3, None), (4, " \n d")], "doc_id long, text string")
    words = corpus.words_from_texts(texts)
    keep = ["text_id", corpus.paragraph_id().alias("paragraph_id")]
    got = hierarchy.paragraph_table(corpus.paragraphs_from_texts(texts), keep)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hierarchy.paragraphs_of(words).collect()))
    keep.append(corpus.sentence_id().alias("sentence_id"))
    got = hierarchy.sentence_table(corpus.sentences_from_texts(texts), keep)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hierarchy.sentences_of(words).collect()))


def test_alignment_in_the_row_equals_the_join(spark):
    import random

    from lectern.operators import alignment

    draw = random.Random(5)
    rows = []
    for c in range(40):
        words = ["x" * draw.randint(1, 6) for _ in range(draw.choice([1, 2, 9, 60]))]
        starts = [sum(len(v) + 1 for v in words[:i]) for i in range(len(words))]
        text = " ".join(words)
        spans = [(i + 1, f"{c}_{i}", s, s + len(v), v) for i, (s, v) in enumerate(zip(starts, words))]
        tokens = []
        for k in range(draw.randint(0, 50)):  # in any order, overlapping, empty, outside the text
            a = draw.randint(-3, len(text) + 3)
            tokens.append((k, a, a + draw.randint(0, 12), draw.choice([None, draw.random()]), draw.choice([None, draw.random()])))
        rows.append((str(c), text, spans, tokens))
    span, token = "array<struct<ord:int,word_id:string,start:int,end:int,word_form:string>>", "array<struct<token_ord:int,token_start:int,token_end:int,nll:double,entropy:double>>"
    held = spark.createDataFrame(rows, f"context_id string, text string, spans {span}, tokens {token}").repartition(3)
    given = alignment.best_covers(F.col("spans.start"), F.col("spans.end"), F.col("tokens.token_start"), F.col("tokens.token_end"))
    placed = held.withColumn("assigned", given)
    placed.collect()
    starts = held.select("spans", alignment.joined_starts(F.transform("spans", lambda x: F.length(x["word_form"]))).alias("s")).collect()
    assert all([x.start for x in r.spans] == r.s for r in starts)

    words, tokens = held.select("context_id", F.inline("spans")), held.select("context_id", F.inline("tokens"))
    assigned = alignment.align_tokens(tokens, words)
    want = {(r.context_id, r.token_ord): r.word_id for r in assigned.collect()}
    got = {}
    for r in placed.collect():
        for x, at in zip(r.tokens, r.assigned):
            got[r.context_id, x.token_ord] = None if at is None else r.spans[at].word_id
    assert got == want

    flat = lambda rs: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs], key=repr)
    scored, real = F.transform("tokens", lambda x: x["token_ord"] > 0), F.transform("tokens", lambda x: x["token_end"] > x["token_start"])
    scores = alignment.scores_in_row(F.size("spans"), F.col("assigned"), real, scored, F.col("tokens.nll"), F.col("tokens.entropy"))
    out = placed.select("context_id", F.col("spans.word_id").alias("ids"), scores.alias("scores")).select("context_id", F.inline(F.arrays_zip("ids", "scores")))
    assert flat(out.select("context_id", "ids", "scores.*").collect()) == flat(alignment.word_scores(assigned, words).collect())

    kept = placed.where(F.size("tokens") > 0)
    report = alignment.validate_alignment(assigned, words, held.select("context_id", "text"))
    assert flat(alignment.validate_in_rows(kept).collect()) == flat(report.join(kept.select("context_id"), "context_id", "left_semi").collect())


def test_alignment_queries_move_no_rows(spark):
    from lectern.queries import QUERIES

    for name in ("j06_token_word_alignment", "a33_word_scores", "a34_alignment_validation"):
        shown = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert shown.count("Exchange") == shown.count("REPARTITION_BY_NUM"), name


def test_compact_split_checks_equal_those_over_all_rows(spark):
    from lectern.operators import contracts

    names = "split_name string, fold_id int, fold_rule string, participant_id string"
    compact = [("a", f, "all_but", u) for u, f in (("x", 0), ("y", 1), ("z", 1), ("x", 2))]
    compact += [("random b", 0, "all_but", "x"), ("random b", 1, "all_but", "y"), ("c", 0, "include", "x"), ("c", 0, "exclude", "y")]
    full = [(s, f, "test" if f == own else "train", u) for s, own, r, u in compact if r == "all_but" for f in sorted({c[1] for c in compact if c[0] == s})]
    full += [c for c in compact if c[2] != "all_but"]
    rows = spark.createDataFrame(full, names.replace("fold_rule", "split_role")).where("split_name <> 'a' OR participant_id <> 'x'")
    doubled = spark.createDataFrame([("a", f, r, "x") for f, r in ((0, "test"), (0, "train"), (1, "train"), (2, "test"), (2, "train"))], rows.schema)
    rows = rows.unionByName(doubled)
    for once, each in (("a", "a"), ("random b", "random b"), ("c", "c")):
        want = contracts.suite(
            contracts.group_leakage(rows), contracts.no_random_splits(rows), contracts.tested_once(rows, once), contracts.one_test_per_fold(rows, each)
        )
        got = contracts.compact_split_checks(spark.createDataFrame(compact, names), once, each)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_split_tables_move_no_exploded_rows(spark):
    from lectern.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    for name in ("v06_v07_split_checks", "u02_union_of_split_tables"):
        assert "leave_one" not in name and plan(QUERIES[name](spark, folder)).count("Generate explode(sequence(0, (cast(__n") == 0, name
    shown = plan(QUERIES["x04_a31_split_labels"](spark, folder))
    assert "BroadcastHashJoin [split_name" in shown
    for name in ("x02_j14_leave_one_reader_out", "x04_a31_split_labels", "x05_exposure_balanced_splits"):
        frame = QUERIES[name](spark, folder)
        assert "REPARTITION_BY_NUM" in plan(frame), name  # dealt out before they are exploded


def test_chunked_rows_are_not_broadcast(spark):
    from lectern.operators import resampling, sequence

    df = spark.createDataFrame([("a", 3), ("a", None), (None, 1), (None, 2), ("a", 9), (None, None)], "k string, o int")
    out = sequence.ordered_features(df, ["k"], ["o"], chunk=sequence.by_rows("o", 2), index="i", size="n")
    assert "BroadcastHashJoin" not in plan(out)
    got = sorted((r.k or "", -1 if r.o is None else r.o, r.i, r.n) for r in out.collect())
    assert got == [("", -1, 0, 3), ("", 1, 1, 3), ("", 2, 2, 3), ("a", -1, 0, 3), ("a", 3, 1, 3), ("a", 9, 2, 3)]
    scores = spark.createDataFrame([(f"u{i}", i % 2, i / 10) for i in range(10)], "u string, y_true int, y_score double")
    assert "BroadcastHashJoin" not in plan(resampling.permutation_test(scores, "u", 3))
    assert "BroadcastHashJoin" not in plan(resampling.bootstrap_weights(scores, "u", 3, 1, []))


def test_split_tables_build_the_panel_once(spark):
    from lectern.queries import QUERIES

    for name in ("u02_union_of_split_tables", "x04_a31_split_labels"):
        assert "l_orderkey" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_resampling_broadcasts_neither_rows_nor_draws(spark):
    from lectern.queries import QUERIES

    for name in ("m10_permutation_test", "m11_bootstrap_interval"):
        joins = [line for line in plan(QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "__pick" in line or "__chunk" in line], name


def test_signed_vectors_equal_brute_force(spark):
    import hashlib

    from lectern.functions import hashing

    lists = [["a", "b", "a", "ø", ""], [], None, ["x"] * 300 + [f"w{i}" for i in range(500)], ["a", None, "b"]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, ts array<string>")
    for dimensions in (3, 16, 256):
        got = {r.i: r.v for r in rows.select("i", hashing.signed_vector(F.col("ts"), dimensions).alias("v")).collect()}
        for i, words in enumerate(lists):
            want = None if words is None else [0] * dimensions
            for word in words or []:
                if word is not None:
                    digest = hashlib.md5(word.encode()).hexdigest()
                    want[int(digest[:2], 16) % dimensions] += 1 if digest[2] < "8" else -1
            assert got[i] == want, (dimensions, i)


def test_signed_vectors_take_no_step_per_token_and_dimension(spark):
    from lectern.functions import hashing

    rows = spark.createDataFrame([(["a"],)], "ts array<string>")
    assert "array_repeat" not in plan(rows.select(hashing.signed_vector(F.col("ts"))))


def test_drift_of_long_sentences_and_of_single_ones(spark):
    from lectern.plans import corpus_features

    long = " ".join(["w"] * 70000)  # its product with itself passes 32 bits
    texts = spark.createDataFrame([(1, f"{long}. {long}."), (2, "one only"), (3, None), (4, " . ! a b. \n c. d.")], "doc_id long, text string")
    rows = {(r.text_id, r.p): r for r in corpus_features.paragraph_cohesion(texts).collect()}
    assert set(rows) == {("1", 1), ("4", 1), ("4", 2)}
    assert rows["1", 1].paragraph_cohesion > 0.99 and rows["1", 1].sentence_count_embedded == 2


def test_words_of_the_corpus_move_once_and_are_not_united(spark):
    from lectern.plans import corpus_features

    texts = spark.createDataFrame([(1, "A cat sat. A cat ran!\nOne only . ! -"), (2, ""), (3, None)], "doc_id long, text string")
    out = corpus_features.word_features(texts)
    shown = plan(out)
    assert "Union" not in shown and "hashpartitioning(text_id" not in shown
    rows = out.collect()
    assert {r.word_id for r in rows if r.missing_lexical} == {"1_p2_s1_w3", "1_p2_s2_w1", "1_p2_s3_w1"}
    assert all(r.missing_lm == (r.w == 1) for r in rows)


def test_texts_need_ids_of_their_own(spark):
    import pytest

    from lectern.plans import corpus_features

    for ids in ([1, 1], [1, None]):
        texts = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
        with pytest.raises(Exception, match="an id is null or not unique"):
            corpus_features.word_features(texts).collect()


def test_first_rows_of_groups_are_found_without_sorting_rows(spark, monkeypatch):
    import random

    from lectern.operators import boundaries
    from lectern.queries import QUERIES

    shown = plan(QUERIES["w09_boundary_examples"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" not in shown.split("MapInArrow")[-1] and "MapInArrow" in shown
    draw = random.Random(3)
    names = [None, "", "a", "Z", "é", "\U0001f600", "￿", "aa"]
    data = [(draw.choice([None, "x", "y", f"g{i % 50}"]), f"{draw.choice(names) or ''}{i}" if i % 9 else None if i == 9 else f"n{i}", i) for i in range(4000)]
    rows = spark.createDataFrame(data, "g string, o string, i int").repartition(5)
    for held in (100_000, 3):
        monkeypatch.setattr(boundaries, "HELD", held)
        got = boundaries.examples_per_group(rows, "g", "o", 4, ["g", "o", "i"]).collect()
        want = []
        for g in {d[0] for d in data}:
            want += sorted([d for d in data if d[0] == g], key=lambda d: (d[1] is not None, (d[1] or "").encode()))[:4]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert boundaries.examples_per_group(rows.limit(0), "g", "o", 4, ["g", "i"]).collect() == []


def test_panel_is_worked_out_once(spark):
    from lectern.queries import QUERIES

    for name in ("a06_a07_reader_aggregates", "m04_cross_fitted_many_predictors", "m18_clustered_logistic"):
        read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert not any("lineitem" in f for f in read), name


def test_panel_rows_are_dealt_over_more_tasks_as_the_lines_grow(spark, monkeypatch):
    from lectern.plans import panels
    from lectern.queries.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    columns = ["participant_id", "word_id", "FFD", "go_past_time", "skip", "text_id", "source_observation_count", "label", "upos"]
    rows = lambda: sorted(map(tuple, panels.word_level(t).select(*columns).collect()), key=repr)
    want, few = rows(), plan(panels.collapsed(t))
    assert "REPARTITION_BY_NUM" not in few
    monkeypatch.setattr(panels, "LINES_A_TASK", 500)
    parts = panels.tasks(t)
    assert parts == -(-t.lineitem.count() // 500) and rows() == want
    shown = plan(panels.collapsed(t))
    assert f"hashpartitioning(participant_id" in shown and f"word_id" in shown and f", {parts}), REPARTITION_BY_NUM" in shown


def test_first_occurrences_sort_no_forms_and_hold_for_odd_texts(spark, monkeypatch):
    from lectern.plans import corpus

    texts = spark.createDataFrame([(5, "b a a.\nc b"), (-3, "x b. a"), (5, "a b"), (None, "z a"), (2, None), (7, ""), (2**62, "q x")], "doc_id long, text string")
    want = {"b": ("5_p1_s1_w1", "5"), "a": ("-3_p1_s2_w1", "-3"), "c": ("5_p2_s1_w1", "5"), "x": ("-3_p1_s1_w1", "-3"), "q": (f"{2**62}_p1_s1_w1", str(2**62)), "z": (None, None)}
    want |= {"b.": ("-3_p1_s1_w2", "-3"), "a.": ("5_p1_s1_w3", "5")}
    got = lambda df: {r.word_form: (r.word_id, r.text_id) for r in corpus.first_occurrences(df).collect()}
    assert got(texts) == want
    assert "SortAggregate" not in plan(corpus._first_places(texts, "doc_id", "text"))
    assert got(texts.withColumn("doc_id", F.col("doc_id").cast("string"))) == want
    monkeypatch.setattr(corpus, "SHORT", 4)  # most texts go the way of long ones
    assert got(texts) == want


def test_words_move_to_their_sentence_without_partial_sums(spark, monkeypatch):
    from lectern.operators import surprisal
    from lectern.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES["g03_sentence_surprisal"](spark, folder).collect()))
    monkeypatch.setattr(surprisal, "MANY_PAIRS", 0)
    out = QUERIES["g03_sentence_surprisal"](spark, folder)
    assert "REPARTITION_BY_COL" in plan(out) and "ShuffledHashJoin" in plan(out)
    assert sorted(map(tuple, out.collect())) == want


def test_medians_of_bounded_readers_move_rows_once_and_equal_the_long_form(spark):
    import random

    from lectern.operators import profiles

    draw = random.Random(7)
    pick = lambda *xs: draw.choice([None, *xs, draw.random()])
    data = [(draw.choice([None, "a", "b", "c"]), pick(1.0), pick(2.0, 2.0), pick(3.0), draw.choice([0, 1, None])) for _ in range(400)] + [("z", None, None, None, None)]
    rows = spark.createDataFrame(data, "u string, r double, q double, prev_boundary_opacity_score double, vv_indicator int").repartition(5)
    args = (rows, "u", ["r", "q"], {"o": "prev_boundary_opacity_score"})
    flat = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()], key=repr)
    once = profiles.residual_profiles(*args, parts=3, largest=400)
    shown = plan(once)
    assert shown.count("hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in shown
    long = profiles.residual_profiles(*args, largest=profiles.HELD + 1)
    assert flat(once.where("u IS NOT NULL")) == flat(long.where("u IS NOT NULL"))


def test_deals_are_never_broadcast(spark, monkeypatch, tmp_path):
    from lectern.operators import fold_fits

    held = []
    monkeypatch.setattr(fold_fits, "cut_lineage", lambda df: held.append(plan(df)) or df)
    spark.createDataFrame([(f"u{i}", i % 2, float(i)) for i in range(20)], "u string, label int, x double").write.parquet(f"{tmp_path}/u")
    data = spark.read.parquet(f"{tmp_path}/u")
    assigned = data.select("u", (F.col("label") * 0).alias("__fold"), F.lit(2).alias("__k"))
    deals = data.select("u", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).groupBy("u").agg(F.collect_list("i").alias("positive_in"))
    out = fold_fits.fold_rows(data, assigned, "u", ["x"], "label", deals=deals)
    assert out.count() == 20 and len(held) == 1
    assert not any("collect_list" in part[:400] for part in held[0].split("BroadcastExchange")[1:])


def test_word_ladder_reads_the_panel_once(spark, monkeypatch):
    from lectern.operators import learning
    from lectern.queries import QUERIES

    read = []

    def stop(rows, assigned, *_, **__):
        read.extend([rows.inputFiles(), assigned.inputFiles()])
        raise StopIteration

    monkeypatch.setattr(learning, "cross_validate", stop)
    try:
        QUERIES["m21_word_ladder"](spark, "/root/testdata/sf0.001")
    except StopIteration:
        pass
    assert len(read) == 2 and not any("lineitem" in f for files in read for f in files)
