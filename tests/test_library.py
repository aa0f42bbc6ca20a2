"""Operators against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import compare, corpus_audit, draws, intervals, metrics, model, pairs, reconcile, resample, scoring, transitions
from pathloom.sources import readers

VISITS = "subject_id string, text_id string, word_index long, fixation_order long, duration_ms double, line_id long"


def visits(spark, words, lines=None, subject="s1", text="t:1", orders=None):
    lines = lines or [None] * len(words)
    orders = orders or range(1, len(words) + 1)
    return spark.createDataFrame([(subject, text, w, o, 10.0 * o, ln) for w, o, ln in zip(words, orders, lines)], VISITS)


def test_event_types_and_order(spark):
    v = visits(spark, [0, 0, 2, 1, 3], [0, 0, 0, 0, 1]).orderBy(F.rand(1)).unionByName(visits(spark, [5], subject="s2"))
    rows = sorted(map(tuple, transitions.extract_events(v).select("src_word", "dst_word", "event_type").collect()))
    assert rows == [(0, 0, "refixation"), (0, 2, "forward"), (1, 3, "line_return"), (2, 1, "regression")]
    assert transitions.extract_events(v, include_self=False).count() == 3


def test_gaps_and_weights(spark):
    v = visits(spark, [1, 2], orders=[1, 3])
    assert transitions.extract_events(v).count() == 1
    assert transitions.extract_events(v, consecutive_only=True).count() == 0
    assert transitions.extract_events(v, weight="target_duration").first()["weight"] == 30.0
    with pytest.raises(ValueError):
        transitions.extract_events(v, weight="other")


def test_line_return_to_an_earlier_word(spark):
    assert transitions.extract_events(visits(spark, [10, 2], [0, 1])).first()["event_type"] == "line_return"


def test_matrix_rows(spark):
    events = transitions.extract_events(visits(spark, [0, 1, 0, 2]))
    cells = transitions.aggregate_transitions(events).where("event_type = 'forward'")
    sizes = spark.createDataFrame([("t:1", 4)], "text_id string, n_words long")
    dense = {(r.src_word, r.dst_word): (r["count"], r.probability, r.valid) for r in transitions.dense_matrix(cells, sizes).collect()}
    assert [dense[0, j][0] for j in range(4)] == [0, 1, 1, 0] and [dense[0, j][1] for j in range(4)] == [0, 0.5, 0.5, 0]
    assert all(dense[0, j][2] for j in range(4)) and not any(dense[i, j][2] for i in range(1, 4) for j in range(4))
    with pytest.raises(Exception, match="smaller than the observed"):
        transitions.aggregate_transitions(events, n_words=spark.createDataFrame([("t:1", 2)], "text_id string, n_words long")).collect()


def test_repeated_orders_and_other_violations(spark):
    v = visits(spark, [0, -1], orders=[1, 1])
    assert {r.rule: r.n for r in readers.violations(v).collect()} == {"negative_word": 1, "bad_duration": 0, "repeated_order": 1, "several_lines": 0}


def test_read_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("subject_id,text_id,word_index,fixation_order,duration_ms\ns,t:1,0,1,5.5\n")
    assert readers.read_fixations(spark, str(good)).first()["duration_ms"] == 5.5
    bad = tmp_path / "bad.csv"
    bad.write_text("subject_id,text_id\ns,t\n")
    with pytest.raises(ValueError, match="duration_ms, fixation_order, word_index"):
        readers.read_fixations(spark, str(bad))


def test_lines_from_intervals(spark):
    rows = spark.createDataFrame([("t", 1, 70.0, 154.0), ("t", 2, 70.4, 153.8), ("t", 3, 154.1, 246.0)], "text_id string, w int, top double, bottom double")
    assert [r.line_id for r in intervals.cluster_intervals(rows, ["text_id"]).orderBy("w").collect()] == [0, 0, 1]


def test_lines_of_missing_and_equal_intervals(spark):
    rows = spark.createDataFrame(
        [(1, None, None), (2, None, None), (3, 22.0, 27.0), (4, 22.0, 27.0), (5, 15.0, 20.0), (6, 27.0, None)], "w int, top double, bottom double"
    ).withColumn("text_id", F.lit("t"))
    found = {r.w: r.line_id for r in intervals.cluster_intervals(rows, ["text_id"]).collect()}
    assert (found[5], found[3], found[4], found[6]) == (0, 1, 1, 2) and sorted([found[1], found[2]]) == [3, 4]


def test_ambiguous_bounds_are_not_mapped(spark):
    rows = [("t", 1, 70.0, 154.0), ("t", 1, 246.0, 330.0), ("t", 2, 70.0, 154.0)]
    mapped, audit = intervals.line_map(spark.createDataFrame(rows, "text_id string, word_index int, top double, bottom double"))
    assert [tuple(r) for r in mapped.collect()] == [("t", 2, 0)]
    assert audit.first()["ambiguous"] == 1 and audit.first()["violations"] == 0


def test_claims(spark):
    words = [("a", [1.0, 4.0], 2), ("b", [3.0, 4.0], 2), ("c", [5.0], 1)]
    fix = [(0.0, 0.0, 10.0 * (i + 1)) for i in range(5)]
    schema = "text_id string, words array<struct<content string, fix_positions array<double>, n_fixations int>>, bounds array<array<double>>, fix array<struct<x double, y double, duration double>>"
    kept, counts = readers.map_claims(spark.createDataFrame([("t", words, [[0.0, 0.0, 1.0, 1.0]] * 3, fix)], schema))
    assert sorted((r.word_index, r.fixation_order, r.duration_ms) for r in kept.collect()) == [(0, 1, 20.0), (1, 3, 60.0), (2, 5, 100.0)]
    row = counts.first()
    assert (row.outside, row.conflicts, row.bad_claims, row.count_differs) == (1, 1, 0, 0)


def words_table(spark, heads):
    return spark.createDataFrame([("t:1", i, 1, h, 0, False, f"w{i}", 1.0, 0.0, False, False, 3.0, False) for i, h in enumerate(heads)], "text_id string, word_index long, sentence_number long, head_word_index long, line_id long, syntax_missing boolean, surface string, log_length double, cloze_logit double, cloze_missing boolean, terminal_punctuation boolean, zipf_frequency double, frequency_oov boolean")


def test_tree_features(spark):
    design = pairs.build_pairs(words_table(spark, [1, 1, 1, 2]), "all", "syntax")
    row = {(r.src_word, r.dst_word): r for r in design.collect()}
    assert row[1, 3].dependency_tree_distance == 2 and row[1, 3].src_head_of_dst == row[1, 3].dst_head_of_src == 0
    assert row[1, 2].dependency_tree_distance == 1 and row[1, 2].src_head_of_dst == 1
    broken = pairs.build_pairs(words_table(spark, [1, 0, 1, 2]), "all", "syntax")
    assert broken.agg(F.min("dependency_missing")).first()[0] == 1.0


def test_feature_sets(spark):
    with pytest.raises(ValueError):
        pairs.feature_names("flexible", "all")
    with pytest.raises(ValueError):
        pairs.build_pairs(words_table(spark, [0, 0]).drop("head_word_index"), "all", "syntax")
    assert len(pairs.feature_names("flexible", "forward_same_line")) == 15 and len(pairs.feature_names("syntax", "all")) == 22


def scored(spark, rows):
    return spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, count double, probability double")


def test_residuals(spark):
    one = model.residuals(scored(spark, [("t:1", 0, 1, 7.0, 1.0)])).first()
    assert one.exposure == 7 and one.residual is None and not one.reliable
    a, b = model.residuals(scored(spark, [("t:1", 0, 1, 0.0, 0.25), ("t:1", 0, 2, 4.0, 0.75)])).orderBy("dst_word").collect()
    assert (a.expected, b.expected) == (1, 3)
    assert a.residual == pytest.approx(-1 / math.sqrt(0.75)) and b.residual == pytest.approx(1 / math.sqrt(0.75))
    assert a.deviance < 0
    cells = model.residuals(scored(spark, [("t:1", 0, 1, 3.0, 0.75), ("t:1", 0, 2, 1.0, 0.25), ("t:1", 1, 2, 0.0, 0.4), ("t:1", 1, 3, 2.0, 0.6)]), min_exposure=3).orderBy("src_word", "dst_word").collect()
    assert [c.exposure for c in cells] == [4, 4, 2, 2] and [c.reliable for c in cells] == [True, True, False, False]
    assert [c.deviation for c in cells] == pytest.approx([0, 0, -0.8, 0.8])


def test_newton_fit_has_zero_gradient_and_large_fit_agrees(spark):
    rng = np.random.default_rng(0)
    x, counts = rng.standard_normal((60, 3)), rng.poisson(3, 60).astype(float)
    starts = np.arange(0, 60, 6)
    beta = model.newton_fit(x, counts, starts)
    names = ("a", "b", "c")
    design = spark.createDataFrame([("t:1", i // 6, i % 6, float(counts[i]), *map(float, x[i])) for i in range(60)], "text_id string, src_word long, dst_word long, count double, a double, b double, c double")
    gradient = model.nll_and_gradient(design, dict(zip(names, beta))).first()
    assert max(abs(gradient[f"d_{n}"]) for n in names) < 1e-6
    assert list(model.fit_large(design, names).values()) == pytest.approx(list(beta), abs=1e-6)
    with pytest.raises(model.NotConverged):
        model.newton_fit(x, counts, starts, max_rounds=1, tolerance=0)


def test_folds_are_seeded_and_hold_every_text_once():
    folds = model.text_folds([f"A:{i}" for i in range(12)])
    assert sorted(t for f in folds for t in f) == sorted(f"A:{i}" for i in range(12))
    assert folds == model.text_folds([f"A:{i}" for i in reversed(range(12))])


def test_crossfit_leaves_the_scored_text_out(spark):
    rows = [(f"t:{t}", 0, d, float(c), float(d)) for t in range(5) for d, c in ((1, 3 + t), (2, 5))]
    design = spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, count double, x double")
    folds = model.folds_table(spark, [f"t:{t}" for t in range(5)])
    out = model.fit_predict_folds(design, ("x",), folds)
    for t in range(5):
        train = [r for r in rows if r[0] != f"t:{t}"]
        beta = model.newton_fit(np.array([[r[4]] for r in train]), np.array([r[3] for r in train]), np.arange(0, 8, 2))
        p = np.exp(beta[0] * np.array([1, 2]))
        assert [r.probability for r in out.where(F.col("text_id") == f"t:{t}").orderBy("dst_word").collect()] == pytest.approx(list(p / p.sum()), abs=1e-9)


def test_metrics(spark):
    rows = [("t:1", s, float(x), float(y)) for s, x, y in zip([0, 0, 0, 0, 1, 1], [0, 1, 2, 3, 0, 1], [0, 1, 2, 3, 1, 0])]
    m = metrics.source_equal(spark.createDataFrame(rows, "text_id string, src_word long, x double, y double"), ["text_id"]).first()
    assert m.edge_weighted > m.source_weighted and abs(m.fisher_equal) < 1e-9 and m.n_sources == 2
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert metrics.correlation(flat, []).first()["r"] is None and metrics.correlation(flat, [], constant=0.0).first()["r"] == 0.0
    pair = spark.createDataFrame([("t:1", 0, 1, 0.0, 1.0), ("t:1", 0, 2, 1.0, 0.0)], "text_id string, src_word long, dst_word long, x double, y double")
    row = metrics.paired_metrics(pair).where("metric = 'edge_weighted'").first()
    assert row.negative_share == 1 and row.undefined == 0
    d = metrics.distribution(spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "v double"), [], "v").first()
    assert (d.median, d.q25, d.q75, d.minimum, d.maximum) == pytest.approx((0.2, 0.15, 0.25, 0.1, 0.3))


def test_separation_and_thinning(spark):
    df = spark.createDataFrame([("s", "t:1", 0, d, c) for d, c in ((1, 10.0), (2, 4.0), (3, 2.0), (4, 1.0))], "subject_id string, text_id string, src_word long, dst_word long, count double")
    marked = transitions.with_separation(df)
    assert [r.category for r in marked.orderBy("dst_word").collect()] == ["adjacent", "near_skip", "near_skip", "far_same_line"]
    keep = {r.category: r.keep for r in resample.keep_probabilities(marked).collect()}
    assert keep == pytest.approx({"adjacent": 0.1, "near_skip": 1 / 6, "far_same_line": 1.0})
    thin = {r.dst_word: r["count"] for r in resample.thin_categories(marked, 1).collect()}
    assert thin[4] == 1 and thin[1] <= 10 and len(thin) == 4
    with pytest.raises(Exception, match="later destination"):
        transitions.with_separation(spark.createDataFrame([(2, 1)], "src_word long, dst_word long")).collect()


def test_split_halves(spark):
    same = None
    for i in range(6):
        v = visits(spark, [0, 1, 0, 2, 0], subject=f"s{i}")
        same = v if same is None else same.unionByName(v)
    events = transitions.extract_events(same)
    sizes = spark.createDataFrame([("t:1", 3)], "text_id string, n_words long")
    row = resample.split_half(transitions.subject_edges(events), draws.half_draws(events, 10, 5), sizes).first()
    assert (row.draws, row.valid, row.half_0, row.half_1) == (10, 10, 3, 3) and row["median"] == pytest.approx(1)
    four = events.where("subject_id < 's4'")
    exact = resample.split_half(transitions.subject_edges(four), draws.four_subject_draws(four), sizes).first()
    assert (exact.draws, exact.valid) == (3, 3) and exact["median"] == pytest.approx(1)
    three = events.where("subject_id < 's3'")
    few = resample.split_half(transitions.subject_edges(three), draws.half_draws(three, 4, 5), sizes).first()
    assert few.valid == 0 and few["median"] is None


def test_draws():
    ids = [f"s{i}" for i in range(11)]
    splits = resample.subject_splits(ids, 3, 7)
    assert [tuple(map(len, h)) for h in splits] == [(5, 6)] * 3 and splits == resample.subject_splits(ids, 3, 7)
    assert len(resample.anchored_partitions([f"s{i:02}" for i in range(12)])) == 462
    subsets = resample.balanced_subsets(ids, 4, 9, 3)
    used = [sum(s in x for x in subsets) for s in ids]
    assert max(used) - min(used) <= 1
    assert [sum(map(len, h)) for h in resample.reader_bootstrap(ids, 2, 1)] == [11, 11]
    parts = resample.manifest([f"t:{i}" for i in range(55)], 1)
    assert [len(p) for p in parts.values()] == [35, 10, 10] and len({t for p in parts.values() for t in p}) == 55


def test_permutation_keeps_each_source(spark):
    rows = [("t:1", s, d, float(s * 10 + d)) for s in range(4) for d in range(5)]
    df = spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, count double")
    out = resample.permute_destinations(df, [], "count", 3)
    for s in range(4):
        assert sorted(r["count"] for r in out.where(F.col("src_word") == s).collect()) == [float(s * 10 + d) for d in range(5)]
    assert out.join(df.withColumnRenamed("count", "c"), ["text_id", "src_word", "dst_word"]).where("count <> c").count() > 0


def test_influence(spark):
    df = spark.createDataFrame([(f"t:{i}", v) for i, v in enumerate([1.0, 2.0, 6.0])], "text_id string, v double")
    assert [r.loo_mean for r in compare.leave_one_out_means(df, [], "v").orderBy("text_id").collect()] == [4, 3.5, 1.5]
    repeats = spark.createDataFrame([(r, t, float(v)) for r, x in enumerate([{"a:1": 1, "b:2": 3, "c:3": 100}, {"a:1": 2, "b:2": 4, "c:3": 6}]) for t, v in x.items()], "repeat int, text_id string, metric double")
    assert compare.median_hierarchy(repeats, []).first()["median"] == 3.5
    assert {r.deleted: r["median"] for r in compare.leave_one_text_out(repeats).collect()} == {"a:1": 28.25, "b:2": 27.25, "c:3": 2.5}
    estimates = spark.createDataFrame([("a:1", 1.0), ("b:2", 3.0), ("c:3", 2.5)], "deleted string, median double")
    best = compare.most_influential(estimates, spark.createDataFrame([(2.0,)], "median double")).first()
    assert best.deleted == "a:1" and abs(best.change) == 1


def test_vectors(spark):
    states = spark.createDataFrame([("t", 0, 0, [1.0, 3.0]), ("t", 1, 0, [3.0, 5.0]), ("t", 2, 1, [7.0, 9.0]), ("t", 3, -1, [100.0, 100.0])], "text_id string, pos int, word_index int, state array<double>")
    assert [(r.word_index, r.state) for r in scoring.word_pool(states).orderBy("word_index").collect()] == [(0, [2.0, 4.0]), (1, [7.0, 9.0])]
    p = spark.createDataFrame([(0, 1.0, 0.0, True), (0, 0.0, 1.0, True), (1, 0.5, 0.5, True), (1, 0.5, 0.5, True), (2, 1.0, 1.0, False)], "row int, p double, q double, mask boolean")
    assert [r.jsd for r in scoring.masked_jsd(p, ["row"]).orderBy("row").collect()] == pytest.approx([math.log(2), 0, 0])
    soft = scoring.masked_softmax(p.withColumn("logit", F.col("p")), ["row"])
    assert soft.where("row = 2").first()["probability"] == 0
    assert sum(scoring.whole_word_mask(5, 0.0, 1)) == 1
    assert [sum(x) for x in zip(*scoring.complementary_masks(7, 3, 1))] == [1] * 7


def test_summaries_of_a_text(spark):
    df = scored(spark, [("t:1", 0, 1, 2.0, 0.5), ("t:1", 0, 2, 0.0, 0.5), ("t:1", 1, 2, 1.0, 0.5), ("t:1", 1, 3, 1.0, 0.5)])
    row = corpus_audit.text_summaries(df).first()
    assert row.zero_destination_proportion == 0.25 and row.source_groups == 2 and row.words == 4
    both = df.withColumn("corpus", F.lit("a")).unionByName(df.withColumn("corpus", F.lit("b")))
    assert corpus_audit.feature_differences(both, ("count",), "corpus", "a", "b").first()["smd"] == 0


def test_alignment(spark):
    side = lambda tokens: spark.createDataFrame([("t", i, x) for i, x in enumerate(tokens)], "text_id string, position int, token string")
    blocks = reconcile.align_tokens(side(["a", "b", "x", "c"]), side(["a", "b", "c"]))
    assert sorted(r.word_index for r in reconcile.verified_positions(blocks).collect()) == [0, 1, 3]


def test_digest_tells_boundaries_apart(spark):
    df = spark.createDataFrame([(1, ["ab", "c"]), (2, ["a", "bc"])], "i int, words array<string>")
    assert readers.relation_digest(df.select("words"), []).distinct().count() == 2


def test_hashed_draws_are_halves(spark):
    events = spark.createDataFrame([(f"t:{t}", f"s{i}") for t in range(2) for i in range(5 + t)], "text_id string, subject_id string")
    rows = draws.half_draws(events, 3, 1).collect()
    for t in range(2):
        for d in range(3):
            own = [r for r in rows if r.text_id == f"t:{t}" and r.draw == d]
            assert len({r.subject_id for r in own}) == len(own) == 5 + t and sum(r.half == 0 for r in own) == (5 + t) // 2


def test_failed_checks(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    rules = {"a": {"positive": F.col("x") > 0, "any": F.lit(True)}, "b": {"any": F.lit(True)}}
    failed = readers.failed_checks({"a": df, "b": df.where("x > 5")}, rules).collect()
    assert sorted(map(tuple, failed)) == [("a", "positive", 1), ("b", "any", 1)]


def test_aoi_conversion_counts_reasons_in_order(spark):
    areas = spark.createDataFrame([("r1", "p1", "1", "t1", "1", None), ("r1", "p1", "1", "t1", "2", "2"), ("r1", "p1", "1", "t1", "3", None)], "RECORDING_SESSION_LABEL string, Participant_ID string, TRIAL_INDEX string, Text_ID string, IA_ID string, Word_Number string")
    fix = spark.createDataFrame([("r1", "1", "t1", "1", "1", "200"), ("r1", "1", "t1", ".", "2", "100"), ("r1", "1", "t1", "2", "3", "150"), ("r1", "9", "t1", "2", "4", "150"), ("r1", "1", "t2", "2", "5", "150"), ("r1", "1", "t1", "3", "6", "150"), ("r1", "1", "t1", "2", "7", "-1")], "RECORDING_SESSION_LABEL string, TRIAL_INDEX string, page string, CURRENT_FIX_INTEREST_AREA_INDEX string, CURRENT_FIX_INDEX string, CURRENT_FIX_DURATION string")
    lines = spark.createDataFrame([("t1", 0, 0), ("t1", 1, 0)], "text_id string, word_index long, line_id long")
    kept, report = readers.convert_reports(areas, fix, lines)
    assert sorted((r.word_index, r.fixation_order) for r in kept.collect()) == [(0, 1), (1, 3)]
    assert {r.reason: r.n for r in report.collect()} == {"written": 2, "outside": 1, "missing_trial": 1, "page_mismatch": 1, "unmapped_area": 1, "bad_number": 1}
