"""Published rules of the operators, each with a case that another rule would fail."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import expressions as E
from pathloom.functions.bounds import few
from pathloom.operators import audit, compare, corpus_audit, intervals, metrics, model, pairs, resample, scoring, transitions
from pathloom.sources import matfile, readers, results

from .test_draws import in_order, uniform

# -- reports ------------------------------------------------------------------------------------------------------

AREAS = "RECORDING_SESSION_LABEL,Participant_ID,TRIAL_INDEX,Text_ID,IA_ID,Word_Number,IA_TOP,IA_BOTTOM"
FIXES = "RECORDING_SESSION_LABEL,TRIAL_INDEX,page,CURRENT_FIX_INTEREST_AREA_INDEX,CURRENT_FIX_INDEX,CURRENT_FIX_DURATION"


def report(tmp_path, name, header, rows):
    path = tmp_path / name
    path.write_bytes("\r\n".join([header, *rows, ""]).encode("cp1252"))
    return str(path)


def test_reports_are_converted_end_to_end(spark, tmp_path):
    areas = ["r1,é€1,1,18,1,NA,70,154", "r1,é€1,1,18,2,2,70,154", "r1,é€1,1,18,3,3,160,200", "r1,é€1,1,18,4,,70,154", "r1,é€1,1,18,5,5,90,80"]
    fixes = ["r1,1,18,1,1,200", "r1,1,18,.,2,100", "r1,1,18,2,3,150", "r9,1,18,2,4,150", "r1,1,19,2,5,150", "r1,1,18,4,6,150", "r1,1,18,5,7,9", "r1,1,18,3,8,-1", "r1,1,18,3,9,x"]
    main = readers.read_report(spark, report(tmp_path, "areas.csv", AREAS, areas), readers.AREA_REPORT)
    seen = readers.read_report(spark, report(tmp_path, "fixes.csv", FIXES, fixes), readers.FIXATION_REPORT)
    mapped, lines = intervals.line_map(intervals.observed_bounds(main))
    visits, reasons = readers.convert_reports(main, seen, mapped)
    rows = sorted(map(tuple, visits.collect()))
    assert rows == [("é€1", "18", 0, 1, 200.0, 0), ("é€1", "18", 1, 3, 150.0, 0)]
    want = {"written": 2, "outside": 1, "missing_trial": 1, "page_mismatch": 1, "unmapped_area": 1, "missing_line": 1, "bad_number": 2}
    assert {r.reason: r.n for r in reasons.collect()} == want
    one = readers.conversion_report(main, readers.mark_reports(main, seen, mapped), lines).collect()
    assert len(one) == 1 and (one[0].sessions, one[0].trials, one[0].word_mappings, one[0].fixation_rows, one[0].written) == (1, 1, 4, 9, 2)
    assert (one[0].line_mapped_words, one[0].line_missing_words, one[0].excluded) == (3, 0, {"18:4": 1, "18:5": 1})
    readers.write_line_map(mapped, str(tmp_path / "map"))
    written = spark.read.option("header", True).csv(str(tmp_path / "map")).collect()
    assert [tuple(r) for r in written] == [("18", "0", "0"), ("18", "1", "0"), ("18", "2", "1")]


def test_bounds_that_cannot_be_used_are_skipped(spark):
    schema = "Text_ID string, IA_ID string, Word_Number string, IA_TOP string, IA_BOTTOM string"
    rows = [("1", "1", None, "0", "10"), ("1", "1", "NA", "0", "10"), ("1", "2", ".", "0", "10"), ("1", "3", "3.0", "0", "10"), ("1", "4", "4", "9", "1"), ("1", "5", "x", "0", "1")]
    got = intervals.observed_bounds(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.word_index for r in got) == [0, 0, 2]


def test_a_majority_cannot_hide_another_line(spark):
    rows = [("1", 0, 0.0, 10.0)] * 2 + [("1", 0, 20.0, 30.0)] + [("1", 1, 0.0, 10.0)] * 3 + [("1", 2, 20.0, 30.0)] * 3
    observed = spark.createDataFrame(rows, "text_id string, word_index long, top double, bottom double")
    mapped, lines = intervals.line_map(observed)
    assert lines.first()["violations"] == 1
    with pytest.raises(Exception, match="meet another line"):
        mapped.collect()
    assert intervals.line_map(observed, strict=False)[0].count() == 0


def test_area_one_is_word_one(spark):
    schema = "Text_ID string, IA_ID string, Word_Number string"
    good = readers.area_words(spark.createDataFrame([("t", "1", "NA"), ("t", "2", "2"), ("u", "2", "2")], schema))
    assert sorted(map(tuple, good.collect())) == [("t", "1", 1), ("t", "2", 2), ("u", "1", 1), ("u", "2", 2)]
    with pytest.raises(Exception, match="another word"):
        readers.area_words(spark.createDataFrame([("t", "1", "7")], schema)).collect()
    with pytest.raises(Exception, match="several words"):
        readers.area_words(spark.createDataFrame([("t", "2", "2"), ("t", "2", "3")], schema)).collect()


def test_values_that_cannot_be_read_raise(spark, tmp_path):
    header = "subject_id,text_id,word_index,fixation_order,duration_ms,line_id\n"
    for i, row in enumerate(("s,t:1,x,1,5,0", ",t:1,0,1,5,0", "s,t:1,0,,5,0")):
        path = tmp_path / f"{i}.csv"
        path.write_text(header + row + "\n")
        with pytest.raises(Exception, match="cannot be read"):
            readers.read_fixations(spark, str(path)).collect()
    fine = tmp_path / "fine.csv"
    fine.write_text(header + "s,t:1,0,1,5,\n")
    assert readers.read_fixations(spark, str(fine)).first()["line_id"] is None


def test_layouts_that_lack_words_or_texts_differ(spark):
    rows = [("a", t, w, f"w{w}", 0.0, 10.0) for t in ("t:1", "t:2") for w in range(3)] + [("b", "t:1", 0, "w0", 0.0, 10.0), ("b", "t:1", 9, "w9", 0.0, 10.0)]
    layouts = spark.createDataFrame(rows, "subject_id string, text_id string, word_index long, content string, top double, bottom double")
    got = {r.text_id: r for r in intervals.partition_agreement(layouts).collect()}
    assert (got["t:1"].words, got["t:1"].content_differs, got["t:1"].line_differs) == (4, 3, 3)
    assert (got["t:2"].words, got["t:2"].content_differs) == (3, 3)


# -- MAT-files ----------------------------------------------------------------------------------------------------


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(kind, shape, name, body):
    flags = element(6, struct.pack("<II", kind, 0))
    return element(14, flags + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode()) + body)


def to_mat(value, name=""):
    if isinstance(value, str):
        return matrix(4, (1, len(value)), name, element(17, value.encode("utf-16-le")))
    if isinstance(value, list) and value and isinstance(value[0], dict):
        fields = list(value[0])
        names = b"".join(f.encode().ljust(32, b"\0") for f in fields)
        small = struct.pack("<HHi", 5, 4, 32)
        return matrix(2, (1, len(value)), name, small + element(1, names) + b"".join(to_mat(v[f]) for v in value for f in fields))
    array = np.atleast_2d(np.asarray(value, float))
    return matrix(6, array.shape, name, element(9, array.tobytes(order="F")))


def test_result_files_are_read(spark, tmp_path):
    words = [{"content": "Héllo", "fixPositions": [1.0, 4.0], "nFixations": 2.0}, {"content": "b", "fixPositions": [], "nFixations": []}]
    fixes = [{"x": [5.0, 6.0, 7.0, float("nan")], "y": [5.0] * 4, "duration": [10.0, 20.0, 30.0, 40.0]}]
    bounds = [[0.0, 0.0, 10.0, 10.0], [10.0, 0.0, 20.0, 10.0]]
    slots = [{"content": "Héllo b", "word": words, "allFixations": fixes, "wordbounds": bounds}, {"content": "none", "word": float("nan"), "allFixations": float("nan"), "wordbounds": []}]
    packed = zlib.compress(to_mat(slots, "sentenceData"))
    content = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed
    (tmp_path / "resultsABC_nr.mat").write_bytes(content)
    rows = sorted(matfile.read_results(spark, str(tmp_path)).collect(), key=lambda r: r.slot)
    assert [(r.subject_id, r.text_id) for r in rows] == [("ABC", "NR:1"), ("ABC", "NR:2")]
    assert [w.content for w in rows[0].words] == ["Héllo", "b"] and rows[0].words[0].fix_positions == [1.0, 4.0] and rows[0].words[1].n_fixations == 0
    assert rows[0].bounds == bounds and [f.duration for f in rows[0].fix] == [10.0, 20.0, 30.0, 40.0] and rows[0].fix[3].x is None
    assert rows[1].words is None
    counts = matfile.slot_counts(matfile.read_results(spark, str(tmp_path))).first()
    assert (counts.slots, counts.valid, counts.missing) == (2, 1, 1)
    visits, _ = readers.map_claims(matfile.read_results(spark, str(tmp_path)).where("words is not null"))
    assert sorted((r.word_index, r.fixation_order, r.duration_ms) for r in visits.collect()) == [(0, 1, 20.0), (0, 4, 80.0)]
    with pytest.raises(ValueError, match="level 5"):
        matfile.variables(b"x" * 200)
    (tmp_path / "resultsDEF_nr.mat").write_bytes(b"broken")
    assert matfile.read_results(spark, str(tmp_path), ["ABC"]).count() == 2  # the other file is not opened


def test_result_files_are_a_table(spark, tmp_path):
    """A scan of one subject reads its file alone: one of the others here cannot be parsed."""
    slots = [{"content": f"s{i}", "word": float("nan"), "allFixations": float("nan"), "wordbounds": []} for i in range(3)]
    packed = zlib.compress(to_mat(slots, "sentenceData"))
    content = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed
    for name in ("resultsA_nr.mat", "resultsB_nr.mat", "resultsB_tsr.mat"):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "resultsC_nr.mat").write_bytes(b"broken")
    results.register(spark)
    load = lambda **options: spark.read.format(results.FORMAT).options(**options).load(str(tmp_path))
    assert load(subjects="A").rdd.getNumPartitions() == 1
    both = load(subjects="A, B")
    assert both.rdd.getNumPartitions() == 3 and both.count() == 9
    assert sorted((r.subject_id, r.text_id) for r in both.where("text_id = 'TSR:2'").collect()) == [("B", "TSR:2")]
    assert load(subjects="B", tasks="tsr").rdd.getNumPartitions() == 1 and both.count() == 9
    with pytest.raises(Exception, match="level 5"):
        load().count()
    narrow = spark.read.format(results.FORMAT).option("subjects", "B").schema("slot int, subject_id string").load(str(tmp_path))
    assert sorted(map(tuple, narrow.collect())) == [(i, "B") for i in (1, 1, 2, 2, 3, 3)]
    assert load(subjects="nobody").count() == 0


def test_names_of_result_files(spark):
    names = spark.createDataFrame([("/a/resultsZAB_nr.mat",)], "path string")
    assert tuple(names.select(*readers.identity(F.col("path"))).first()) == ("ZAB", "NR")
    with pytest.raises(Exception, match="not a result file"):
        spark.createDataFrame([("/a/other.mat",)], "path string").select(*readers.identity(F.col("path"))).collect()


# -- words and candidates -------------------------------------------------------------------------------------------


def test_word_length_is_logged_as_it_is(spark):
    schema = "text_id string, word_index long, surface string, length string, match_share string, responses string, sentence_number string"
    row = pairs.word_properties(spark.createDataFrame([("t", 0, "abcde.", "5", "0.5", "9", "2")], schema)).first()
    assert row.log_length == pytest.approx(math.log(5)) and row.terminal_punctuation and row.sentence_number == 2 and row.cloze_logit == 0 and not row.cloze_missing
    nested = spark.createDataFrame([("t", ["abc", "de!"], [[0.0, 1.0, 2.0, 3.0], [2.0, 1.0, 4.0, 3.0]])], "text_id string, words array<string>, bounds array<array<double>>")
    rows = readers.nested_words(nested).orderBy("word_index").collect()
    assert [r.log_length for r in rows] == pytest.approx([math.log(3), math.log(2)]) and [(r.top, r.bottom) for r in rows] == [(1.0, 3.0)] * 2
    assert [r.terminal_punctuation for r in rows] == [False, True]


def test_nearest_area(spark):
    schema = "text_id string, word_index long, ia_id long"
    got = pairs.nearest_area(spark.createDataFrame([("t", 4, 5), ("t", 4, 9), ("t", 6, 1)], schema))
    assert {r.word_index: r.ia_id for r in got.collect()} == {4: 5, 6: 1}
    with pytest.raises(Exception, match="several nearest"):
        pairs.nearest_area(spark.createDataFrame([("t", 4, 4), ("t", 4, 6)], schema)).collect()


def test_candidates_that_only_one_design_has(spark):
    schema = "text_id string, src_word long, dst_word long"
    a, b = spark.createDataFrame([("t", 0, 1), ("t", 0, 2)], schema), spark.createDataFrame([("t", 0, 2), ("t", 1, 2)], schema)
    assert sorted(map(tuple, pairs.same_candidates(a, b).collect())) == [("t", 0, 1, "first"), ("t", 1, 2, "second")]


def test_a_word_verified_twice_is_verified_once(spark):
    events = spark.createDataFrame([("s", "t", 0, 1, "forward", 1.0), ("s", "t", 1, 2, "forward", 1.0)], "subject_id string, text_id string, src_word long, dst_word long, event_type string, weight double")
    verified = spark.createDataFrame([("t", 0), ("t", 0), ("t", 1)], "text_id string, word_index long")
    kept, dropped = transitions.verified_only(events, verified)
    assert kept.count() == 1 and tuple(dropped.first()) == (1.0, 1)


# -- fits -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t:{t}", s, d, float(rng.poisson(2)), float(rng.normal()), float(rng.normal())) for t in range(6) for s in range(4) for d in range(s + 1, 6)]
    return spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, count double, a double, b double").cache()


def test_shared_designs_give_what_laid_out_ones_do(spark, design, monkeypatch):
    folds = model.folds_table(spark, [f"t:{t}" for t in range(6)], 3)
    sides = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "draw int, half int")
    counts = design.where("count > 0").select(*model.KEYS, "count", F.lit(0).alias("draw"), (F.col("src_word") % 2).cast("int").alias("half"))
    bare = design.drop("count")
    run = lambda: {tuple(r)[:5]: (r["count"], r.probability) for r in model.crossfit_many(bare, counts, ("a", "b"), folds, ["draw", "half"], sides).collect()}
    shared = run()
    assert len(shared) == 3 * design.count() and sum(v[0] for v in shared.values()) == design.agg(F.sum("count")).first()[0]
    draws = spark.createDataFrame([(0, "t:0", 2), (0, "t:3", 1), (1, "t:5", 3)], "draw int, text_id string, times int")
    fitted = lambda: {(r.draw, r.feature): r.coefficient for r in model.fit_draws(design, draws, ("a", "b")).collect()}
    whole = fitted()
    monkeypatch.setattr(model, "SHARED_NUMBERS", 4)
    laid, weighted = run(), fitted()
    assert laid.keys() == shared.keys() and all(laid[k] == pytest.approx(shared[k], abs=1e-9) for k in laid)
    assert weighted == pytest.approx(whole, abs=1e-9)


def test_held_out_nll_is_a_mean_over_texts(spark, design):
    folds = model.folds_table(spark, [f"t:{t}" for t in range(6)], 3)
    row = model.crossfit_nll(design, ("a", "b"), folds).first()
    each = [r.nll for r in model.text_nll(model.fit_predict_folds(design, ("a", "b"), folds)).collect()]
    assert row.texts == 6 and row.nll == pytest.approx(np.mean(each))
    spread = metrics.coefficient_variability(model.fold_fits(design, ("a", "b"), folds), []).collect()
    assert {r.feature: r.fits for r in spread} == {"a": 3, "b": 3} and all(r.minimum < r.maximum and r.sd > 0 for r in spread)


def test_few_rows_only(spark):
    assert len(few(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        few(spark.range(3), 2, "rows")


def test_subsets_are_balanced_and_checked():
    subsets = resample.balanced_subsets([f"s{i}" for i in range(7)], 3, 20, 5)
    used = [sum(f"s{i}" in x for x in subsets) for i in range(7)]
    assert max(used) - min(used) <= 1 and all(len(set(x)) == 3 for x in subsets)
    for k in (0, 8):
        with pytest.raises(ValueError):
            resample.balanced_subsets([f"s{i}" for i in range(7)], k, 1, 5)


# -- corpora --------------------------------------------------------------------------------------------------------


def test_feature_differences_weigh_corpora_by_their_texts(spark):
    rng = np.random.default_rng(2)
    values = {("a", i): rng.normal() for i in range(3)} | {("b", i): 1 + 4 * rng.normal() for i in range(9)}
    df = spark.createDataFrame([(c, f"t:{i}", float(v)) for (c, i), v in values.items()], "corpus string, text_id string, x double")
    a, b = (np.array([v for (c, _), v in values.items() if c == side]) for side in "ab")
    pooled = math.sqrt((2 * a.var(ddof=1) + 8 * b.var(ddof=1)) / 10)
    row = corpus_audit.feature_differences(df, ("x",), "corpus", "a", "b", 50, 7).first()
    assert row.smd == pytest.approx((a.mean() - b.mean()) / pooled)
    order = {c: in_order([f"t:{i}" for i in range(n)]) for c, n in (("a", 3), ("b", 9))}
    drawn = lambda c, d: np.mean([values[c, int(order[c][uniform(7, c, d, j) * len(order[c]) >> 32][2:])] for j in range(len(order[c]))])
    gaps = [(drawn("a", d) - drawn("b", d)) / pooled for d in range(50)]
    assert (row.low, row.high) == pytest.approx(tuple(np.quantile(gaps, (0.025, 0.975))))
    same = df.where("corpus = 'a'").unionByName(df.where("corpus = 'a'").withColumn("corpus", F.lit("b")))
    assert corpus_audit.feature_differences(same, ("x",), "corpus", "a", "b", 30, 7).first()["smd"] == 0


def test_domains_that_lie_apart_are_told_apart(spark):
    rows = [("a" if i < 10 else "b", f"t:{i}", *[float(6 * i + j) for j in range(len(corpus_audit.SUMMARIES))]) for i in range(20)]
    df = spark.createDataFrame(rows, "corpus string, text_id string, " + ", ".join(f"{c} double" for c in corpus_audit.SUMMARIES))
    row = corpus_audit.domain_classifier(df, "corpus", "b", 19, 7).first()
    assert row.balanced_accuracy >= 0.9 and row.area > 0.95 and row.p == row.p_area == 1 / 20 and row.status == "pilot"


def test_corpora_are_audited_as_a_whole(spark, design):
    first, second = design.where("text_id < 't:3'"), design.where("text_id >= 't:3'")
    found = audit.audit_corpora(first, second, ("a", "b"), 5, 4, 1)
    assert set(found) == {"summaries", "features", "coefficients", "first_to_second", "second_to_first", "classifier"}
    assert found["features"].count() == found["coefficients"].count() == 2 and found["summaries"].count() == 6
    assert found["first_to_second"].first()["texts"] == 3 and found["classifier"].first()["permutations"] == 4


# -- contrasts ------------------------------------------------------------------------------------------------------


def test_a_deletion_that_reaches_nought_takes_the_sign(spark):
    estimates = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "deleted string, median double")
    flags = lambda full, threshold: tuple(compare.change_flags(estimates, spark.createDataFrame([(full,)], "median double"), threshold).first())
    assert flags(1.0, 0.0) == (True, True)
    assert flags(0.5, 1.0) == (True, False) and flags(-1.0, 0.5) == (True, True) and flags(0.0, 0.0) == (False, True)


def test_thresholds_keep_texts_with_enough_edges(spark):
    shift = {"gaze": 0.2, "mlm": 0.1, "shuffled": 0.0, "position": -0.1}
    rows = [(s, c, t, r, n) for s in (1, 2) for c, x in shift.items() for t, r, n in (("a", x, 5), ("b", x / 2, 25), ("c", -0.2 + x, 35))]
    rows += [(s, c, "d", None if c == "mlm" else 0.99, 12) for s in (1, 2) for c in shift]
    runs = spark.createDataFrame(rows, "seed int, condition string, text_id string, correlation double, n_edges int")
    cells = compare.contrast_cells(runs, "gaze", ["mlm", "shuffled", "position"])
    kept = {(r.threshold, r.other): r for r in compare.edge_thresholds(compare.retained(cells, (4, 20, 30))).collect()}
    assert [kept[t, "mlm"].texts for t in (4, 20, 30)] == [3, 2, 1] and len(kept) == 9
    z = lambda x: math.atanh(max(min(x, 1 - 1e-7), 1e-7 - 1))
    each = [z(0.2) - z(0.1), z(0.1) - z(0.05), z(0.0) - z(-0.1)]
    row = kept[4, "mlm"]
    assert row.mean == pytest.approx(np.mean(each)) and row.largest_contribution == pytest.approx(max(map(abs, each)) / 3)
    assert row.max_r == pytest.approx(0.2) and row.max_z == pytest.approx(z(0.2)) and row.near_perfect == 0
    assert kept[4, "shuffled"].near_perfect == 4 and kept[20, "mlm"].max_r == pytest.approx(0.1)
    strata = {(r.other, r.stratum): r.texts for r in compare.edge_strata(cells).collect()}
    assert [strata["mlm", s] for s in ("4-9", "10-19", "20-29", "30+")] == [1, 1, 1, 1]


def test_pooled_correlation_is_a_mean_over_runs(spark):
    rows = [("gaze", s, float(x), float(x * (1 if s else -1))) for s in range(2) for x in range(4)]
    got = compare.pooled_correlation(spark.createDataFrame(rows, "condition string, seed int, x double, y double"), ["condition"]).first()
    assert got.runs == 2 and got.pooled_r == pytest.approx(0)


def test_identity_of_halves_pools_defined_texts(spark):
    rows = [(spec, "t:1", 0, d, float(v)) for spec, vs in (("p", [1, 2, 3]), ("q", [2, 4, 6])) for d, v in enumerate(vs)]
    rows += [(spec, "t:2", 0, d, 9.0) for spec in "pq" for d in range(2)]
    cells = spark.createDataFrame(rows, "spec string, text_id string, src_word long, dst_word long, residual double")
    assert (metrics.identity(cells).first().n_edges, metrics.identity(cells, defined_texts_only=True).first().n_edges) == (5, 3)


def test_bins_are_half_open_and_named_as_published(spark):
    assert metrics.bin_names(metrics.DIAGNOSTIC_BINS["expected"]) == ["0-0.5", "0.5-1", "1-5", ">=5"]
    names = metrics.bin_names([0.0, 0.5, 1.0])
    got = spark.createDataFrame([(0.0,), (0.5,), (0.999,), (1.0,), (-1.0,)], "x double").select(E.within_bins(F.col("x"), [0.0, 0.5, 1.0], names).alias("s")).collect()
    assert [r.s for r in got] == ["0-0.5", "0.5-1", "0.5-1", ">=1", None]


def test_undefined_correlations_stay_undefined(spark):
    rows = [("t:1", s, float(x), float(y)) for s, x, y in ((0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 5, 5), (2, 1, 2), (2, 2, 1))]
    m = metrics.source_equal(spark.createDataFrame(rows, "text_id string, src_word long, x double, y double"), ["text_id"]).first()
    first = float(np.corrcoef([0, 1, 2], [0, 1, 1])[0, 1])
    assert (m.n_sources, m.defined_sources) == (3, 2) and m.fisher_equal == pytest.approx(math.tanh((math.atanh(first) + math.atanh(1e-7 - 1)) / 2))
    runs = spark.createDataFrame([(0, "gaze", "t:1", 0.5, 9, 1.0, 3), (0, "gaze", "t:2", None, 9, 1.0, 3)], "seed int, condition string, text_id string, correlation double, n_edges int, mlm_nll double, mlm_tokens int")
    assert compare.condition_summary(runs).first()["macro_r"] == pytest.approx(0.5)


def test_spearman_brown(spark):
    df = spark.createDataFrame([(0.5,), (-1.0,), (-0.8,), (1.0,), (None,)], "r double")
    got = [tuple(r) for r in df.select(E.spearman_brown(F.col("r")), E.attenuation_ceiling(F.col("r"))).collect()]
    assert got[0] == pytest.approx((2 / 3, math.sqrt(0.5)), abs=1e-12) and got[1] == (-1.0, 0.0) and got[2][0] == -1.0 and got[3] == (1.0, 1.0) and got[4] == (None, None)


# -- vectors --------------------------------------------------------------------------------------------------------


def test_words_without_tokens_have_a_zero_row(spark):
    states = spark.createDataFrame([("t", 0, [1.0, 3.0]), ("t", 2, [5.0, 7.0]), ("u", -1, [9.0, 9.0])], "text_id string, word_index int, state array<double>")
    sizes = spark.createDataFrame([("t", 4), ("u", 1)], "text_id string, n_words int")
    rows = scoring.word_pool(states, "mean", sizes).orderBy("text_id", "word_index").collect()
    assert [(r.text_id, r.word_index, r.state, r.valid) for r in rows] == [("t", 0, [1.0, 3.0], True), ("t", 1, [0.0, 0.0], False), ("t", 2, [5.0, 7.0], True), ("t", 3, [0.0, 0.0], False), ("u", 0, [0.0, 0.0], False)]
    with pytest.raises(Exception, match="smaller than an observed"):
        scoring.word_pool(states, "mean", spark.createDataFrame([("t", 2), ("u", 1)], "text_id string, n_words int")).collect()


def test_the_exact_unit(spark):
    xs = [-7.0, -3.0, -1.0, -0.1, 0.0, 0.3, 1.0, 2.5, 5.9, 8.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scoring.error_function(F.col("x")).alias("e"), scoring.gelu(F.col("x")).alias("g")).collect()
    assert [r.e for r in rows] == pytest.approx([math.erf(x) for x in xs], abs=1e-14)
    assert [r.g for r in rows] == pytest.approx([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-13)


def test_heads(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 3))
    weights, down, up, d, u = rng.standard_normal((3, 3)), rng.standard_normal((2, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2), rng.standard_normal(3)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    row = df.select(scoring.bilinear_score(F.col("a"), F.col("b"), weights, 0.5).alias("s"), scoring.bottleneck(F.col("a"), down, up, d, u).alias("h")).first()
    h = down @ a + d
    h = 0.5 * h * (1 + np.array([math.erf(x / math.sqrt(2)) for x in h]))
    assert row.s == pytest.approx(a @ weights @ b / math.sqrt(3) + 0.5) and row.h == pytest.approx((a + up @ h + u).tolist())


def test_checkpoints_that_differ(spark):
    df = spark.createDataFrame([("x", "a", "1"), ("y", "b", None)], "path string, model string, rank string")
    got = sorted(map(tuple, scoring.checkpoint_mismatches(df, {"model": "a", "rank": "1"}).collect()), key=repr)
    assert got == [("y", "model", "b", "a"), ("y", "rank", None, "1")]


# -- files ----------------------------------------------------------------------------------------------------------


def test_results_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, None], None), (2, [], 3.0)], "i int, xs array<double>, v double")
    readers.write_result(df, str(tmp_path / "result"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "result" / "json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.option("header", True).csv(str(tmp_path / "result" / "csv")).columns == ["i", "xs", "v"]
    for name in ("seed1_gaze.bin", "seed12_mlm.bin", "other.bin"):
        (tmp_path / name).write_bytes(name.encode())
    files = readers.file_digests(spark, str(tmp_path / "*.bin")).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert files.count() == 3
    found = readers.run_files(spark, str(tmp_path / "*.bin")).collect()
    assert sorted((r.seed, r.condition) for r in found) == [(1, "gaze"), (12, "mlm")]
    listed = files.where("path <> 'other.bin'").select("path", F.when(F.col("path") == "seed1_gaze.bin", "x").otherwise(F.col("digest")).alias("digest"))
    listed = listed.unionByName(spark.createDataFrame([("gone.bin", "y")], "path string, digest string"))
    got = sorted(map(tuple, readers.manifest_differences(files, listed).collect()))
    assert got == [("gone.bin", "not found"), ("other.bin", "not listed"), ("seed1_gaze.bin", "differs")]


def test_nested_results_become_rows(spark):
    df = spark.createDataFrame([({"a": {"x": 1.0, "y": 2.0}, "b": {"x": 3.0}},)], "r map<string, map<string, double>>")
    got = sorted(map(tuple, readers.nested_rows(df, "r", ["spec", "metric"]).collect()))
    assert got == [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)]
