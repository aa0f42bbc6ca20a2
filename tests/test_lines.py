"""Lines of words and their pairs, against pairs that are written out; fits over lines against fits over the written design."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import lines, model, pairs, responses
from pathloom.plans import queries
from pathloom.sources import tables

TEXTS = [
    ("1:0", "the cat saw The dog. the dog ran away"),
    ("1:1", "one"),
    ("2:0", "a b c d e f a c e b. a z"),
    ("2:1", None),
    ("2:2", ""),
    (None, "x y z"),
    ("3:0", " what, no end? yes an end! and\tthe  rest of it"),
    ("4:1", "so it goes on and on and so on. it goes"),
    ("5:1", "p q"),
    ("5:1", "p r"),
]


def written_out(text):
    """(src, dst) of all pairs of a text with their position features, and the counts of its steps."""
    tokens = text.strip(" ").split()
    first, line, lines_of = {}, 0, {}
    words = []
    for i, t in enumerate(tokens):
        words.append(first.setdefault(t.lower(), i))
        if words[-1] == i:
            lines_of.setdefault(line, []).append(i)
        line += t[-1] in ".!?"
    read = Counter((s, d) for s, d in zip(words, words[1:]) if d > s)
    out = {}
    for members in lines_of.values():
        n = len(members)
        for i, s in enumerate(members):
            for j in range(i + 1, n):
                d = members[j]
                out[s, d] = (np.log(1 + d - s), float(d - s == 1), j / max(1, n - 1), float(j < 2), float(j >= n - 2), float(read[s, d]))
    return out


def test_pair_sums_of_lines(spark):
    texts = spark.createDataFrame(TEXTS, "text_id string, text string").repartition(3)
    got = {r[0]: r[1:] for r in lines.pair_sums(lines.token_lines(texts), pairs.POSITION).collect()}
    single = {k: written_out(t) for k, t in TEXTS if k and t and k != "5:1"}
    want = {k: (len(v), *np.sum(list(v.values()), axis=0)) for k, v in single.items() if v}
    assert got.pop("5:1")[0] == 4  # two texts of one id, read place by place: twice p, then q and r
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_pairs_come_in_portions(spark, monkeypatch):
    found = lines.token_lines(spark.createDataFrame(TEXTS, "text_id string, text string").coalesce(1)).toArrow().combine_chunks()
    batch = lines.Lines(found.to_batches()[0])
    whole = list(batch.pairs(np.arange(len(batch.words))))
    monkeypatch.setattr(lines, "CELLS", 3)
    parts = list(batch.pairs(np.arange(len(batch.words))))
    assert len(whole) == 1 < len(parts) and max(len(d) for s, d in parts if len(s) > 1) <= 3
    assert all((np.concatenate(p) == w).all() for p, w in zip(zip(*parts), whole[0]))


def test_fits_over_lines_are_those_of_the_written_design(spark):
    rng = np.random.default_rng(2)
    texts = [(f"{c}:{t}", " ".join(f"w{i}" + "." * (rng.random() < 0.15) for i in rng.integers(0, 9, 25))) for c in range(6) for t in range(4)]
    found = lines.token_lines(spark.createDataFrame(texts, "text_id string, text string").repartition(3))
    rows = [(k, s, d, float(x[0]), x[5]) for k, t in texts for (s, d), x in written_out(t).items()]
    design = spark.createDataFrame(rows, "text_id string, src_word long, dst_word long, log1p_abs_distance double, count double")
    names, half = ("log1p_abs_distance",), F.split_part("text_id", F.lit(":"), F.lit(2)).cast("int") % 2
    fold = F.split_part("text_id", F.lit(":"), F.lit(1)).cast("int") % 3
    one = responses.fit_responses(found.withColumn("fold", F.lit(0)).withColumn("response", F.lit(0)), 1, 1, sources=lines.source_rows(names))
    assert one.ravel() == pytest.approx(model.fit_large(design, names)["log1p_abs_distance"], abs=1e-8)
    laid = found.withColumn("fold", fold).withColumn("response", half)
    beta = responses.fit_responses(laid, 2, 1, 3, sources=lines.source_rows(names))
    got = responses.held_out_nll(laid, beta, lines.source_rows(names))
    counts = design.where("count > 0").select(half.alias("half"), *model.KEYS, "count")
    folds = design.select("text_id", fold.alias("fold")).distinct()
    told = responses.crossfit_responses(design.drop("count"), counts, names, folds, ["half"], counts.select("half").distinct())
    want = told.groupBy("half").agg(F.sum("count").alias("n"), F.sum(-F.col("count") * F.ln("probability")).alias("nll")).orderBy("half").collect()
    assert got.ravel() == pytest.approx([x for r in want for x in (r.n, r.nll)])


def test_turn_queries_move_no_pairs(spark, tmp_path):
    """No join and no window: texts move to their ids, and what is written has a row for each line."""
    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(c, t, "user", text) for c in range(4) for t in range(2)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.turn_pair_features(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Generate" not in plan
    assert queries._laid_turns(spark, str(tmp_path), F.lit(0)).count() == 8
    assert [r.pairs for r in queries.turn_pair_features(spark, str(tmp_path)).collect()] == [60 * 59 // 2] * 8
    halves = queries.turn_crossfit_one_feature(spark, str(tmp_path)).collect()
    assert [r.events for r in halves] == [4 * 59, 4 * 59]


def test_turns_without_a_number_have_no_id(spark, tmp_path):
    spark.createDataFrame([(1, None, "user", "a b"), (1, 2, "user", "a b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.text_id for r in queries.turn_pair_features(spark, str(tmp_path)).collect()] == ["1:2"]
    assert [r.text_id for r in tables.turns(spark, str(tmp_path)).collect() if r.text_id] == ["1:2"]
