"""Labels of words in trees of heads, against a walk up from every word."""

import time

import numpy as np
from pyspark.sql import functions as F

from pathloom.operators import trees


def walk(heads):
    """{word: its way to the root} and whether the heads form no tree."""
    ways = {}
    for w in heads:
        way = [w]
        while (up := heads.get(way[-1])) is not None and up not in way:
            way.append(up)
        ways[w] = way
    roots = [w for w, h in heads.items() if w == h]
    return ways, len(roots) != 1 or any(way[-1] != roots[0] for way in ways.values())


def distance(a, b):
    return min(i + b.index(x) for i, x in enumerate(a) if x in b)


def labelled(df):
    """Labels, and distances of all pairs of a sentence."""
    w = trees.with_tree_labels(df)
    other = w.select("text_id", "sentence_number", *[F.col(c).alias(f"b_{c}") for c in ("word_index", "depth", "chains")])
    pairs = w.where("not syntax_missing").join(other, ["text_id", "sentence_number"])
    steps = trees.tree_distance(F.col("depth"), F.col("chains"), F.col("b_depth"), F.col("b_chains"))
    return w.collect(), pairs.select("text_id", "sentence_number", "word_index", "b_word_index", steps.alias("steps")).collect()


SCHEMA = "text_id string, sentence_number long, word_index long, head_word_index long, other string"


def test_labels_equal_the_walk(spark, monkeypatch):
    """Random trees, chains, stars, cycles, two roots, absent and null heads, over blocks that cut sentences."""
    monkeypatch.setattr(trees, "BLOCK", 7)
    rng = np.random.default_rng(1)
    sentences = {}
    for i in range(60):
        n = int(rng.integers(1, 25))
        words = np.sort(rng.choice(1000, n, replace=False)) - 500
        kind = i % 6
        parent = [0 if k == 0 else k - 1 if kind == 1 else 0 if kind == 2 else int(rng.integers(0, k)) for k in range(n)]
        order = rng.permutation(n)
        heads = {int(words[order[k]]): int(words[order[parent[k]]]) for k in range(n)}
        some = [int(w) for w in words]
        if kind == 3:
            heads[some[-1]] = some[0]  # another root's child, a cycle, or nothing new
            heads[some[0]] = some[-1]
        if kind == 4:
            heads[some[0]] = some[0]
            heads[some[-1]] = some[-1]
        if kind == 5 and i % 12 == 5:
            heads[some[n // 2]] = None if i % 24 == 5 else 5000
        sentences[f"t{i % 3}" if i % 10 else None, i] = heads
    rows = [(t, s, w, h, "x") for (t, s), heads in sentences.items() for w, h in heads.items()]
    words, pairs = labelled(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = {(r.text_id, r.sentence_number, r.word_index): r for r in words}
    assert len(found) == len(words) == len(rows)
    steps = {(r.text_id, r.sentence_number, r.word_index, r.b_word_index): r.steps for r in pairs}
    trees_seen = 0
    for (t, s), heads in sentences.items():
        ways, broken = walk(heads)
        trees_seen += not broken
        for w, way in ways.items():
            r = found[t, s, w]
            assert r.syntax_missing == broken and r.other == "x"
            assert (r.depth, r.chains is None) == ((None, True) if broken else (len(way) - 1, False))
            if not broken and t is not None:  # a join by a null text finds nothing
                assert len(r.chains) <= 6 and all(steps[t, s, w, x] == distance(way, ways[x]) for x in ways)
    assert 20 < trees_seen < 60


def test_a_sentence_of_20000_words(spark):
    """A chain has one heavy chain, so labels stay short; and a random tree's are at most logarithmic."""
    rng = np.random.default_rng(3)
    chain = [("t", 1, i, max(0, i - 1), "") for i in range(20_000)]
    random_tree = [("t", 2, i, int(rng.integers(0, i)) if i else 0, "") for i in range(20_000)]
    df = spark.createDataFrame(chain + random_tree, SCHEMA).repartition(4).cache()
    df.count()
    began = time.time()
    words = trees.with_tree_labels(df).collect()
    assert time.time() - began < 10
    assert all(not r.syntax_missing for r in words)
    assert all(r.depth == r.word_index and len(r.chains) == 1 for r in words if r.sentence_number == 1)
    assert max(len(r.chains) for r in words) <= 15
    by_word = {r.word_index: r for r in words if r.sentence_number == 2}
    ways, _ = walk({r[2]: r[3] for r in random_tree[:400]})
    sample = [(int(a), int(b)) for a, b in rng.integers(0, 400, (200, 2))]
    rows = [(*by_word[a][4:6], *by_word[b][4:6]) for a, b in sample]
    rows = [(by_word[a].depth, by_word[a].chains, by_word[b].depth, by_word[b].chains) for a, b in sample]
    kind = "array<struct<chain:bigint,until:int>>"
    got = spark.createDataFrame(rows, f"a int, x {kind}, b int, y {kind}").select(trees.tree_distance(F.col("a"), F.col("x"), F.col("b"), F.col("y")))
    assert [r[0] for r in got.collect()] == [distance(ways[a], ways[b]) for a, b in sample]
    df.unpersist()


def test_repeated_words_raise_and_empty_tables_pass(spark):
    df = spark.createDataFrame([("t", 1, 0, 0, ""), ("t", 1, 0, 0, "")], SCHEMA)
    try:
        trees.with_tree_labels(df).collect()
    except Exception as error:  # noqa: BLE001  Spark's own class
        assert "occurs twice" in str(error)
    else:
        raise AssertionError
    assert trees.with_tree_labels(df.where("false")).count() == 0
    flagged = trees.with_tree_labels(spark.createDataFrame([("t", 1, 0, 0, "", True)], SCHEMA + ", syntax_missing boolean"))
    assert [(r.depth, r.syntax_missing) for r in flagged.collect()] == [(0, True)]
