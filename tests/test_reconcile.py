"""Alignment by joins against the longest matching blocks of the standard library; closures, globs and findings."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pathloom.operators import reconcile, release


def test_alignment_equals_matching_blocks(spark):
    """Random sequences over few tokens, so that ties abound; repeated passages, empty sides, equal and disjoint texts."""
    rng = random.Random(8)
    texts = {}
    for t in range(40):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() > 0.2] if t % 2 else [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("xyz"))
        texts[f"t{t}"] = (a, b)
    texts |= {"same": (list("abcabc"), list("abcabc")), "none": (list("abc"), list("xyz")), "left": (list("ab"), []), "right": ([], list("ab"))}
    sides = [[(t, 3 * i, x) for t, pair in texts.items() for i, x in enumerate(pair[k])] for k in (0, 1)]
    frames = [spark.createDataFrame(s, "text_id string, position long, token string").repartition(3) for s in sides]
    got = {}
    for r in reconcile.align_tokens(*frames).collect():
        got.setdefault(r.text_id, []).append(tuple(r)[1:])
    for t, (a, b) in texts.items():
        want = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert sorted(got.get(t, []), key=lambda x: (x[1], x[3])) == want, t
    assert reconcile.align_tokens(*(f.where("false") for f in frames)).count() == 0


def test_null_tokens_match_nothing(spark):
    df = spark.createDataFrame([("t", 0, None), ("t", 1, "a")], "text_id string, position long, token string")
    assert sorted(tuple(r)[1:] for r in reconcile.align_tokens(df, df).collect()) == [("equal", 1, 2, 1, 2), ("replace", 0, 1, 0, 1)]


def test_closures_end_on_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("a", "d"), (None, "a"), ("a", None), ("a", "b")]
    df = spark.createDataFrame(edges, "source string, target string").repartition(2)
    roots = spark.createDataFrame([("a",), ("q",), (None,)], "node string")
    assert {(r.node, r.depth) for r in release.reachable(df, roots).collect()} == {("a", 0), ("q", 0), ("b", 1), ("d", 1), ("c", 2)}
    chain = spark.range(30).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    assert release.reachable(chain, spark.createDataFrame([("0",)], "node string")).agg(F.max("depth")).first()[0] == 30
    assert release.reachable(df, roots.where("false")).count() == 0


@pytest.mark.parametrize(
    "glob,inside,outside",
    [("src/*.py", ["src/a.py"], ["src/b/a.py", "src/a.pyc", "asrc/a.py"]), ("src/**/*.py", ["src/a.py", "src/b/c/a.py"], ["src.py"]), ("docs/**", ["docs/x", "docs/a/b"], ["docs"]), ("a?.b+", ["ab.b+"], ["a/.b+", "ab.bb"])],
)
def test_globs(spark, glob, inside, outside):
    df = spark.createDataFrame([(p, p in inside) for p in inside + outside], "path string, expected boolean")
    assert df.where(F.col("path").rlike(release.compile_globs(["# note", "", glob])) != F.col("expected")).count() == 0


def test_findings(spark):
    with pytest.raises(ValueError):
        release.compile_globs(["../x"])
    files = [("README.md", "fine"), ("src/a.py", 'api_key = "abcdefgh12"'), ("src/b.py", "-----BEGIN RSA PRIVATE KEY-----"), ("raw/c.mat", None), ("src/d.py", "x" * 50)]
    df = spark.createDataFrame(files, "path string, content string")
    got = {tuple(r) for r in release.findings(df, ["README.md", "src/**"], ["README.md", "LICENSE"], max_bytes=40).collect()}
    assert got == {
        ("src/a.py", "possible assigned secret"),
        ("src/b.py", "possible private key"),
        ("raw/c.mat", "not declared public"),
        ("src/d.py", "too large"),
        ("LICENSE", "required file is missing"),
    }
    links = spark.createDataFrame([("README.md", "src/a.py"), ("README.md", "gone.md")], "source string, target string")
    assert [tuple(r) for r in release.broken_links(links, df.select(F.col("path").alias("node"))).collect()] == [("README.md", "gone.md")]
