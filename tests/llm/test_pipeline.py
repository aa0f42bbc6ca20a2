"""The pipeline, stage by stage and as a whole, against brute force on each stage's input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from .conftest import prose
from .test_operators import brute_components, brute_lines, brute_spans, changed, clashing


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    """A folder with documents and labels: junk, a common line, near copies, secrets, null and empty texts."""
    texts = []
    for i in range(160):
        text = prose(i, 60)
        if i % 5 == 0:
            text = re.sub(r"(\w+)", r"\1***", text)
        elif i % 5 == 1:
            text = "Common LINE of many\n" + text
        elif i % 5 == 2 and i > 20:
            text = changed(prose(2, 120).replace("\n", ""), i, 0.012)  # one line: the line stage leaves it alone
        elif i % 5 == 3:
            text += f" token = \"{'%040x' % (i * 7**40 % 16**40)}\" end"
        texts.append(text)
    folder = str(tmp_path_factory.mktemp("tables"))
    make_docs(texts + [None, ""], sources=[f"src{i % 7}" for i in range(162)]).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int((i - 1) % 5 > 0), 0) for i in range(1, 140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = rows(docs)
        out = stage(spark, docs, corpus)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    junk = {i for i, t in inputs["quality"] if "***" in (t or "")}
    kept = {i for i, _ in inputs["line_dedup"]}
    assert len(junk & kept) <= 2 and len(set(i for i, t in inputs["quality"] if t) - junk - kept) <= 2
    assert dict(inputs["line_dedup"]).items() <= dict(inputs["quality"]).items()

    lines = {i: (n, dropped) for i, n, dropped, _ in brute_lines(inputs["line_dedup"], 10)}
    after = dict(inputs["ngram_join"])
    for i, text in inputs["line_dedup"]:
        assert len((after[i] or "").split("\n")) == max(1, lines[i][0] - lines[i][1])
    assert not any("common line" in (t or "").lower() for t in after.values())

    component = {i: c for i, _, c in brute_components(inputs["ngram_join"])}
    assert [i for i, _ in inputs["secrets"]] == [i for i, _ in inputs["ngram_join"] if component[i] == i]
    assert len(inputs["secrets"]) < len(inputs["ngram_join"])

    masked = dict(inputs["packing"])
    for i, text in inputs["secrets"]:
        if brute_spans(text or "")[0]:
            assert "[SECRET]" in masked[i] and not brute_spans(masked[i])[0]
        else:
            assert masked[i] == text

    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.piece_len
    assert packed == Counter({i: len((t or "").encode()) for i, t in inputs["packing"]})


def test_run_is_the_stages_in_turn(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).collect()
    kept = {r.doc_id for r in out}
    texts = dict(rows(spark.read.parquet(f"{corpus}/documents.parquet")))
    assert sum("***" in (texts[i] or "") for i in kept) <= 2
    component = {i: c for i, _, c in brute_components([(i, t) for i, t in texts.items() if i % 5 == 3 and i > 21])}
    assert len({component[i] for i in kept if i in component}) == len([i for i in kept if i in component])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_odd_rows(spark, corpus, odd_docs, no_docs):
    """Nulls, repeated rows and ids, empty and very long texts, columns under the names of helpers, empty tables."""
    docs, before = clashing(odd_docs), [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = {name: f(spark, docs, corpus) for name, f in corpus_pipeline.STAGES}
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, clashing(no_docs), corpus).count() == 0, name
        assert name == "packing" or out[name].columns == docs.columns and out[name].dtypes == docs.dtypes, name
    rows_of = {name: Counter((r.doc_id, r.text) for r in out[name].collect()) for name in ("quality", "line_dedup", "ngram_join", "secrets")}
    assert rows_of["quality"] <= Counter(before)
    assert sum(rows_of["line_dedup"].values()) == sum(rows_of["secrets"].values()) == len(before)
    component = {i: c for i, _, c in brute_components(before)}
    assert rows_of["ngram_join"] == Counter((i, t) for i, t in before if i is None or component[i] == i)
    assert rows_of["secrets"][None, "[SECRET] café\nkey"] == 1 and rows_of["secrets"][4, None] == 1
    for r in out["line_dedup"].collect() + out["secrets"].collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
    lengths = Counter()
    for r in out["packing"].collect():
        lengths[r.doc_id] += r.piece_len
    assert sum(lengths.values()) == sum(len((t or "").encode()) for _, t in before)
    kept = out["quality"].where("doc_id = 8").collect()
    assert len(kept) in (0, 2)  # two equal rows have one score


def test_documents_that_lose_all_lines_stay(spark, corpus, make_docs):
    docs = make_docs(["Same line"] * 12 + ["same LINE \nother"])
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("line_dedup")(spark, docs, corpus).collect()}
    assert got == {i: ("", 0) for i in range(1, 13)} | {13: ("other", 5)}
