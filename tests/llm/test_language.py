import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from bindery.llm import crf_language as crf

ROOT = "/root/testdata/sf0.001/documents.parquet"
EN, DE = "the thing and hester inatat that of from".split(), "und der einach schgeber auf keit ung zuver".split()


@pytest.fixture(scope="module")
def field():
    return crf.fit({"en": EN * 60, "de": DE * 60})


def one_pass(e, a):
    """Forward-backward over one text, step by step."""
    n, k = e.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = e[0] / e[0].sum()
    for t in range(1, n):
        f[t] = f[t - 1] @ a * e[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return f * b / (f * b).sum(1, keepdims=True)


def test_segments_do_not_change_the_recursion():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 63, 64, 65, 128, 300, 5])
    e, a = rng.random((lengths.sum(), 3)) + 1e-3, rng.random((3, 3)) + 1e-3
    got = np.split(crf.marginals(e, a, lengths), np.cumsum(lengths)[:-1])
    for part, emitted in zip(got, np.split(e, np.cumsum(lengths)[:-1])):
        assert np.allclose(part, one_pass(emitted, a))


def test_code_switched_words(field):
    words = EN + DE + EN
    (p,) = crf.Tagger(field).tag([words])
    assert [field.langs[i] for i in p.argmax(1)] == ["en"] * 8 + ["de"] * 8 + ["en"] * 8
    assert field.transitions[0, 0] > field.transitions[0, 1]


def test_words_without_letters_and_portions(field):
    tagger = crf.Tagger(field)
    assert [len(p) for p in tagger.tag([[], ["²"], ["the", "½", "und"]])] == [0, 0, 2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(ROOT.replace("0.001", "0.01"))
    got = crf.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_inputs_of_a_prediction(spark):
    """Only the text counts: other ids, languages and sources of held-out rows change nothing."""
    docs = spark.read.parquet(ROOT)
    changed = docs.withColumn("lang", F.when(crf.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    one = {r.doc_id: r.lang_pred for r in crf.digest(docs).collect()}
    assert {r.doc_id: r.lang_pred for r in crf.digest(changed).collect()} == one


def test_awkward_rows(spark):
    rows = [(i, " ".join((EN if i % 2 else DE) * 3)) for i in range(40)]
    odd = [(100, None), (101, ""), (102, "12 ²½ --"), (None, " ".join(DE)), (103, " ".join(EN * 3000)), (1, rows[1][1])]
    docs = documents(spark, rows + odd).withColumn(
        "lang", F.when(F.col("doc_id") < 40, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    )
    out = crf.identify(docs, with_runs=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "de", "en"]
    assert got[100][0].score == 0 and not got[None][0].held_out
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert [tuple(x) for x in got[103][0].lang_runs] == [(0, 24000, "en")]
    kept = crf.with_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 3


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "words"), (2, None)], lang=None)
    assert {r.lang_pred for r in crf.digest(docs).collect()} == {"und"}
    assert crf.digest(docs.limit(0)).collect() == []
