"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np

from quarrymill.llm import toxic_crf


def test_few_toxic_rows_have_evidence(spark):
    rng = np.random.default_rng(0)
    text = lambda: " ".join(f"word{i}" for i in rng.integers(0, 40, 30))
    rows = [(i, text() + " swearword" * (i % 9 == 0) * 3, int(i % 9 == 0)) for i in range(54)]  # six are toxic
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxic_crf.fit(df, df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(1, text() + " swearword" * 3), (2, text())], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxic_crf.tag_toxicity(new, model).collect()}
    assert len(model.lexicon.hashes) and score[1] >= 0.5 > score[2]


def test_evidence_counts_every_labelled_row(spark, monkeypatch):
    long = "plain " * 12_000  # over max_bytes: not in the sample of the weights, but evidence all the same
    rows = [(i, (long + "swearword" if i % 2 else long) + f" only{i}", i % 2) for i in range(12)] + [(20, "swearword plain", 1), (21, "plain", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    want = np.log(7.5 / 8) - np.log(0.5 / 8)  # in all seven toxic rows and none of the seven others
    assert np.isclose(toxic_crf.fit(df, df.select("doc_id", "toxic")).lexicon.evidence.max(), want)
    monkeypatch.setattr(toxic_crf, "LABEL_BLOCK", 3)
    assert np.isclose(toxic_crf.fit(df, df.select("doc_id", "toxic")).lexicon.evidence.max(), want)


def test_weights_see_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxic_crf, "fit_weights", lambda learn, **k: seen.extend(learn) or toxic_crf.START_WEIGHTS)
    rows = [(i, "plain " * 700 + "swearword" * (i % 2), i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxic_crf.fit(df, df.select("doc_id", "toxic"))
    assert sum(len(e) for e, _ in seen) == sum(len(t.split()) for _, t, _ in rows)
