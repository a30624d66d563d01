"""The language stage judges every document by the same steps, whether or not anything is labelled."""

import corpus_pipeline
from clicksieve.llm import language_id


def test_unlabelled_documents_are_identified_as_well(spark, monkeypatch):
    """The character is a letter to the operator's texts (Unicode 15.1) and was none to the regular expression in its place."""
    judged = []
    identify, least_scores = language_id.identify, language_id.least_scores
    monkeypatch.setattr(language_id, "identify", lambda *a, **k: judged.append("identify") or identify(*a, **k))
    monkeypatch.setattr(language_id, "least_scores", lambda *a, **k: judged.append("least_scores") or least_scores(*a, **k))
    texts = ["plain words", "\U0002ebf0", "12 34 -- !!", "", None]
    rows = [(i, text, None, "s", 0) for i, text in enumerate(texts)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.known_language(spark, docs, "")
    assert left.columns == docs.columns
    assert {r.text for r in left.collect()} == {"plain words", "\U0002ebf0", "no id"}
    assert sorted(judged) == ["identify", "least_scores"]
