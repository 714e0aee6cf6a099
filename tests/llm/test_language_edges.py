"""Language prediction on repeated rows, very long texts, ties and columns of clashing names."""

from __future__ import annotations

from trisettle.llm import language


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    words = {"en": "the house and the water with this", "fr": "la maison et leau avec cette rue"}
    rows = [(i, words[k], k) for i in range(60) for k in words]
    docs = spark.createDataFrame([(n, t, k) for n, (_, t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fold_model(docs)
    long = " ".join([words["fr"]] * 40_000)
    odd = [(1, words["en"]), (1, words["en"]), (1, words["fr"]), (None, words["en"]), (2, long), (3, None), (4, ""), (5, "12 34 !"), (6, "\U0001f600"), (7, "e")]
    frame = spark.createDataFrame([(i, t, 9, "m", "l", 0.5) for i, t in odd], "doc_id long, text string, _answer int, mixture string, lang_pred string, score double")
    found = language.predict(frame, model, "doc_id", "text").collect()
    assert len(found) == len(odd)
    by_text = {r.text: {(x.lang_pred, x.score) for x in found if x.text == r.text} for r in found}
    assert all(len(v) == 1 for v in by_text.values())
    answer = {t: next(iter(v)) for t, v in by_text.items()}
    assert answer[words["en"]][0] == "en" and answer[words["fr"]][0] == answer[long][0] == "fr" and answer[long][1] > 0.99
    assert all(answer[t] == ("und", 0.0) for t in (None, "", "12 34 !", "\U0001f600")) and answer["e"][0] in words
