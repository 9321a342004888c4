import unicodedata

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import language as L
from tallyloom.llm.common import table

from .fixtures import documents, nothing, rows


def test_best_labels_against_word_by_word():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(1, 300, rng.integers(1, 5))
        text = np.repeat(np.arange(len(counts)), counts)
        score = -rng.exponential(3, (len(text), 3))
        label = L.best_labels(score, text, 4.0)
        for t in range(len(counts)):
            s, chosen = score[text == t], label[text == t]
            best = s[0].copy()
            for word in s[1:]:
                best = np.maximum(best, best.max() - 4) + word
            value = s[np.arange(len(s)), chosen].sum() - 4 * (np.diff(chosen.astype(int)) != 0).sum()
            assert abs(value - best.max()) < 1e-9


def test_spans_scripts_and_texts_without_letters():
    model = L.learn([("en", b"the thing and that was of the king " * 30), ("de", "der die und ist nicht schön ".encode() * 30),
                     ("ru", "это просто русский текст ".encode() * 30)])
    text = "Thing and that was the king. Ist nicht und die schön. Русский текст это!"
    lang, score, spans = L.label_texts(model, [text.encode()])[0]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"] and 0 < score < 1
    assert text[spans[1]["start"] : spans[1]["end"]] == "Ist nicht und die schön"
    assert text[spans[2]["start"] : spans[2]["end"]] == "Русский текст это"
    # A script that only one language is written in leaves no other candidate.
    assert L.label_texts(model, ["щщщ".encode()])[0][0] == "ru"
    for empty in (b"", b" \n", b"123 !? 45", "— … 😀".encode()):
        assert L.label_texts(model, [empty]) == [("und", 0.0, [])]
    assert L.label_texts(model, []) == []
    assert L.label_texts(None, [b"words"]) == [("und", 0.0, [])]


def test_every_letter_is_one_and_nothing_else():
    model = L.learn([("en", b"the thing and that was of the king " * 30)])
    letters = ["ⵜⵉⴼⵉ", "ⲁⲃⲅ", "ｗｏｒｄ", "\ufb50\ufe8d", "\ufb2a", "𐌰𐌱𐌲", "𝐀𝐁", "ªº", "ʰ", "हिन्दी", "e\u0301", "\u0301a", "ꦲ", "〆", "\U00030000"]
    nothing_to_read = ["٠١٢", "๐๑", "\u0301", "\u0301 \u093f", "˘˙", "①②", "⅔ ½", "€ § 12", "\u200d", "😀", "ⅳ"]
    for text in letters:
        assert any(unicodedata.category(c)[0] == "L" for c in text)
        assert L.label_texts(model, [text.encode()])[0][:2] == ("en", 1.0), text
    for text in nothing_to_read:
        assert not any(unicodedata.category(c)[0] == "L" for c in text)
        assert L.label_texts(model, [text.encode()]) == [("und", 0.0, [])], text
    assert L.label_texts(model, ["हिन्दी भाषा".encode()])[0][2] == [{"start": 0, "end": 11, "lang": "en"}]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter(~L.trainable())
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and row[1] > 1500 and 0 <= row[2] and row[3] <= 1


def test_awkward_rows(spark):
    found = L.identify(documents(spark)).collect()
    assert len(found) == len(rows())
    by_id = {r["doc_id"]: r for r in found}
    for i in (200, 201, 202, 203):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[204]["lang_pred"] == "en"
    assert L.identify(nothing(spark)).collect() == []
