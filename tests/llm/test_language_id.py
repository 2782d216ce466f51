from pyspark.sql import functions as F

from medialake.llm.language_id import Detector, GramFilter, fit, identify, op8_language_id, word_grams


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op8_language_id(spark, sf).where("held_out").join(docs, "doc_id")
    n, right = held.count(), held.where("lang = lang_pred").count()
    assert n > 100 and right / n > 0.97
    assert held.where("score < 0 or score > 1").count() == 0


def test_edge_rows(edge_docs, no_docs):
    filt = fit(edge_docs, F.lit(True), min_share=0.0)
    got = {r.doc_id: r for r in identify(edge_docs, filt).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[9].lang_pred == "und" and got[9].score == 0
    assert got[6].lang_pred == "en"
    assert identify(no_docs, filt).count() == 0
    assert {r.lang_pred for r in identify(edge_docs, fit(no_docs, F.lit(True))).collect()} == {"und"}


def test_masks_hold_every_language_of_a_gram():
    langs = [f"l{i:02d}" for i in range(70)]
    filt = GramFilter(langs, {lang: ["abc", f"x{lang}"] for lang in langs})
    assert filt.members(["abc"]).sum() == 70
    assert filt.members([f"x{lang}" for lang in langs]).trace() == 70


def test_text_with_letters_gets_a_learned_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filt = fit(docs, F.lit(True))
    rows = [(1, "Съешь ещё этих мягких булок"), (2, "日本語の文"), (3, "zqxj"), (4, "² ½ 12"), (5, "_ 7 !"), (5, "_ 7 !"), (6, "Ⅷ"), (7, "x²")]
    got = [(r.doc_id, r.lang_pred) for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), filt).collect()]
    assert {i for i, lang in got if lang == "und"} == {4, 5, 6} and len(got) == 8
    assert {lang for i, lang in got if i in (1, 2, 3, 7)} <= set(filt.langs)


def test_counts_equal_a_plain_version():
    """Popcounts by sets of n-grams, with the filter's false positives counted in, corrected and compared."""
    grams = {"a": ["_th", "the", "he_"], "b": ["_de", "der", "er_", "the"], "c": ["xyz"]}
    filt = GramFilter(["a", "b", "c"], grams, slots=64, hashes=2)
    slots = {lang: {int(at) for g in own for places in filt.places([g]) for at in places} for lang, own in grams.items()}
    false = {lang: (len(on) / 64) ** 2 for lang, on in slots.items()}
    for text in ("the der", "the the die", "xyz the", "q", "Weltanschauung der Welt"):
        seen = [g for w in text.lower().split() for g in word_grams(w)]
        true = {}
        for lang, on in slots.items():
            hits = sum(all(int(p[0]) in on for p in filt.places([g])) for g in seen)
            true[lang] = max(0.0, (hits - len(seen) * false[lang]) / (1 - false[lang]))
        langs, scores = Detector(filt).detect([text])
        best = max(sorted(true), key=true.get)
        assert langs == [best]
        assert abs(scores[0] - (true[best] / sum(true.values()) if true[best] else 0.0)) < 1e-9
