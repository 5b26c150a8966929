from biblioscope.operators.keywords import (category_word_counts, category_words, document_words, keyword_counts,
                                            keyword_word_counts, keyword_words, top_keywords, word_frequencies)
from helpers import articles_df, as_set, flat_df


def test_keyword_normalisation(spark):
    rows = [{"doi": "1", "keywords": "AI, ML,ai"},
            {"doi": "2", "keywords": "x, Y,,y"},
            {"doi": "3", "keywords": ""},
            {"doi": "4", "keywords": None},
            {"doi": "5", "keywords": "ai"}]
    got = dict(as_set(keyword_counts(articles_df(spark, rows))))
    assert got == {"ai": 2, "ml": 1, "x": 1, "y": 1, "": 2}


def test_top_keywords_ties_by_name(spark):
    rows = [{"doi": str(i), "keywords": kw} for i, kw in enumerate(["b", "a", "c", "c"])]
    got = [tuple(r) for r in top_keywords(articles_df(spark, rows), 2).collect()]
    assert got == [("c", 2), ("a", 1)]


def test_keyword_words_weight_each_keyword_once(spark):
    rows = [{"doi": "1", "keywords": "deep learning, learning"},
            {"doi": "2", "keywords": "deep learning"}]
    got = dict(as_set(keyword_words(articles_df(spark, rows))))
    assert got == {"deep": 1, "learning": 2}


def test_word_counts_are_not_cut(spark):
    words = [f"w{i}" for i in range(300)] + ["r", "5"]
    articles = articles_df(spark, [{"doi": "1", "keywords": ",".join(words)}])
    assert dict(as_set(keyword_word_counts(articles))) == dict.fromkeys(words, 1)
    assert keyword_words(articles).count() == 200
    flat = flat_df(spark, [("j", "i", "FR", w, 2020, "Q1") for w in words])
    assert dict(as_set(category_word_counts(flat))) == dict.fromkeys(words, 1)
    assert category_words(flat).count() == 200
    texts = spark.createDataFrame([(" ".join(words),)], "text string")
    assert dict(as_set(document_words(texts))) == dict.fromkeys(words, 1)


def test_word_frequencies_whole_text_and_stop_words(spark):
    text = "The cat and the hat. " * 1000 + "l'été d'or"
    df = spark.createDataFrame([(text,)], "text string")
    got = dict(as_set(word_frequencies(df, "text")))
    assert got["cat"] == 1000 and got["hat"] == 1000
    assert "the" not in got and "and" not in got
    assert got["l'été"] == 1 and got["d'or"] == 1


def test_category_words(spark):
    flat = flat_df(spark, [("j", "i", "FR", "Applied Mathematics", 2020, "Q1"),
                           ("j", "i", "FR", "Pure Mathematics", 2020, "Q1"),
                           ("j", "i", "FR", None, 2020, "Q1")])
    got = dict(as_set(category_words(flat)))
    assert got == {"applied": 1, "pure": 1, "mathematics": 2}
