"""Keyword counts and word frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.functions.text import is_stop_word, normalized_keywords, word_tokens
from biblioscope.operators.articles import articles_dated
from biblioscope.operators.joins import join_dimension

WORD_CLOUD_SIZE = 200


def keyword_count_table(articles: DataFrame) -> DataFrame:
    """Number of articles carrying each normalised keyword ('' included).

    Articles are told apart by their derived row, that is with the parsed date in
    place of the raw text: two that differ only around the date count once.  A keyword
    repeated inside one article counts once (``array_distinct`` per article), the
    same keyword in two articles counts twice.  Null keyword strings produce no row.
    """
    return (articles_dated(articles)
            .where(F.col("keywords").isNotNull())
            .select("keywords", "derived_row").distinct()
            .select(F.explode(normalized_keywords(F.col("keywords"))).alias("keyword"))
            .groupBy("keyword")
            .agg(F.count(F.lit(1)).alias("keyword_count")))


def keyword_counts(articles: DataFrame) -> DataFrame:
    """``keyword_count_table`` sorted by count (desc), then keyword."""
    return keyword_count_table(articles).orderBy(F.desc("keyword_count"), "keyword")


def top_keywords(articles: DataFrame, k: int = 10) -> DataFrame:
    return keyword_counts(articles).limit(k)


def word_frequencies(texts: DataFrame, column: str, bigrams: bool = False) -> DataFrame:
    """Occurrences of each word over all texts (whole texts, no prefixes).

    With ``bigrams``, each pair of adjacent words in a text in which neither is a
    stop word also counts, as ``"first second"``.  The token array is zipped with
    itself shifted by one and exploded once, so the work stays linear in the
    text length.
    """
    tokens = texts.select(word_tokens(F.col(column)).alias("_t"))
    if not bigrams:
        return (tokens
                .select(F.explode("_t").alias("word"))
                .where(~is_stop_word(F.col("word")))
                .groupBy("word")
                .agg(F.count(F.lit(1)).alias("n")))
    t = F.col("_t")
    following = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = tokens.select(F.explode(F.arrays_zip(t.alias("w"), following.alias("nxt"))).alias("p"))
    w, nxt = F.col("p.w"), F.col("p.nxt")
    keep = ~is_stop_word(w)
    terms = F.array(F.when(keep, w),
                    F.when(keep & nxt.isNotNull() & ~is_stop_word(nxt), F.concat_ws(" ", w, nxt)))
    return (pairs
            .select(F.explode(terms).alias("word"))
            .where(F.col("word").isNotNull())
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")))


def top_words(freq: DataFrame, k: int = WORD_CLOUD_SIZE) -> DataFrame:
    """The word-cloud cut: the ``k`` most frequent words, ties by word."""
    return freq.orderBy(F.desc("n"), "word").limit(k)


def keyword_word_counts(articles: DataFrame, bigrams: bool = False) -> DataFrame:
    """Every word of the distinct keywords, each keyword weighted once."""
    distinct_keywords = articles.select(
        F.explode(normalized_keywords(F.col("keywords"))).alias("keyword")).distinct()
    return word_frequencies(distinct_keywords, "keyword", bigrams)


def category_word_counts(journals_flat: DataFrame, bigrams: bool = False) -> DataFrame:
    """Every word of every non-null category of the flattened rankings."""
    cats = journals_flat.where(F.col("category").isNotNull()).select("category")
    return word_frequencies(cats, "category", bigrams)


def keyword_words(articles: DataFrame, k: int = WORD_CLOUD_SIZE, bigrams: bool = False) -> DataFrame:
    """The word cloud of ``keyword_word_counts``."""
    return top_words(keyword_word_counts(articles, bigrams), k)


def category_words(journals_flat: DataFrame, k: int = WORD_CLOUD_SIZE, bigrams: bool = False) -> DataFrame:
    """The word cloud of ``category_word_counts``."""
    return top_words(category_word_counts(journals_flat, bigrams), k)


def document_words(documents: DataFrame, bigrams: bool = False) -> DataFrame:
    """Every word of full document texts."""
    return word_frequencies(documents.select("text"), "text", bigrams)


# A pair scoring above this is a collocation (fixed value: the usual threshold of the ratio).
COLLOCATION_SCORE = 30.0


def adjacent_pairs(texts: DataFrame, column: str) -> DataFrame:
    """Occurrences (n) of each pair of adjacent words of a text, neither a stop word."""
    t = F.col("_t")
    following = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = (texts.select(word_tokens(F.col(column)).alias("_t")).where(F.size(t) > 1)
             .select(F.explode(F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("a"), following.alias("b"))).alias("p")))
    return (pairs.select(F.col("p.a").alias("word_a"), F.col("p.b").alias("word_b"))
            .where(~is_stop_word(F.col("word_a")) & ~is_stop_word(F.col("word_b")))
            .groupBy("word_a", "word_b").agg(F.count(F.lit(1)).alias("n")))


def _entropy_term(k: F.Column, expected: F.Column) -> F.Column:
    return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)


def collocations(texts: DataFrame, column: str) -> DataFrame:
    """Every adjacent pair with its log-likelihood ratio against independent words.

    The ratio compares the pair's count with the counts of its first and second word
    over all pairs (a 2 x 2 table); ``collocation`` marks pairs that stand together more
    often than independence has it, by more than ``COLLOCATION_SCORE``.  The words' totals
    come from the counted pairs; a word that begins very many pairs is a hot key of the
    join, which ``join_dimension`` measures and salts.
    """
    pairs = adjacent_pairs(texts, column)
    firsts = pairs.groupBy("word_a").agg(F.sum("n").alias("n_a"))
    seconds = pairs.groupBy("word_b").agg(F.sum("n").alias("n_b"))
    total = pairs.select(F.sum("n")).scalar()
    both = join_dimension(join_dimension(pairs, firsts, "word_a"), seconds, "word_b").withColumn("all", total)
    n, a, b, whole = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "all"))
    score = 2 * (_entropy_term(n, a * b / whole) + _entropy_term(a - n, a * (whole - b) / whole)
                 + _entropy_term(b - n, (whole - a) * b / whole)
                 + _entropy_term(whole - a - b + n, (whole - a) * (whole - b) / whole))
    return both.select("word_a", "word_b", "n", "n_a", "n_b", F.round(score, 6).alias("score"),
                       ((n * whole > a * b) & (F.round(score, 6) > COLLOCATION_SCORE)).alias("collocation"))


def fold_plurals(freq: DataFrame) -> DataFrame:
    """Word counts with plurals added to their singular.

    A word that ends in one ``s`` counts with the word without it, where the vocabulary
    has that word.  A singular never ends in ``s`` itself, so one join of the vocabulary
    with itself settles it; every word is one row, so no key is hot.
    """
    singular = F.when(F.col("word").endswith("s") & ~F.col("word").endswith("ss") & (F.length("word") > 1),
                      F.expr("left(word, length(word) - 1)"))
    known = freq.select(F.col("word").alias("singular"), F.lit(True).alias("known"))
    return (freq.withColumn("singular", singular).join(known, "singular", "left")
            .select(F.when(F.col("known"), F.col("singular")).otherwise(F.col("word")).alias("word"), "n")
            .groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms")))


def keyword_collocations(articles: DataFrame) -> DataFrame:
    """Collocations of the distinct keywords."""
    return collocations(articles.select(F.explode(normalized_keywords(F.col("keywords"))).alias("keyword")).distinct(), "keyword")


def category_collocations(journals_flat: DataFrame) -> DataFrame:
    """Collocations of the non-null categories of the flattened rankings."""
    return collocations(journals_flat.where(F.col("category").isNotNull()).select("category"), "category")


def document_words_folded(documents: DataFrame) -> DataFrame:
    """Every word of full document texts, plurals with their singular."""
    return fold_plurals(document_words(documents))
