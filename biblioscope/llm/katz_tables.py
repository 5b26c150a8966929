"""Katz backoff of any order from stored tables, evaluated recursively per token.

``build`` writes the model below a folder, every table partitioned by ``bucket``:

* ``vocabulary``: id (t1), word, c, p of every training token, the end token included;
* ``grams_k``, k = 2..order: ids t1..tk, c and the discounted share p;
* ``backoff_k``: history t1..t(k-1) and its weight;
* ``numbers``: one row of order, sizes, the unknown word's probability and the texts' rule.

With h' the history h without its first token, a level's probability is

    p(v|h) = d_k(c) c(h,v) / (c(h) + 1)     if c(h,v) >= least
           = a(h) p(v|h')                    else (a = 1 for a history not in training)

and a(h) makes each seen history's probabilities sum to exactly one.  An n-gram that is
kept has its shorter one kept too, so p(v|h') of the kept ones is one equi-join with the
level below.  Discounts are those of ``katz``, one set a level; level 1 and, with order 2,
the whole model are the ones that ``katz.score`` evaluates.

``score`` looks a token's full history up first; tokens that were found are summed, the
others take their history's weight and go on one level down.  Joins salt hot keys
(frequent words and histories) and each level's outcome is a written table, so a lost
executor repeats one level at most.

A token's id is the 64-bit hash of its word.  Words hold no white space, so the start and
end tokens are the hashes of a line break and a tab.

Defined results: as in ``katz`` (a null text is an empty one, a null id trains, repeated
rows count as often as they stand and are scored each, an empty table gives an empty
result); other columns are not carried; a text is split within one row, whatever its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioscope.llm.katz import FOLDS, HELD_OUT, LARGEST, SCORES, discounts
from biblioscope.llm.tables import parts, scratch_path, written
from biblioscope.operators.joins import hot_salted_join

START, END = "\n", "\t"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _names(order: int) -> list[str]:
    return [f"t{i}" for i in range(1, order + 1)]


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _grams(docs: DataFrame, order: int, *keep: str) -> DataFrame:
    """One row a token: ``keep``, the ids of its history and itself (t1..t<order>), its word."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(*keep, F.concat(F.array(*[F.lit(START)] * (order - 1)), words, F.array(F.lit(END))).alias("w"))
    shifted = [F.slice("w", i, F.size("w") - (order - 1)).alias(t) for i, t in enumerate(_names(order), 1)]
    each = rows.select(*keep, F.explode(F.arrays_zip(*shifted)).alias("g"))
    return each.select(*keep, *[F.xxhash64(f"g.{t}").alias(t) for t in _names(order)], F.col(f"g.t{order}").alias("word"))


def _renamed(df: DataFrame, drop: int, order: int) -> DataFrame:
    """t(drop+1).. become t1..: the keys of a shorter n-gram."""
    kept = [F.col(f"t{i}").alias(f"t{i - drop}") for i in range(drop + 1, order + 1)]
    return df.select(*kept, *[c for c in df.columns if c not in _names(order)])


def _discounts(counts: DataFrame) -> list[float]:
    seen = dict(counts.where(F.col("c") <= LARGEST + 1).groupBy("c").count().collect())      # at most LARGEST + 1 rows
    return discounts([seen.get(r, 0) for r in range(1, LARGEST + 2)]).tolist()


def _discounted(d: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in d]), F.least("c", F.lit(LARGEST + 1)).cast("int") + 1) * F.col("c")


def _store(table: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``table`` written by buckets of its whole key, so that no history fills one; read back."""
    spark, n = table.sparkSession, parts(table.sparkSession)
    (table.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).repartition(n, "bucket")
     .write.option("compression", "zstd").partitionBy("bucket").parquet(path))
    return spark.read.schema(table.schema).parquet(path).drop("bucket")


def read_table(spark: SparkSession, path: str, name: str, order: int = 1) -> DataFrame:
    """A stored table; its schema is stated, so that one without rows can be read."""
    kept = {"vocabulary": ["word string", "c long", "p double"], "grams": ["c long", "p double"], "backoff": ["weight double"]}[name]
    ids = _names(order - 1 if name == "backoff" else order)
    folder = name if name == "vocabulary" else f"{name}_{order}"
    return spark.read.schema(", ".join([*[f"{t} long" for t in ids], *kept])).parquet(f"{path}/{folder}").drop("bucket")


def build(docs: DataFrame, path: str, order: int = 2, least: int = 1) -> str:
    """Train on the folds that are not held out; n-grams of two words or more seen fewer than ``least`` times back off."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    top = _grams(docs.where(~_held_out()), order).groupBy(*_names(order), "word").agg(F.count(F.lit(1)).alias("c"))
    top = written(top, "grams")
    uni = written(_renamed(top, order - 1, order).groupBy("t1").agg(F.max("word").alias("word"), F.sum("c").alias("c")), "words")
    tokens, types = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    d = _discounts(uni)
    few = dict(uni.where(F.col("c") <= LARGEST).groupBy("c").count().collect())
    left = math.fsum(n * c * (1 - d[c]) for c, n in few.items())
    size = tokens if left > 0 else tokens + 1       # without a usable discount one pseudo token is unknown
    unknown = (left if left > 0 else 1.0) / max(size, 1)
    below = _store(uni.withColumn("p", _discounted(d) / max(size, 1)), f"{path}/vocabulary", ["t1"]).drop("word")
    spark.createDataFrame([(order, tokens, types, unknown)], "order int, tokens long, types long, unknown double") \
        .coalesce(1).write.parquet(f"{path}/numbers")
    for k in range(2, order + 1):
        names, n = _names(k), parts(spark)
        history, word = names[:-1], names[1:]
        counts = written(_renamed(top.drop("word"), order - k, order).groupBy(*names).agg(F.sum("c").alias("c")), f"counts_{k}")
        d = _discounts(counts)
        seen = counts.groupBy(*history).agg(F.sum("c").alias("h"))
        kept = hot_salted_join(counts.where(F.col("c") >= least), seen, history, "inner", n)
        grams = _store(kept.select(*names, "c", (_discounted(d) / (F.col("h") + 1)).alias("p")), f"{path}/grams_{k}", names)
        lower = below.select(*[F.col(a).alias(b) for a, b in zip(_names(k - 1), word, strict=True)], F.col("p").alias("q"))
        both = hot_salted_join(grams, lower, word, "inner", n)
        sums = both.groupBy(*history).agg(F.sum("p").alias("mass"), F.sum("q").alias("covered"))
        weight = (1 - F.col("mass")) / F.greatest(1 - F.col("covered"), F.lit(1e-300))
        _store(sums.select(*history, weight.alias("weight")), f"{path}/backoff_{k}", history)
        below = grams
    return path


def score(docs: DataFrame, path: str) -> DataFrame:
    """Every text under the stored model: the columns of ``katz.score``."""
    spark: SparkSession = docs.sparkSession
    n = parts(spark)
    order, tokens, types, unknown = spark.read.parquet(f"{path}/numbers").first()
    # numbered once: a row is known by its number, whatever its id
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "rows")
    vocabulary = read_table(spark, path, "vocabulary").select(F.col("t1").alias(f"t{order}"), "c", F.col("p").alias("q"))
    pending = written(_grams(rows, order, "row").drop("word"), "tokens")
    names, sums = _names(order), []
    words = written(pending.groupBy("row", names[-1]).agg(F.count(F.lit(1)).alias("times")), "words")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 1) / (tokens + types + 1))
    about = (hot_salted_join(words, vocabulary, names[-1:], "left", n).groupBy("row")
             .agg(F.sum("times").alias("n_tokens"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
                  F.sum(F.col("times") * base).alias("base_score")))
    pending = pending.withColumn("passed", F.lit(0.0))
    for k in range(order, 1, -1):
        keys = names[order - k:]

        def stored(name: str) -> DataFrame:
            table = read_table(spark, path, name, k)
            return table.select(*[F.col(a).alias(b) for a, b in zip(_names(k), keys, strict=True) if a in table.columns], table.columns[-1])

        looked = written(hot_salted_join(pending, stored("grams"), keys, "left", n), f"level_{k}")
        sums.append(looked.where("p is not null").groupBy("row").agg(F.sum(F.log10("p") + F.col("passed")).alias("s")))
        missed = hot_salted_join(looked.where("p is null").drop("p"), stored("backoff"), keys[:-1], "left", n)
        pending = written(missed.select("row", *keys[1:], (F.col("passed") + F.coalesce(F.log10("weight"), F.lit(0.0))).alias("passed")),
                          f"passed_{k}")
    last = hot_salted_join(pending, vocabulary.drop("c"), names[-1:], "left", n)
    sums.append(last.groupBy("row").agg(F.sum(F.log10(F.coalesce("q", F.lit(unknown))) + F.col("passed")).alias("s")))
    for more in sums[:-1]:
        sums[-1] = sums[-1].unionByName(more)
    total = sums[-1].groupBy("row").agg(F.sum("s").alias("score"))
    return (rows.select("row", "doc_id").join(about, "row").join(total, "row")
            .withColumn("held_out", _held_out()).withColumn("train_tokens", F.lit(tokens).cast("long"))
            .select(*[c.split()[0] for c in SCORES.split(", ")]))


def score_anew(docs: DataFrame, order: int = 2, least: int = 1) -> DataFrame:
    """``build`` into the shared folder, then ``score`` the same documents."""
    return score(docs, build(docs, scratch_path(docs.sparkSession, "katz"), order, least))
