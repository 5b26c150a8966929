"""Top-level JSON objects of text files, read by as many tasks as the files have splits.

The original tool exports a collection as one JSON array, often on one line, which
Spark's ``multiLine`` reader hands to a single task.  Here the text reader cuts the
files at every ``}``, wherever a split begins, and each fragment's role follows from
two running sums: the quotes before it tell whether it begins inside a string, the
braces outside strings tell how deep it ends.  Both are first summed within a piece of
a split (some thousand fragments), under either assumption about where the piece begins;
the totals (one row a piece) then settle which one holds.  An object is the run of fragments up to the next
one that ends at depth 0.

No task reads more than a split or holds more than one object.  An object that is
never closed, or whatever stands in a file whose braces close more than they open, is
not put together: each of its fragments is returned on its own, as damaged.

Arrays, JSON lines and objects on several lines are all read; a comma, white space, a
byte order mark or brackets between objects are skipped, other text between two objects
stays in front of the second, which the parser then refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRACE = "}"
# JSON's escapes and strings, and what may stand between objects.
ESCAPE = r"(?s)\\."
STRING = r'"[^"]*("|\z)'
STRING_REST = r'\A[^"]*("|\z)'
BETWEEN = r"\A[\s,\[\]\x{FEFF}]*"
ONLY_BETWEEN = BETWEEN + r"\z"
# A piece of a split has at most 2 to the power of this fragments.
PIECE_BITS = 13


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each ``}`` with its file (a digest of the path), piece of a split and order, its quotes, and the braces it
    opens when it begins outside (``opens_0``) or inside (``opens_1``) a string."""
    text = spark.read.option("lineSep", BRACE).text(path).select(
        F.unhex(F.md5(F.col("_metadata.file_path"))).alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("n"), "value")
    # a split in pieces: what is grouped and sorted together stays small, however large a split is
    text = text.withColumn("split", F.struct("start", F.shiftright("n", PIECE_BITS).alias("piece"))).drop("start")
    plain = F.regexp_replace("value", ESCAPE, "")
    outside = F.regexp_replace(plain, STRING, "")
    outside_after = F.regexp_replace(F.regexp_replace(plain, STRING_REST, ""), STRING, "")
    return text.select("*", (_count(plain, '"') % 2).alias("flips"),
                       _count(outside, "{").alias("opens_0"), _count(outside_after, "{").alias("opens_1"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(record, whole): the text of each object; a damaged fragment is not ``whole``."""
    of_split = ["file", "split"]
    upto = Window.partitionBy(*of_split).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file")

    # begins and ends inside a string (1) or outside (0), if the split begins outside
    rows = _fragments(spark, path)
    rows = rows.withColumn("begins", F.pmod(F.sum("flips").over(upto) - F.col("flips"), F.lit(2)))
    rows = rows.withColumn("ends", F.pmod(F.col("begins") + F.col("flips"), F.lit(2)))
    first = F.col("begins") == 0
    rows = rows.withColumns({
        "step_0": F.when(first, F.col("opens_0")).otherwise(F.col("opens_1")) - (1 - F.col("ends")),
        "step_1": F.when(first, F.col("opens_1")).otherwise(F.col("opens_0")) - F.col("ends")})
    rows = rows.withColumns({"depth_0": F.sum("step_0").over(upto), "depth_1": F.sum("step_1").over(upto)})

    splits = rows.groupBy(*of_split).agg(
        F.sum("flips").alias("flips"), F.sum("step_0").alias("total_0"), F.sum("step_1").alias("total_1"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("n").alias("last"))
    splits = splits.withColumn("inside", F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)))
    splits = splits.withColumn("total", F.when(F.col("inside") == 0, F.col("total_0")).otherwise(F.col("total_1")))
    splits = splits.select(
        *of_split, "inside", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("above"),
        F.sum("bytes").over(whole_file).alias("read"),
        F.when(F.col("split") == F.max("split").over(whole_file), F.col("last")).alias("final"))

    at = rows.select(*of_split, "n", "value", "size", "ends", "depth_0", "depth_1").join(splits, of_split)
    # the text after a file's last brace is not closed by one
    unclosed = (F.col("n") == F.coalesce("final", F.lit(-1))) & (
        (F.col("read") == F.col("size") + 1) | F.col("value").rlike(ONLY_BETWEEN))
    depth = F.col("above") + F.when(F.col("inside") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    outside = F.pmod(F.col("inside") + F.col("ends"), F.lit(2)) == 0
    at = at.select(*of_split, "n", "value",
                   (outside & ~unclosed & (depth == 0)).cast("long").alias("closes"),
                   (outside & ~unclosed & (depth < 0)).cast("long").alias("broken"))
    at = at.withColumn("closed_before", F.sum("closes").over(upto) - F.col("closes"))
    closed = at.groupBy(*of_split).agg(F.sum("closes").alias("closes"), F.max("broken").alias("broken"))
    closed = closed.select(*of_split, F.coalesce(F.sum("closes").over(before), F.lit(0)).alias("objects_before"),
                           F.sum("closes").over(whole_file).alias("objects"),
                           F.max("broken").over(whole_file).alias("file_broken"))
    numbered = at.join(closed, of_split).withColumn("object", F.col("objects_before") + F.col("closed_before"))
    sound = (F.col("object") < F.col("objects")) & (F.col("file_broken") == 0)

    pieces = F.array_sort(F.collect_list(F.struct("split", "n", "value")))
    joined = F.concat(F.array_join(F.transform(pieces, lambda p: p["value"]), BRACE), F.lit(BRACE))
    whole = (numbered.where(sound).groupBy("file", "object")
             .agg(F.regexp_replace(joined, BETWEEN, "").alias("record")))
    rest = numbered.where(~sound & ~F.col("value").rlike(ONLY_BETWEEN))
    return (whole.select("record", F.lit(True).alias("whole"))
            .unionByName(rest.select(F.col("value").alias("record"), F.lit(False).alias("whole"))))
