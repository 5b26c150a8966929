"""Line dedup by winnowing, in DataFrame functions only.

*Fingerprints.*  A text is the sequence of its lines' hashes (trimmed; blank lines take
no part and stay).  Of every ``n`` consecutive lines the smallest hash is selected (the
last of equal ones).  A line selected by several windows is one fingerprint, kept with
the lines that these windows span.  Two texts that share a run of ``n`` lines select the
same line of it, so equal fingerprints meet in every such run.  A single line of more
than ``long_words`` words is a fingerprint of its own that needs no neighbours, so a long
passage that stands as one line is found as well; shorter lines have the guarantee of
``n`` lines.

*Positions.*  Fingerprints that stand at one position only are done.  The others are
extended both ways over the lines kept with them: each stretch of ``n`` lines that
selected the fingerprint is joined to the first position of the same stretch (smallest
id, or earliest in the text), found by a map-side minimum, so no pairs of positions are
formed.

*Runs.*  Stretches that have an earlier position and overlap or touch are extended into
one run, whose lines are deleted.  Where a stretch overlaps its own first occurrence, as
in a line that stands three times in a row, the lines of that occurrence stay.

Defined results: a null text stays null; an empty text, one without repeated runs, or an
empty table is returned as it is; rows equal in id and text are one document and get the
same result; null ids come first; a text of any length is one row of its line hashes,
some 8 bytes a line; all other columns are kept, whatever their names, and ``n_chars``,
where there is one, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.llm.tables import word_count, written

GUARANTEE = 2
LONG_WORDS = 50             # a line of more words is a run of its own
NEWLINE = "\n"


def _lines(text: Column) -> Column:
    return F.split(text, NEWLINE, -1)


def _solid(text: Column) -> Column:
    return F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")


def fingerprints(docs: DataFrame, n: int = GUARANTEE) -> DataFrame:
    """(id, key, size, fp, start, span): the lines selected by the windows of ``n`` lines.

    ``key`` tells texts of one id apart; ``span`` holds the line hashes, from line ``start``
    on, of the windows that selected the fingerprint; line numbers leave out blank lines.
    """
    texts = docs.select("id", "key", F.transform(_solid(F.col("text")), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= n)

    def select(first: Column) -> Column:
        window = F.slice("h", first + 1, n)
        return (first + n - F.array_position(F.reverse(window), F.array_min(window))).cast("int")

    chosen = texts.withColumn("chosen", F.transform(F.sequence(F.lit(0), F.size("h") - n), select))
    at = chosen.select("id", "key", "h", "chosen", F.explode(F.array_distinct("chosen")).alias("at"))
    # only the n windows around a line can select it, and those that do are consecutive
    low = F.greatest(F.col("at") - (n - 1), F.lit(0))
    near = F.slice("chosen", low + 1, n)
    start = (low + F.array_position(near, F.col("at")) - 1).cast("int")
    windows = F.size(F.filter(near, lambda x: x == F.col("at")))
    return at.select("id", "key", F.lit(n).alias("size"), F.get("h", F.col("at")).alias("fp"), start.alias("start"),
                     F.slice("h", start + 1, windows + (n - 1)).alias("span"))


def long_lines(docs: DataFrame, long_words: int) -> DataFrame:
    """Each line of more than ``long_words`` words, in the columns of ``fingerprints``."""
    line = docs.select("id", "key", F.posexplode(_solid(F.col("text"))).alias("start", "line"))
    # no line of fewer characters holds that many words; the length is cheaper to see
    line = line.where(F.when(F.length("line") > 2 * long_words, word_count(F.col("line"))).otherwise(0) > long_words)
    own = F.xxhash64("line")
    return line.select("id", "key", F.lit(1).alias("size"), own.alias("fp"), "start", F.array(own).alias("span"))


def joined_positions(prints: DataFrame) -> DataFrame:
    """(id, key, at, size, first): stretches of ``size`` lines and the earlier position (id, key, at) they are joined to."""
    shared = (prints.groupBy("fp").agg(F.min(F.struct("id", "key", "start")).alias("a"), F.max(F.struct("id", "key", "start")).alias("b"))
              .where(~F.col("a").eqNullSafe(F.col("b"))).select("fp"))
    near = prints.join(shared, "fp", "left_semi")
    near = near.select("id", "key", "size", "fp", "start", "span", F.explode(F.sequence(F.lit(0), F.size("span") - F.col("size"))).alias("i"))
    near = near.select("id", "key", "size", "fp", (F.col("start") + F.col("i")).alias("at"),
                       F.xxhash64(F.slice("span", F.col("i") + 1, F.col("size"))).alias("stretch"))
    place = F.struct("id", "key", "at")
    first = near.groupBy("fp", "stretch").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("fp", "stretch", "first")
    return (near.join(first, ["fp", "stretch"]).where(~place.eqNullSafe(F.col("first")))
            .select("id", "key", "at", "size", "first"))


def repeated_runs(docs: DataFrame, n: int = GUARANTEE, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(id, key, start, stop): the longest runs of later occurrences, lines ``start`` to ``stop`` of the non-blank ones."""
    prints = fingerprints(docs, n)
    if long_words is not None:
        prints = prints.unionByName(long_lines(docs, long_words))
    match = joined_positions(written(prints.distinct(), "fingerprints"))
    # a stretch that overlaps its own first occurrence leaves the lines of that one
    beyond = F.when(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.key") == F.col("key")), F.col("first.at") + F.col("size"))
    match = match.select("id", "key", F.greatest("at", beyond).alias("start"), (F.col("at") + F.col("size") - 1).alias("stop")).distinct()
    text = Window.partitionBy("id", "key").orderBy("start", "stop")         # bounded by the text's own lines
    reach = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opens = match.withColumn("opens", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("id", "key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def dedup_lines(docs: DataFrame, n: int = GUARANTEE, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` without later repeated runs of ``n`` lines or more, plus ``_n_lines`` and ``_n_removed``.

    A later single line of more than ``long_words`` words goes too, unless that is None.
    """
    marked = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"), *marked)
    runs = repeated_runs(rows.select("id", "key", "text"), n, long_words)
    # the lines a text loses, as its non-blank line numbers: bounded by its own lines
    lost = runs.groupBy("id", "key").agg(F.flatten(F.collect_list(F.sequence("start", "stop"))).alias("lost"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("key").alias("lost_key"), "lost")
    joined = rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]) & (rows["key"] == lost["lost_key"]), "left")
    lines = _lines(F.col("text"))
    numbered = joined.withColumn("lines", F.when(F.col("lost").isNotNull(), lines))
    # line numbers of the non-blank lines, then those of them that go
    solid = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    numbered = numbered.withColumn("solid", solid)
    gone = F.transform("lost", lambda j: F.get("solid", j))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    text = F.array_join(F.transform(F.col("kept"), lambda i: F.get("lines", i)), NEWLINE)
    out = (numbered.withColumn("gone", gone).withColumn("kept", F.when(F.col("lost").isNotNull(), kept))
           .withColumn("new_text", F.when(F.col("lost").isNull(), F.col("text")).otherwise(text)))
    result = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            result.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            result.append(F.when(F.col("lost").isNull(), F.col(f"in_{i}"))
                          .otherwise(F.length("new_text")).cast(docs.schema[c].dataType).alias(c))
        else:
            result.append(F.col(f"in_{i}").alias(c))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return out.select(*result, n_lines.cast("long").alias("_n_lines"),
                      F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("_n_removed"))


def line_dedup(docs: DataFrame, n: int = GUARANTEE, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Digest of the operator: lines, lines removed and SHA-256 of what is left, per document."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return dedup_lines(own, n, long_words).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
with lines as (
  select doc_id, text, i, line, trim(line) <> '' as solid
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as i
        from (select distinct doc_id, text from documents))),
solid as (select doc_id, text, i, trim(line) as line, row_number() over (partition by doc_id, text order by i) as pos
          from lines where solid),
stretches as (
  select a.doc_id, a.text, a.pos, {GUARANTEE} as size, a.line || chr(10) || b.line as run
  from solid a join solid b on a.doc_id = b.doc_id and a.text = b.text and b.pos = a.pos + {GUARANTEE - 1}
  union all
  select doc_id, text, pos, 1, line from solid
  where length(line) > {LONG_WORDS} and len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > {LONG_WORDS}),
placed as (select *, row_number() over w as nth, first_value(doc_id) over w as first_id, first_value(text) over w as first_text,
                  first_value(pos) over w as first_pos
           from stretches window w as (partition by size, run order by doc_id, pos)),
later as (select doc_id, text, unnest(range(
            case when doc_id = first_id and text = first_text then greatest(pos, first_pos + size) else pos end, pos + size)) as pos
          from placed where nth > 1),
gone as (select distinct s.doc_id, s.text, s.i from solid s
         join later l on s.doc_id = l.doc_id and s.text = l.text and s.pos = l.pos),
kept as (select l.doc_id, l.text, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) as left_over,
                count(*) as n_lines, count(g.i) as n_removed
         from lines l left join gone g on l.doc_id = g.doc_id and l.text = g.text and l.i = g.i group by l.doc_id, l.text)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(left_over, '')) as kept_sha256
from documents left join kept using (doc_id, text)
"""
