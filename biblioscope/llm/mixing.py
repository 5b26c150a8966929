"""Mixing sources to target weights.

Sizes are words.  Sources are ordered by code point, null last, and weigh 3, 1, 2,
repeating.  They share ``SHARE`` times the size of all texts by weight, but no source
gets more than ``MOST`` times its own size; what is cut off is shared again by
weight.  With r = cap / weight the capped sources are a prefix in the order of r, so
running sums give the level in closed form.

Each document is taken floor(rate) times, plus once more with a probability equal to
the fraction: a hash of id, seed and text against it, the same in every run.

Defined results: a null text is an empty text of size 0; null is a source of its own;
a source of size 0 has target 0 and its documents are taken 0 times; rows equal in id
and text are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioscope.llm.tables import lookup, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 29


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source_size, target and rate.

    Sizes are summed map-side first.  The windows run over the sources alone.
    """
    per = (sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    cap = F.col("source_size") * F.lit(most)
    per = per.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # sources of equal ratio are capped together: a range window takes its peers in
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "all_weight": F.sum("weight").over(everything),
        "caps_upto": F.sum("cap").over(upto), "weight_upto": F.sum("weight").over(upto)})
    capped = F.col("budget") - F.col("caps_upto") >= F.col("ratio") * (F.col("all_weight") - F.col("weight_upto"))
    per = per.withColumn("capped", capped)
    free = per.withColumns({
        "left_over": F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
        "free_weight": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)})
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("left_over") * F.col("weight") / F.col("free_weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return free.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, id_col: Column, text: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one where the hash of id and text falls below the fraction."""
    row = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.coalesce(text.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(row.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """Documents with size, source_size, target and the number of copies to take."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = written(source_targets(sized.select("source", "size")), "targets")
    joined = lookup(sized, targets, "source", F.xxhash64("doc_id", "text"))
    return joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("text"))).drop("rate")


def mixture(docs: DataFrame) -> DataFrame:
    """Size and words taken of every document."""
    own = docs.select(F.col("doc_id").cast("long"), "source", F.col("text").cast("string"))
    return mix(own).select("doc_id", "size", "source_size", "target",
                           (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    marked = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*marked, "doc_id", "source", "text")
    taken = mix(rows).withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = f"""
with sized as (
  select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
         [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source),
caps as (select *, source_size * {MOST}::double as cap, source_size * {MOST}::double / weight as ratio,
                sum(source_size) over () * {SHARE}::double as budget, sum(weight) over () as all_weight from per),
upto as (select *, sum(cap) over (order by ratio) as caps_upto, sum(weight) over (order by ratio) as weight_upto from caps),
marked as (select *, budget - caps_upto >= ratio * (all_weight - weight_upto) as capped from upto),
free as (select *, budget - sum(case when capped then cap else 0 end) over () as left_over,
                sum(case when capped then 0 else weight end) over () as free_weight from marked),
targets as (select source, source_size,
                   case when capped then cap else least(cap, left_over * weight / free_weight) end as target from free),
rates as (select *, case when source_size > 0 then least(target / source_size, {MOST}::double) else 0 end as rate from targets),
drawn as (
  select doc_id, size, source_size, target, s.source,
         floor(rate) + case when ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':{SEED}:' || coalesce(text, '')), 1, 12))::bigint::double
                                 / 281474976710656.0::double < rate - floor(rate) then 1 else 0 end as copies
  from sized s join rates r on s.source is not distinct from r.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, source, copies::bigint as copies from drawn
"""
