"""Merkle manifest of a dataset: one digest for all rows, and a proof for every row.

Leaves are hashed where they are read; only digests travel.  Each group's leaves are
put in order and numbered (``ranks.ranked``).  A level of the tree is one aggregation
by parent number: conditional aggregates spread the parent's children into ``FANOUT``
slot columns.  The columns concatenated are the parent's hash input; without a child's
own column they are its siblings.  Levels shrink by the fanout, each is written once.
The groups' roots are the leaves of one more tree, whose root stands for the dataset.

Proofs run the other way: a node's path is its siblings and then its parent's path,
handed down level by level; the rows of the last step are made by exploding the slots
of the lowest parents, so a path is never shuffled once a leaf.

Defined results: every null is hashed as ``-``; null is a group of its own, ordered
first; a null id stands before all others; rows of one id are ordered by their
leaves, equal rows are interchangeable; a long text is hashed like any other; other
columns of the input are not carried, so their names cannot clash; an empty table
gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioscope.llm.ranks import ranked
from biblioscope.llm.tables import written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"
ALL = "all"


def hashed(*values: Column) -> Column:
    """Lowercase hex SHA-256 of values concatenated."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return hashed(*[encoded(row[name]) for name in FIELDS])


def _columns(slots: Iterable[int]) -> Column:
    """The digests in slot columns, empty slots left out, concatenated."""
    return F.concat_ws("", *[f"slot_{j}.digest" for j in slots])


def level(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Parents of ``nodes`` (grp, members, place, digest): their slots, digest and own place.

    Slot ``j`` is the child's digest with what else of it is ``carried``.
    """
    child = F.struct("digest", *carried)
    slots = [F.max(F.when(F.col("place") % FANOUT == j, child)).alias(f"slot_{j}") for j in range(FANOUT)]
    parents = (nodes.where("members > 1")
               .groupBy("grp", F.ceil(F.col("members") / FANOUT).cast("long").alias("members"),
                        F.floor(F.col("place") / FANOUT).cast("long").alias("place")).agg(*slots))
    return parents.withColumn("digest", F.sha2(_columns(range(FANOUT)).cast("binary"), 256))


def levels(nodes: DataFrame, name: str, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """Written tables of parents, lowest first, until every group has one node."""
    size = nodes.agg(F.max("members")).first()[0] or 0
    tables = []
    while size > 1:
        tables.append(written(level(nodes, carried), f"{name}-{len(tables)}"))
        nodes, carried, size = tables[-1].select("grp", "members", "place", "digest"), (), -(-size // FANOUT)
    return tables


def tops(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(grp, digest) of every group's last node."""
    out = nodes.where("members = 1").select("grp", "digest")
    for t in tables:
        out = out.unionByName(t.where("members = 1").select("grp", "digest"))
    return out


def children(parents: DataFrame) -> DataFrame:
    """One row a child of ``parents`` (level rows with ``path``): place, child, and its own path."""
    slots = F.array_compact(F.array(*[
        F.when(F.col(f"slot_{j}").isNotNull(), F.struct(
            (F.col("place") * FANOUT + j).alias("place"), F.col(f"slot_{j}").alias("child"),
            _columns(range(j)).alias("left"), _columns(range(j + 1, FANOUT)).alias("right")))
        for j in range(FANOUT)]))
    rows = parents.select("grp", "path", F.explode(slots).alias("at"))
    step = F.array(F.struct(F.col("at.left").alias("left"), F.col("at.right").alias("right")))
    return rows.select("grp", F.col("at.place").alias("place"), F.col("at.child").alias("child"),
                       F.concat(step, F.col("path")).alias("path"))


def paths(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the lowest nodes in ``tables``: grp, place, child, path (siblings from the leaf up).

    ``top`` gives every group's path (grp, path) above its last node.
    """
    handed = None
    for k in reversed(range(len(tables))):
        at = tables[k].where("members = 1").join(top, "grp")
        if handed is not None:
            at = at.unionByName(tables[k].where("members > 1").join(handed, ["grp", "place"]))
        handed = children(at)
        if k:
            handed = written(handed.drop("child"), f"paths-{k}")
    return handed


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda digest, step: hashed(step["left"], digest, step["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``folded_root`` starts from the tampered row where 3 divides the CRC-32 of the
    decimal id: there the text's A-Z are lower-cased.
    """
    row = {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long"),
           **{c: F.col(c).cast("string") for c in ("source", "lang", "text")}}
    touched = F.crc32(row["doc_id"].cast("string")) % 3 == 0
    tampered = {**row, "text": F.translate(row["text"], UPPER, LOWER)}
    leaves = docs.select(row["doc_id"].alias("doc_id"), leaf(row).alias("digest"), leaf(tampered).alias("lowered"), touched.alias("touched"),
                         F.coalesce(F.concat(F.lit("="), row["lang"]), F.lit("-")).alias("grp"))
    leaves = written(leaves.select("grp", "doc_id", "digest",
                                   F.when(F.col("touched"), F.col("lowered")).otherwise(F.col("digest")).alias("seen")), "leaves")
    nodes = written(ranked(leaves, "grp", [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "nodes")
    per_group = levels(nodes, "groups", carried=("doc_id", "seen"))
    subroots = written(tops(nodes, per_group), "subroots")

    roots = written(ranked(subroots.withColumn("key", F.lit(ALL)), "key", [F.col("grp")])
                    .select(F.col("key").alias("grp"), "members", "place", "digest", F.col("grp").alias("name")), "roots")
    over_all = levels(roots, "all", carried=("name",))
    root = tops(roots, over_all).first()
    root = F.lit(root["digest"] if root else None).cast("string")
    none = F.array().cast(PATH)
    if over_all:
        start = docs.sparkSession.createDataFrame([(ALL,)], "grp string").withColumn("path", none)
        top = paths(over_all, start).select(F.col("child.name").alias("grp"), "path")
    else:                                       # at most one group: nothing stands above it
        top = roots.select(F.col("name").alias("grp"), none.alias("path"))
    top = written(top, "top")

    rows = nodes.where("members = 1").join(top, "grp").select("grp", "doc_id", "digest", "seen", "path")
    if per_group:
        rows = rows.unionByName(paths(per_group, top).select("grp", "child.doc_id", "child.digest", "child.seen", "path"))
    rows = rows.join(subroots.select("grp", F.col("digest").alias("subroot")), "grp")
    proof = F.aggregate("path", F.lit(""), lambda text, step: F.concat(text, step["left"], step["right"]))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
                       hashed(proof).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root")
                       ).withColumn("verified", F.col("folded_root") == F.col("root"))


# --- SQL ----------------------------------------------------------------------

def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    code = f"hex(encode({text}))"
    bit = f"((('0x' || substr({code}, 2 * (i // 8)::int + 1, 2))::bigint >> (i % 8)::int) & 1)"
    steps = f"list_transform(range(4 * strlen({code})), lambda i: {bit})"
    return (f"xor(list_reduce({steps}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), "
            "4294967295::bigint)")


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _levels_sql(name: str, depth: int) -> str:
    """From CTE ``{name}0`` (grp, n, i, h) the nodes of every level (a finished group stays), each with its siblings."""
    out = []
    for k in range(depth):
        run = f"partition by grp, i // {FANOUT} order by i rows between"
        out.append(f"""{name}{k + 1} as materialized (
  select grp, case when n > 1 then (n + {FANOUT - 1}) // {FANOUT} else n end as n, i // {FANOUT} as i,
         case when n > 1 then sha256(string_agg(h, '' order by i)) else min(h) end as h
  from {name}{k} group by grp, n, i // {FANOUT})""")
        out.append(f"""{name}_beside{k} as materialized (
  select grp, i, n, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from {name}{k})""")
    return ",\n".join(out)


def _climb_sql(rows: str, name: str, depth: int) -> str:
    """CTEs that fold ``rows`` (.., grp, spot, f, p) up the tree ``name``; the last is ``{name}_top``."""
    out = []
    for k in range(depth):
        out.append(f"""{name}_up{k + 1} as materialized (
  select w.* replace (case when s.n > 1 then sha256(s.l || w.f || s.r) else w.f end as f,
                      case when s.n > 1 then w.p || s.l || s.r else w.p end as p, w.spot // {FANOUT} as spot)
  from {f"{name}_up{k}" if k else rows} w join {name}_beside{k} s on s.grp = w.grp and s.i = w.spot)""")
    out.append(f"{name}_top as (select * from {name}_up{depth})")
    return ",\n".join(out)


def oracle_sql(depth: int = 7, depth_of_groups: int = 4) -> str:
    """The manifest in SQL, for groups of at most ``FANOUT ** depth`` rows."""
    return f"""
with leaves as materialized (
  select doc_id, coalesce('=' || lang, '-') as grp, {_leaf_sql("text")} as leaf,
         case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} end as lowered
  from documents),
placed as materialized (
  select *, coalesce(lowered, leaf) as seen, count(*) over (partition by grp) as n,
         row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from leaves),
g0 as materialized (select grp, n, i, leaf as h from placed),
{_levels_sql("g", depth)},
t0 as materialized (select 'all' as grp, count(*) over () as n, row_number() over (order by encode(grp)) - 1 as i, h, grp as name
                    from g{depth}),
{_levels_sql("t", depth_of_groups)},
started as materialized (select doc_id, leaf, grp, i as spot, seen as f, '' as p from placed),
{_climb_sql("started", "g", depth)},
halfway as materialized (select w.* replace ('all' as grp, t0.i as spot), t0.h as subroot from g_top w join t0 on t0.name = w.grp),
{_climb_sql("halfway", "t", depth_of_groups)}
select doc_id, leaf, subroot, t{depth_of_groups}.h as root, sha256(p) as proof_sha256, f as folded_root,
       f = t{depth_of_groups}.h as verified
from t_top, t{depth_of_groups}
"""


ORACLE = oracle_sql()
