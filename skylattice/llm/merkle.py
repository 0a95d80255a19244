"""Merkle manifest of a dataset: a digest of every row, a tree of digests for every source, a tree over the sources' roots.

Trees grow level by level with sibling-shift self-joins. A node knows its index and how many nodes its level has. Its
siblings' indices are computed from its own (in a run of `fan_in` nodes the other slots, by offsets modulo fan_in; for two
that is the index XOR 1), and the level is joined with itself on (tree, computed index), once for each offset. Every node so
gets the digests left and right of it in its run, and the rows at slot zero, which see their whole run, emit the parents.
Levels shrink by fan_in, so all of them together have n * fan_in / (fan_in - 1) rows. Each is written to the shared folder.

Proofs go down the same tables: a node's path is its own siblings before its parent's path, one join on (tree, index div
fan_in) a level, so that only the last join has a row for each document. Texts are read once and never shuffled.

No key is hot: nodes are joined by unique indices, rows are ordered by ranges of (source, id, digest, row), so a source of
any size, rows without an id and repeated rows are cut into many ranges, and the table of sources meets rows by lookup().

Null values of a row count as `-`, others as byte count, `:`, value; a null source is a source of its own, the first. Null
ids come first and are never tampered with; rows with equal ids stand by their digest. An empty table has no leaves, no root
and no rows. Columns other than the five of a leaf are ignored, whatever their names. A text of any length is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, positions, read_table, staged

FAN_IN = 3
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(*[framed(text if c == "text" else F.col(c)) for c in LEAF])


def siblings(nodes: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One level (tree, idx, digest and others) with `left` and `right`: the digests of its run before and after each node, concatenated."""
    slot, base = F.col("idx") % fan_in, F.col("idx") - F.col("idx") % fan_in
    out = nodes
    for k in range(1, fan_in):
        shifted = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_d{k}"))
        out = out.join(shifted, (F.col("tree") == F.col("_tree")) & (base + (slot + k) % fan_in == F.col("_idx")), "left").drop("_tree", "_idx")
    at = lambda t: F.coalesce(*[F.when((slot + k) % fan_in == t, F.col(f"_d{k}")) for k in range(1, fan_in)], F.lit(""))
    left = F.concat(*[F.when(slot > t, at(t)).otherwise("") for t in range(fan_in)])
    right = F.concat(*[F.when(slot < t, at(t)).otherwise("") for t in range(fan_in)])
    return out.withColumns({"left": left, "right": right}).drop(*[f"_d{k}" for k in range(1, fan_in)])


def grow(leaves: DataFrame, most: int, fan_in: int = FAN_IN) -> tuple[list[DataFrame], DataFrame]:
    """leaves (tree, idx, n, digest and others; n nodes in the tree, `most` at most) -> written levels with left and right, and (tree, digest) of the roots."""
    levels, roots, now = [], leaves.where("n = 1").select("tree", "digest"), leaves.where("n > 1")
    while most > 1:
        most = -(-most // fan_in)
        level = staged(siblings(now, fan_in), f"merkle-{len(levels)}")
        levels.append(level)
        parents = level.where(F.col("idx") % fan_in == 0).select(
            "tree", F.floor(F.col("idx") / fan_in).alias("idx"), F.ceil(F.col("n") / fan_in).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest")
        )
        roots, now = roots.unionByName(parents.where("n = 1").select("tree", "digest")), parents.where("n > 1")
    return levels, roots


def paths(levels: list[DataFrame], tops: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The lowest level's nodes with `path`, the (left, right) of every level from their own to the root, and what tops (tree, path
    above the tree's root, others) says of their tree."""
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        # Trees whose root is the parent level's only node, and inner nodes of larger trees.
        ends = tops.join(level.where("idx = 0 and n <= %d" % fan_in).select("tree"), "tree").select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_up"), F.col("path").alias("_path"), *extra)
        inner = ends if above is None else ends.unionByName(above)
        joined = level.join(inner, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / fan_in) == F.col("_up")))
        joined = joined.withColumn("path", F.concat(F.array(F.struct("left", "right")), "_path")).drop("_tree", "_up", "_path", "left", "right")
        if depth == 0:
            return joined
        above = joined.select(F.col("tree").alias("_tree"), F.col("idx").alias("_up"), F.col("path").alias("_path"), *extra)
    raise ValueError("no levels")


def folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; `tampered`: the text as it is found
    when the row is checked, null where it is unchanged."""
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("name"),
        leaf_digest(F.col("text")).alias("digest"), changed.alias("found"), F.monotonically_increasing_id().alias("copy"),
    )
    # Written first: what ranges are cut by must not change when a task runs again.
    placed = positions(staged(rows, "merkle-rows"), ["name", "doc_id", "digest", "copy"], "place").drop("copy")
    sources = positions(placed.groupBy("name").agg(F.min("place").alias("base"), F.count("*").alias("n")), ["name"], "tree")
    sources = staged(sources, "merkle-sources")
    most, n_sources = sources.agg(F.max("n"), F.count("*")).first()
    if not n_sources:
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], empty)
    leaves = lookup(placed, sources, ["name"], sources).select("tree", (F.col("place") - F.col("base")).alias("idx"), "n", "digest", "found", "doc_id")
    leaves = staged(leaves, "merkle-leaves")
    levels, subroots = grow(leaves, most, fan_in)
    subroots = staged(subroots, "merkle-subroots")
    upper, root = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "digest"), n_sources, fan_in)
    root = F.lit(root.first()["digest"])
    if upper:
        none = spark.range(1).select(F.col("id").alias("tree"), F.expr("array_remove(array(struct('' as left, '' as right)), struct('' as left, '' as right))").alias("path"))
        tops = paths(upper, none, fan_in).select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"))
    else:
        tops = subroots.select("tree", F.expr("array_remove(array(struct('' as left, '' as right)), struct('' as left, '' as right))").alias("path"), F.col("digest").alias("subroot"))
    tops = staged(tops, "merkle-tops")
    alone = leaves.where("n = 1").join(tops, "tree")
    columns = ["doc_id", "digest", "found", "subroot", "path"]
    out = alone.select(columns)
    if levels:
        out = paths(levels, tops, fan_in).select(columns).unionByName(out)
    proof = digest(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    back = folded(F.coalesce("found", "digest"), F.col("path"))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(True))
    return manifest(docs, F.when(~odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


ORACLE = """
with recursive base as (select doc_id, source, text,
    (select string_agg(v, '' order by k) from (values (1, doc_id::varchar), (2, source), (3, lang), (4, n_chars::varchar)) f(k, w), lateral (select coalesce(strlen(w)::varchar || ':' || w, '-') v)) head from documents),
leaves as (select doc_id, source, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), ''))::varchar || ':' || replace(text, chr(10), ''), '-')) less,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
      lambda r, b: list_reduce(list_prepend(xor(r, b), [x::ubigint for x in range(8)]), lambda s, i: xor(s >> 1, (s & 1) * 3988292384::ubigint))) crc from base),
ordered as (select *, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 idx,
    case when doc_id is not null and xor(crc, 4294967295::ubigint) % 2 = 0 then less else leaf end found from leaves),
nodes as (select 0 lvl, tree, idx, leaf d from ordered
  union all select lvl + 1, tree, idx // 3, run from
    (select lvl, tree, idx, sha256(d || coalesce(lead(d, 1) over w, '') || coalesce(lead(d, 2) over w, '')) run, count(*) over (partition by tree) n from nodes window w as (partition by tree, idx // 3 order by idx))
    where idx % 3 = 0 and n > 1),
tops as (select tree, max(lvl) top, max_by(d, lvl) subroot from nodes group by tree),
upper as (select 0 lvl, tree idx, subroot d from tops
  union all select lvl + 1, idx // 3, run from
    (select lvl, idx, sha256(d || coalesce(lead(d, 1) over w, '') || coalesce(lead(d, 2) over w, '')) run, count(*) over () n from upper window w as (partition by idx // 3 order by idx))
    where idx % 3 = 0 and n > 1),
roots as (select max(lvl) top, max_by(d, lvl) root from upper),
runs as (select 0 kind, lvl, tree, idx // 3 run, list(d order by idx) ds from nodes join tops using (tree) where lvl < top group by all
  union all select 1, lvl, 0, idx // 3, list(d order by idx) from upper, roots where lvl < top group by all),
walk as (select doc_id, tree, idx, leaf, found acc, '' proof, 0 kind, 0 lvl, idx node from ordered
  union all select doc_id, w.tree, w.idx, leaf,
      case when r.ds is null then acc else sha256(array_to_string(r.ds[:node % 3], '') || acc || array_to_string(r.ds[node % 3 + 2:], '')) end,
      case when r.ds is null then proof else proof || array_to_string(r.ds[:node % 3], '') || array_to_string(r.ds[node % 3 + 2:], '') end,
      case when r.ds is null then w.kind + 1 else w.kind end, case when r.ds is null then 0 else w.lvl + 1 end, case when r.ds is not null then node // 3 else w.tree end
    from walk w left join runs r on r.kind = w.kind and r.lvl = w.lvl and r.tree = (case when w.kind = 0 then w.tree else 0 end) and r.run = node // 3 where w.kind < 2)
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, acc folded_root, acc = root verified from walk join tops using (tree), roots where kind = 2
"""
