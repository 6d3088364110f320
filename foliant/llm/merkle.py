"""Merkle manifest of a table: leaves per source in the order of their ids, 16 nodes to a parent.

A node of a tree is keyed by the digits, in base 16, of the rank of its first leaf within its source: the
parent of node i is node i div 16, so a level is one grouping by (source, i div 16) of at most 16
rows, and nodes with the longest keys are reduced first. Ranks come without a global sort. The
sort key of a leaf (id, then leaf) is written as hex digits, a path; rows are counted by (source,
prefix of the path) in a histogram of DIGITS more digits than all paths share, and of as many more
as it takes until no bin holds over BIN different leaves. Histograms of shorter prefixes are sums
of longer ones. What stands before a bin is the sum over its smaller siblings on every level, each
a window over at most 16 ^ DIGITS rows; within a bin a window over its few rows gives the rest.

Equal rows are one leaf with a number of copies until ranks are known, so a row that is repeated
without end never meets in one task; copies are then dealt out in blocks. Proofs go down the
tree: each node knows, for every level above it, the text of its siblings to the left and to the
right.

Defined results: null fields are written as ``-``, also the id, whose rows come first; rows with equal
ids are ordered by leaf; equal rows are leaves of their own, one beside the other; an empty table
gives an empty result; texts of any length are hashed whole; columns other than FIELDS are not
read, so their names can't clash.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
DIGITS = 3
BIN = 4096
TAMPERED_SHARE = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(x: Column) -> Column:
    """A value with its length in front, so that neighbours can't be mixed up."""
    own = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): the digest of a row, and that of the row as it is after the tampering, if it is tampered with.

    The tree is the source, with a mark in front that is never null and keeps the order: null first, then by bytes.
    """
    own = [field(F.col(x)) for x in FIELDS[:-1]]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_SHARE == 0
    lowered = digest(*own, field(F.translate("text", _UPPER, _LOWER)))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*own, field(F.col("text"))).alias("leaf"), F.when(hit, lowered).alias("tampered"))


def id_path(key: Column) -> Column:
    """Hex digits in the order of a long, null first."""
    return F.when(key.isNull(), F.repeat(F.lit("0"), F.lit(17))).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))


def text_path(key: Column) -> Column:
    """Hex digits in the order of a text's bytes."""
    return F.hex(key.cast("binary"))


def ranked(rows: DataFrame, group: str, path: Column, scratch: Scratch, copies: str | None = None) -> DataFrame:
    """rows with ``rank``, the number of rows of the group before a row by path, and ``size``, that of the group's rows.

    A row with copies counts as so many. Paths are hex digits; a path stands before those that it begins.
    """
    n = F.col(copies) if copies else F.lit(1)
    low, high, longest = rows.agg(F.min(path), F.max(path), F.max(F.length(path))).first()
    shared = len(commonprefix([low or "", high or ""]))
    depth = shared + DIGITS
    while True:
        found = rows.groupBy(F.col(group).alias("group"), F.substring(path, 1, depth).alias("bin")).agg(F.sum(n).alias("n"), F.count("*").alias("rows"))
        bins = scratch.table(found, "bins")
        if depth >= (longest or 0) or (bins.agg(F.max("rows")).first()[0] or 0) <= BIN:
            break
        depth += DIGITS
    levels = [bins.select("group", "bin", "n")]
    for d in range(depth - DIGITS, shared - 1, -DIGITS):
        levels.append(levels[-1].groupBy("group", F.substring("bin", 1, d).alias("bin")).agg(F.sum("n").alias("n")))
    placed = levels.pop().select("group", F.col("bin").alias("up"), F.lit(0).cast("long").alias("up_before"), F.col("n").alias("size"))
    while levels:  # down to the bins: what stands before the parent, and the smaller siblings
        siblings = Window.partitionBy("group", "up").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        own = levels.pop().withColumn("up", F.expr(f"substring(bin, 1, {depth - DIGITS * (len(levels) + 1)})"))
        own = own.withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        placed = own.join(placed, ["group", "up"]).select("group", F.col("bin").alias("up"), (F.col("before") + F.col("up_before")).alias("up_before"), "size")
    placed = placed.select(F.col("group").alias(group), F.col("up").alias("_bin"), "up_before", "size")
    within = Window.partitionBy(group, "_bin").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({"_path": path, "_bin": F.substring(path, 1, depth)}).withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return own.join(placed, [group, "_bin"]).select(*rows.columns, (F.col("_within") + F.col("up_before")).alias("rank"), "size")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """A row for each copy, with the next ranks; many copies are dealt in blocks to other tasks first."""
    own = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BIN).cast("long"))))
    if most > BIN:
        own = own.repartition("tree", "rank", "at")
    to = F.least(F.col("at") + BIN, F.col("copies")) - 1
    return own.withColumn("k", F.explode(F.sequence("at", to))).withColumn("rank", F.col("rank") + F.col("k")).drop("copies", "at", "k")


def _parents(nodes: DataFrame, member: Column) -> DataFrame:
    """(tree, node, size, members, hash): runs of 16 nodes and their digest; size is that of the new level."""
    runs = nodes.groupBy("tree", F.expr(f"node div {FANOUT}").alias("node"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"))
    own = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), member.alias("m")))).alias("members"))
    own = own.withColumn("members", F.transform("members", lambda x: x["m"]))
    return own.withColumn("hash", digest(F.array_join(F.transform("members", lambda m: m["hash"]), "")))


def grown(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs, lowest first, and (tree, hash) of each tree's root.

    nodes has (tree, node, size, member) with member.hash; a tree of one node is its own root.
    """
    runs, roots = [], [nodes.where("size = 1").select("tree", F.col("member.hash").alias("hash"))]
    level, member, most = nodes.where("size > 1"), F.col("member"), nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        made = scratch.table(_parents(level, member), f"level{len(runs)}")
        runs.append(made)
        roots.append(made.where("size = 1").select("tree", "hash"))
        level, member, most = made.where("size > 1"), F.struct("hash"), -(-most // FANOUT)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return runs, out


def _no_levels() -> Column:
    return F.array().cast("array<struct<before: string, after: string>>")


def _sides(members: Column, at: Column) -> Column:
    """The siblings of one member of a run: what stands to its left and right, as one text each."""
    texts = F.transform(members, lambda m: m["hash"])
    return F.struct(F.array_join(F.slice(texts, F.lit(1), at), "").alias("before"), F.array_join(F.slice(texts, at + 2, F.greatest(F.size(texts) - at - 1, F.lit(0))), "").alias("after"))


def descended(runs: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """(tree, node, members, up, root) of the lowest runs: up has the sides of all levels above a run, lowest first.

    above has (tree, up, root): the sides above each tree's root. None if no tree has a run.
    """
    out = None
    for made in reversed(runs):
        own = made.select("tree", "node", "size", "members")
        tops = own.where("size = 1").join(above, "tree").select("tree", "node", "members", "up", "root")
        if out is not None:
            lower = own.where("size > 1").withColumn("to", F.expr(f"node div {FANOUT}"))
            parents = out.select("tree", F.col("node").alias("to"), F.col("members").alias("around"), F.col("up").alias("higher"), "root")
            at = (F.col("node") % FANOUT).cast("int")
            tops = tops.unionByName(lower.join(parents, ["tree", "to"]).select("tree", "node", "members", F.concat(F.array(_sides(F.col("around"), at)), F.col("higher")).alias("up"), "root"))
        out = tops
    return out


OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, the roots, the digest of its proof, and the root recomputed from what it is after the tampering."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    distinct = scratch.table(leaves(docs).groupBy("tree", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies")), "leaves")
    most = distinct.agg(F.max("copies")).first()[0]
    if most is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    order = F.concat(id_path(F.col("doc_id")), F.col("leaf"))
    rows = dealt(ranked(distinct, "tree", order, scratch, "copies"), most)
    nodes = scratch.table(rows.select("tree", F.col("rank").alias("node"), "size", F.struct(F.col("leaf").alias("hash"), "doc_id", "tampered").alias("member")), "nodes")
    scratch.drop_all_but(nodes)
    runs, subroots = grown(nodes, scratch)

    # the subroots are the leaves of one more tree, in the order of their sources' bytes
    tops = scratch.table(subroots.select(F.lit("").alias("all"), F.col("tree").alias("source"), "hash"), "subroots")
    placed = ranked(tops, "all", text_path(F.col("source")), scratch)
    top_nodes = scratch.table(placed.select(F.col("all").alias("tree"), F.col("rank").alias("node"), "size", F.struct("hash", "source").alias("member")), "top-nodes")
    top_runs, found = grown(top_nodes, scratch)
    root = found.first()["hash"]
    above = tops.select(F.col("source").alias("tree"), _no_levels().alias("up"), F.col("hash").alias("root"))
    if top_runs:
        top = found.select("tree", _no_levels().alias("up"), F.col("hash").alias("root"))
        lowest = descended(top_runs, top)
        each = lowest.select("members", "up", F.posexplode("members").alias("at", "m"))
        above = each.select(F.col("m.source").alias("tree"), F.concat(F.array(_sides(F.col("members"), F.col("at"))), F.col("up")).alias("up"), F.col("m.hash").alias("root"))
    above = scratch.table(above, "above")

    # a source with one document has no run: its leaf is its subroot
    proven = nodes.where("size = 1").join(above, "tree").select("member.*", "up", "root")
    lowest = descended(runs, above)
    if lowest is not None:
        each = lowest.select("members", "up", "root", F.posexplode("members").alias("at", "m"))
        proven = each.select("m.*", F.concat(F.array(_sides(F.col("members"), F.col("at"))), F.col("up")).alias("up"), "root").unionByName(proven)
    proof = F.aggregate("up", F.lit(""), lambda acc, s: F.concat(acc, s["before"], s["after"]))
    folded = F.aggregate("up", F.coalesce("tampered", "hash"), lambda acc, s: digest(s["before"], acc, s["after"]))
    out = proven.select("doc_id", F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.lit(root).alias("root"), digest(proof).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).select(*OUT)


def _level_sql(name: str, nodes: str, levels: int) -> str:
    """CTEs of a forest over nodes (tree, node, hash): name_k (tree, node, hash, size) for each level k."""
    parts = [f"{name}_0 AS (SELECT tree, node, hash, count(*) OVER (PARTITION BY tree) AS size FROM {nodes})"]
    for k in range(levels):
        made = f"SELECT tree, node // {FANOUT} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM {name}_{k} WHERE size > 1 GROUP BY ALL"
        parts.append(f"{name}_{k + 1} AS (SELECT tree, node, hash, count(*) OVER (PARTITION BY tree) AS size FROM ({made}))")
    parts.append(f"{name}_root AS ({' UNION ALL '.join(f'SELECT tree, hash FROM {name}_{k} WHERE size = 1' for k in range(levels + 1))})")
    return ",\n".join(parts)


def _proof_sql(name: str, start: str, levels: int) -> str:
    """CTEs that carry rows (id, tree, node, acc, proof) of start up a forest; name_p has the last ones."""
    parts, before = [], start
    for k in range(levels):
        members = f"{name}_{k} n ON n.tree IS NOT DISTINCT FROM d.tree AND n.node // {FANOUT} = d.node // {FANOUT} AND n.size > 1"
        parts.append(f"""{name}_p{k} AS (SELECT d.id, d.tree, d.node // {FANOUT} AS node,
 CASE WHEN count(n.node) = 0 THEN any_value(d.acc) ELSE sha256(string_agg(CASE WHEN n.node = d.node THEN d.acc ELSE n.hash END, '' ORDER BY n.node)) END AS acc,
 any_value(d.proof) || coalesce(string_agg(CASE WHEN n.node <> d.node THEN n.hash END, '' ORDER BY n.node), '') AS proof
 FROM {before} d LEFT JOIN {members} GROUP BY d.id, d.tree, d.node)""")
        before = f"{name}_p{k}"
    return ",\n".join(parts)


def _sql(levels: int = 7) -> str:
    """DuckDB SQL for trees of up to 16 ^ levels leaves."""
    f = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([f("doc_id::VARCHAR"), f("source"), f("lang"), f("n_chars::VARCHAR"), f(text)]) + ")"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END"
    return f"""
WITH crcs AS (SELECT doc_id AS c_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::UBIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {step})) AS crc FROM (SELECT DISTINCT doc_id FROM documents)),
docs AS (SELECT row_number() OVER () AS id, doc_id, source, {leaf("text")} AS leaf,
 CASE WHEN xor(crc, 4294967295::UBIGINT) % {TAMPERED_SHARE} = 0 THEN {leaf(lowered)} END AS tampered FROM documents LEFT JOIN crcs ON c_id = doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node FROM docs),
leaf_nodes AS (SELECT source AS tree, node, leaf AS hash FROM placed),
{_level_sql("t", "leaf_nodes", levels)},
top_nodes AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS node, hash, tree AS source FROM t_root),
{_level_sql("u", "top_nodes", levels)},
starts AS (SELECT id, source AS tree, node, coalesce(tampered, leaf) AS acc, '' AS proof FROM placed),
{_proof_sql("t", "starts", levels)},
tops AS (SELECT p.id, 0 AS tree, n.node, p.acc, p.proof FROM t_p{levels - 1} p JOIN top_nodes n ON n.source IS NOT DISTINCT FROM p.tree),
{_proof_sql("u", "tops", levels)}
SELECT doc_id, leaf, r.hash AS subroot, v.hash AS root, sha256(p.proof) AS proof_sha256, p.acc AS folded_root, p.acc = v.hash AS verified
FROM placed d JOIN t_root r ON r.tree IS NOT DISTINCT FROM d.source JOIN u_p{levels - 1} p ON p.id = d.id, u_root v
"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the manifest of the table."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
