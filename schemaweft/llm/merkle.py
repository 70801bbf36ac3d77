"""Merkle manifest of a data set, and proofs climbed by a recursive query.

Every row is a leaf. Per source, each 16 consecutive nodes become their hash until one is left;
these subroots, in order of their sources, are put together likewise. The built levels are kept as
rows that link to their parents, each with its siblings' hashes on both sides. A recursive query then
ascends from every leaf: it appends the siblings and folds the leaf's hash, level by level.

The leaves of one run share all that is above them, so they climb in one row, with each distinct hash
that they fold to. Digests travel as bytes; hashed is their hex text. A link is listed once for each few thousand runs below it (``salt``), so runs of a large
source do not meet in one task near the root.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.llm.common import positions, settle

FANOUT = 16
#: Runs that join one copy of a link, at about.
RUNS_PER_LINK = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over the subroots; those of sources begin with "s:" or are "n" for NULL.
TOP = "t"
#: The recursion's bound on rows is not of use here: it ends at the root.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _groups(nodes: DataFrame) -> DataFrame:
    """Each FANOUT consecutive nodes (tree, idx, hash, runs, node, subroot) of a tree in one row."""
    member = F.struct("idx", "hash", "runs", "node", "subroot")
    groups = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("up")).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.sum("runs").alias("runs")
    )
    return groups.withColumns({"hashes": F.col("members.hash"), "alone": (F.col("up") == 0) & (F.size("members") == 1)})


def joined(digests: str) -> str:
    """The bytes of an array of digests, one behind the other."""
    return f"aggregate({digests}, X'', (all, x) -> concat(all, x))"


def parent(content: str) -> str:
    """The digest over the hex text of ``content``."""
    return f"unhex(sha2(lower(hex({content})), 256))"


def _between(hashes: str, at: str) -> tuple[str, str]:
    """The digests in front of and behind the one at position ``at`` (from 0)."""
    return joined(f"slice({hashes}, 1, {at})"), joined(f"slice({hashes}, {at} + 2, size({hashes}))")


def _hex(digest) -> Column:
    return F.lower(F.hex(digest))


def _node(tree: Column, level: int, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), F.lit(level).alias("level"), idx.cast("long").alias("idx"))


def _levels(nodes: DataFrame, first: int, subroots: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links from ``nodes`` (tree, idx, hash, runs, node) upwards, and each tree's last node.

    Every level has a 16th of the rows of the one below, so there are as many jobs as levels.
    ``subroots`` says that the nodes are ends of sources' trees: their links name them.
    """
    links, ends, level = [], [], first
    nodes = nodes.withColumn("subroot", F.col("hash") if subroots else F.lit(None).cast("binary"))
    while True:
        groups = settle(_groups(nodes))
        ends.append(groups.filter("alone").select("tree", F.col("members")[0]["hash"].alias("hash"), "runs", F.col("members")[0]["node"].alias("node")))
        rest = groups.filter(~F.col("alone"))
        before, after = _between("hashes", "at")
        up = _node(F.col("tree"), level, F.col("up"))
        links.append(
            rest.select("tree", "up", "hashes", "runs", F.posexplode("members").alias("at", "member")).select(
                F.col("member.node").alias("node"),
                F.col("member.runs").alias("below"),
                up.alias("parent"),
                F.ceil(F.col("runs") / RUNS_PER_LINK).cast("long").alias("salts"),
                F.expr(before).alias("before"),
                F.expr(after).alias("after"),
                F.col("member.subroot").alias("subroot"),
            )
        )
        above = rest.select("tree", F.col("up").alias("idx"), F.expr(parent(joined("hashes"))).alias("hash"), "runs", up.alias("node"))
        if not rest.take(1):
            return links, ends
        nodes, level = above.withColumn("subroot", F.lit(None).cast("binary")), level + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@contextmanager
def _unlimited(spark: SparkSession):
    had = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if had is None else spark.conf.set(ROW_LIMIT, had)


CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT tree, run, node, salt, folds, CAST(X'' AS BINARY) AS proof, CAST(NULL AS BINARY) AS subroot FROM {{runs}}
  UNION ALL
  SELECT c.tree, c.run, l.parent, pmod(c.run, l.salts), transform(c.folds, x -> {parent("concat(l.before, x, l.after)")}),
         concat(c.proof, l.before, l.after), coalesce(c.subroot, l.subroot)
  FROM climb c JOIN {{links}} l ON c.node.tree = l.node.tree AND c.node.level = l.node.level AND c.node.idx = l.node.idx AND c.salt = l.salt)
SELECT * FROM climb
"""
ALONE = "run = 0 AND size(leaves) = 1"


def proofs(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of ``docs``.

    ``tampered`` is the leaf hash that a receiver would compute (``leaf`` over altered columns);
    the root folded from it and the original siblings is compared with the true one. Leaves of a source
    ascend by doc_id, rows without one first; rows of one doc_id by their hash, and equal rows are
    leaves of their own. A NULL source is a source; an empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    own = leaf(*map(F.col, COLUMNS))
    read = docs.select("doc_id", "source", F.unhex(own).alias("leaf"), F.unhex(F.when(tampered != own, tampered)).alias("tampered"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")]
    tree = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))
    leaves = positions(read.select(tree.alias("tree"), "doc_id", "leaf", "tampered"), ["tree"], order)
    idx = F.col("pos") - 1
    entry = F.struct(idx.alias("idx"), "doc_id", "leaf", "tampered")
    runs = settle(
        leaves.groupBy("tree", F.floor(idx / FANOUT).cast("long").alias("run")).agg(F.sort_array(F.collect_list(entry)).alias("leaves"))
    )
    if not runs.take(1):
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    alone = F.expr(ALONE)
    top = F.when(alone, F.col("leaves")[0]["leaf"]).otherwise(F.expr(parent(joined("leaves.leaf"))))
    node = F.when(alone, _node(F.col("tree"), 0, F.lit(0))).otherwise(_node(F.col("tree"), 1, F.col("run")))
    nodes = runs.select("tree", F.col("run").alias("idx"), top.alias("hash"), F.lit(1).cast("long").alias("runs"), node.alias("node"))
    links, ends = _levels(nodes, 2, False)
    subroots = settle(_union(ends).withColumn("name", F.when(F.col("tree") != "n", F.col("tree"))))
    placed = positions(subroots, [], [F.col("name").asc_nulls_first()])
    above, last = _levels(placed.select(F.lit(TOP).alias("tree"), (F.col("pos") - 1).alias("idx"), "hash", "runs", "node"), 1, True)
    root = _union(last).select("node", _hex("hash").alias("hash")).first()
    every = _union(links + above)
    # One copy of a link for each RUNS_PER_LINK runs below it.
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("below") / RUNS_PER_LINK).cast("long") - 1))
    salted = settle(every.select("node", copies.alias("salt"), "parent", "salts", "before", "after", "subroot"))
    before, after = _between("leaves.leaf", "i")
    mine = "coalesce(l.tampered, l.leaf)"
    first = f"transform(leaves, (l, i) -> if({ALONE}, {mine}, {parent(f'concat({before}, {mine}, {after})')}))"
    folded = settle(runs.select("tree", "run", "leaves", node.alias("node"), F.expr(first).alias("each")))
    ready = folded.select("tree", "run", "node", F.lit(0).cast("long").alias("salt"), F.array_distinct("each").alias("folds"))
    at = root["node"]
    with _unlimited(spark):
        climb = spark.sql(CLIMB, runs=ready, links=salted)
        ended = [F.col(f"node.{part}") == at[part] for part in ("tree", "level", "idx")]
        climbed = settle(climb.filter(ended[0] & ended[1] & ended[2]).select("tree", "run", "folds", "proof", "subroot"))
    place = F.transform("each", lambda x: F.array_position(F.array_distinct("each"), x).cast("int"))
    carried = folded.select("tree", "run", "leaves", place.alias("place")).join(climbed, ["tree", "run"])
    each = carried.select("leaves", "place", "folds", "proof", "subroot", F.posexplode("leaves").alias("i", "own"))
    top = _hex(F.element_at("folds", F.element_at("place", F.col("i") + 1)))
    return each.select(
        F.col("own.doc_id").alias("doc_id"),
        _hex("own.leaf").alias("leaf"),
        F.coalesce(_hex("subroot"), F.lit(root["hash"])).alias("subroot"),
        F.lit(root["hash"]).alias("root"),
        F.sha2(_hex(F.expr(f"concat({before}, {after}, proof)")), 256).alias("proof_sha256"),
        top.alias("folded_root"),
        (top == F.lit(root["hash"])).alias("verified"),
    )
