"""A Merkle manifest of a dataset, and the proof of each of its rows.

Each row is a leaf. Leaves of a group stand in order; runs of ``fanout`` consecutive nodes become
their digest until one is left, and the groups' roots, in order of the group, fold the same way
into the root. Nothing but digests and keys is shuffled.

The tree is rolled up in blocks of ``fanout ** levels`` consecutive nodes. A node's rank in its
group is written as digits, one column each; the digits are grouped away one after the other,
and each grouping nests the structs of its children in that of their parent, so that a block ends
as one row that holds its whole subtree. All groupings of a block share one partitioning. The
blocks' roots are the nodes of the next round. On the way back a block's row meets the proof of
its root (rows of both kinds are grouped by block), and one transform and explode give its nodes'
proofs. A block has a fixed size, so a group that holds all rows is only more blocks.

Defined cases: nulls are `-`; rows of a group are in order of the id, null ids first, then of the
leaf; repeated rows are leaves of their own, whose places are interchangeable; a null group comes
first; a lone leaf is its group's root, and a lone group's root is the root; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbtrail.llm.common import fold, table, written

_PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as it enters a leaf: its length in bytes and itself, or a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _runs_above(n: Column, by: int) -> Column:
    """How many nodes stand above n of them, by so many to one."""
    return F.floor((n + (by - 1)) / by).cast("long")


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes, written, with ``rank`` (from 0) within the group g_ in the given order and ``n``, the group's size.

    Sorted ranges are numbered one by one; where each begins follows from one row for each range and group.
    """
    spark = nodes.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ["g_", *order]]
    # Rows that are equal in all keys spread over ranges by their place in the table, which a second run does not change.
    spread = nodes.withColumn("tie_", F.monotonically_increasing_id())
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = spread.repartitionByRange(ranges, *keys, "tie_").sortWithinPartitions(*keys, "tie_").drop("tie_")
    placed = written(placed.withColumn("at_", F.monotonically_increasing_id()), name)
    part = F.shiftright("at_", 33)
    runs = placed.groupBy("g_", part.alias("part_")).agg(F.min("at_").alias("first_"), F.count("*").alias("here_"))
    whole = Window.partitionBy("g_")
    before = F.coalesce(F.sum("here_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(F.col("g_").alias("rg_"), "part_", (before - F.col("first_")).alias("shift_"), F.sum("here_").over(whole).alias("n")), name + "-runs")
    # One row for each range and each group: few enough to send along, or else a join by both.
    small = F.broadcast(runs) if runs.count() <= 100_000 else runs
    met = placed.join(small, F.col("g_").eqNullSafe(F.col("rg_")) & (part == F.col("part_")))
    return met.withColumn("rank", F.col("at_") + F.col("shift_")).drop("rg_", "part_", "shift_", "at_")


def rolled(nodes: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """A row (g_, block, n, node) for each block of nodes (g_, rank, n, h, own), written. node is a struct of the root's h
    and its kids: structs of a digit and the node below, down to nodes of h and own."""
    size = fanout**levels
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    digits = [F.expr(f"cast(rank div {fanout**k} % {fanout} as int)").alias(f"d{k}") for k in range(levels)]
    df = nodes.select("g_", "n", F.expr(f"rank div {size}").alias("block"), *digits, F.struct("h", "own").alias("node"))
    df = df.repartition(parts, "g_", "block")
    for k in range(levels):
        left = [f"d{i}" for i in range(k + 1, levels)]
        df = df.groupBy("g_", "n", "block", *left).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node"))).alias("kids"))
        # Where one node is left in its group, it is the root and goes up as it is.
        up = F.when(_runs_above(F.col("n"), fanout**k) > 1, digest(F.array_join(F.transform("kids", lambda x: x.node.h), ""))).otherwise(F.col("kids")[0].node.h)
        df = df.select("g_", "n", "block", *left, F.struct(up.alias("h"), "kids").alias("node"))
    return written(df, name)


def proofs(blocks: DataFrame, up: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes of blocks with their proofs: g_, own, up.

    up: a row (g_, block, up) for each block, up a struct whose ``path`` is the proof of the block's root, of structs of the
    digests left and right of it, level by level; other fields of up are handed on.
    """
    fields = [f.name for f in up.schema["up"].dataType if f.name != "path"]
    both = blocks.select("g_", "block", "n", "node", F.lit(None).cast(up.schema["up"].dataType).alias("up")).unionByName(
        up.select("g_", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["node"].dataType).alias("node"), "up")
    )
    met = both.groupBy("g_", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "up")])

    def below(node: Column, path: Column, k: int) -> Column:
        """An array of (own, path) of all that stands below a node at level k."""
        if k == 0:
            return F.array(F.struct(node.own.alias("own"), path.alias("path")))
        kids = node.kids
        side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda y: y.node.h), "")

        def one(x: Column) -> Column:
            step = F.array(F.struct(side(lambda y: y.d < x.d).alias("left"), side(lambda y: y.d > x.d).alias("right")))
            # The root of its group is no one's child.
            here = F.when(_runs_above(F.col("n"), fanout ** (k - 1)) > 1, step).otherwise(F.array().cast(_PATH))
            return below(x.node, F.concat(here, path), k - 1)

        return F.flatten(F.transform(kids, one))

    nodes = met.select("g_", "up", F.explode(below(F.col("node"), F.col("up.path"), levels)).alias("x"))
    return nodes.select("g_", F.col("x.own").alias("own"), F.struct(F.col("x.path").alias("path"), *[F.col("up").getField(f).alias(f) for f in fields]).alias("up"))


class Tree:
    """Trees over nodes (g_, rank, n, h, own), one for each g_, with the rows of every round of blocks written."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int, name: str) -> None:
        self.fanout, self.levels, self.rounds = fanout, levels, []
        while True:
            self.rounds.append(rolled(nodes, fanout, levels, f"{name}-{len(self.rounds)}"))
            roots = self.rounds[-1].select("g_", F.col("block").alias("rank"), _runs_above(F.col("n"), fanout**levels).alias("n"), F.col("node.h").alias("h"))
            if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
                self.tops = roots.select("g_", "h")
                return
            nodes = roots.withColumn("own", F.struct("rank"))

    def proofs(self, up: DataFrame) -> DataFrame:
        """(g_, own, up) of every node. up: (g_, up) for each tree, see proofs()."""
        up = up.withColumn("block", F.lit(0).cast("long"))
        for i, blocks in enumerate(reversed(self.rounds)):
            out = proofs(blocks, up, self.fanout, self.levels)
            if i + 1 == len(self.rounds):
                return out
            up = out.select("g_", F.col("own.rank").alias("block"), "up")
        raise AssertionError("a tree has at least one round")


def manifest(leaves: DataFrame, *, group: str = "lang", order: str = "doc_id", fanout: int = 2, levels: int = 6) -> DataFrame:
    """leaves (with ``leaf``, hexadecimal digests) with subroot, root and path added: the path is an array of structs of the
    digests left and right of the node, from the leaf's run up to the root's."""
    names = leaves.columns
    nodes = leaves.select(F.col(group).alias("g_"), F.col(order).alias("o_"), F.col("leaf").alias("h"), F.struct(*names).alias("own"))
    ordered = ranked(written(nodes, "leaves"), ["o_", "h"], "leaves-ordered")
    groups = Tree(ordered, fanout, levels, "blocks")
    subroots = groups.tops.select(F.lit(0).alias("g_"), F.col("g_").alias("o_"), "h", F.struct(F.col("g_").alias("g"), F.col("h").alias("subroot")).alias("own"))
    top = Tree(ranked(subroots, ["o_"], "subroots"), fanout, levels, "top")
    whole = top.proofs(top.tops.select("g_", F.struct(F.array().cast(_PATH).alias("path"), F.col("h").alias("root")).alias("up")))
    up = whole.select(F.col("own.g").alias("g_"), F.struct(F.col("up.path").alias("path"), F.col("own.subroot").alias("subroot"), F.col("up.root").alias("root")).alias("up"))
    done = groups.proofs(written(up, "subroot-proofs"))
    return done.select(*[F.col("own").getField(c).alias(c) for c in names], F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"), F.col("up.path").alias("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, start, lambda h, x: digest(F.concat(x.left, h, x.right)))


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    values = {c: F.col(c) for c in FIELDS}
    tampered = leaf(list((values | {"n_chars": F.col("n_chars") + 1}).values()))
    leaves = docs.select("lang", "doc_id", leaf(list(values.values())).alias("leaf"), F.when(fold(F.col("doc_id"), 7) == 0, tampered).alias("changed"))
    proved = manifest(leaves)
    proved = proved.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _value(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


_LEAF = " || ".join(_value(c) for c in FIELDS)
_CHANGED = " || ".join(_value("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)


def _sql_crc32() -> str:
    """crc32 of the decimal id, by its definition, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for_byte = "c"
    for _ in range(8):
        for_byte = f"list_transform([{for_byte}], lambda c: {step})[1]"
    codes = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda a, b: list_transform([xor(a, b)], lambda c: {for_byte})[1]), 4294967295)"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT lang AS g, doc_id, sha256({_LEAF}) AS leaf, sha256({_CHANGED}) AS changed, {_sql_crc32()} AS crc,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM documents
), nodes AS (
  SELECT g, 0 AS level, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY g, level, idx // 2
), subroots AS (
  SELECT g, h AS subroot, level AS depth, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, idx // 2
), folds AS (
  SELECT g, doc_id, idx, 0 AS level, idx AS at, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS h, '' AS sibs FROM leaves
  UNION ALL
  SELECT f.g, f.doc_id, f.idx, f.level + 1, f.at // 2, f.leaf,
         sha256(CASE WHEN f.at % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.sibs || coalesce(s.h, '')
  FROM folds f JOIN subroots r ON f.g IS NOT DISTINCT FROM r.g
  LEFT JOIN nodes s ON s.g IS NOT DISTINCT FROM f.g AND s.level = f.level AND s.idx = xor(f.at, 1)
  WHERE f.level < r.depth
), sub AS (
  SELECT f.*, r.subroot, r.idx AS place FROM folds f JOIN subroots r ON f.g IS NOT DISTINCT FROM r.g AND f.level = r.depth
), tops AS (
  SELECT max(level) AS depth, max_by(h, level) AS root FROM upper
), climbs AS (
  SELECT g, doc_id, idx, leaf, subroot, 0 AS level, place AS at, h, sibs FROM sub
  UNION ALL
  SELECT c.g, c.doc_id, c.idx, c.leaf, c.subroot, c.level + 1, c.at // 2,
         sha256(CASE WHEN c.at % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.sibs || coalesce(s.h, '')
  FROM climbs c CROSS JOIN tops LEFT JOIN upper s ON s.level = c.level AND s.idx = xor(c.at, 1)
  WHERE c.level < tops.depth
)
SELECT c.doc_id, c.leaf, c.subroot, tops.root, sha256(c.sibs) AS proof_sha256, c.h AS folded_root, c.h = tops.root AS verified
FROM climbs c JOIN tops ON c.level = tops.depth
"""
