"""Merkle dataset manifest: leaves by group, a tree over each group, a tree over the groups.

Each aligned block of nodes keeps a level of the tree as one hex string (as its ASCII
bytes, of which a fixed-width substring is read without a walk).  Parents are the hashes
of its substrings of two digests, a node's sibling is the substring that flanks it, and
the roots of the blocks are the nodes of the next round.  A block is one small row whatever
the size of its group, so a group that holds most rows costs no task more than another.

Places in a group's order come without a window over the group: rows are dealt by ranges
of (group, order), and a row's place is its place in the task plus the rows of that group
in earlier tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.common import id_hash, ready, saved

#: Characters of a digest.
DIGIT = 64
#: Levels within a block: 2 ** LEVELS nodes.
LEVELS = 10
#: Rows of places of tasks and groups that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(content.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields: ``-`` for a null, else the value's UTF-8 length, ``:`` and the value."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(F.concat(*written))


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` in their group (from 0) and the group's ``n`` rows.

    Rows alike in all of ``order`` are dealt over tasks by a number of their own.
    """
    numbered = saved(rows).withColumn("tie", F.monotonically_increasing_id())
    keys = [group, *order, "tie"]
    ranged = saved(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    shares = ranged.groupBy(F.col(group).alias("g"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("share"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = saved(shares.select(
        "g", "part", (F.coalesce(F.sum("share").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("share").over(Window.partitionBy("g")).alias("n"),
    ))
    small = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    found = ranged.withColumn("here", part).join(small, F.col(group).eqNullSafe(F.col("g")) & (F.col("here") == F.col("part")))
    return found.withColumn("place", F.col("at") + F.col("shift")).drop("tie", "at", "here", "g", "part", "shift")


def _parents(level: Column) -> Column:
    """The next level: a digest for each two digests, or for a lone last one."""
    pairs = F.sequence(F.lit(0), ((F.length(level) + (2 * DIGIT - 1)) / (2 * DIGIT)).cast("int") - 1)
    return F.array_join(F.transform(pairs, lambda i: F.sha2(F.substring(level, i * (2 * DIGIT) + 1, F.lit(2 * DIGIT)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """Aligned blocks of ``nodes`` (group, place, n, hash, carried columns), each with its ``levels``.

    A group's only block ends at the group's root; every other one goes up LEVELS times.
    """
    block = F.shiftright("place", LEVELS).alias("block")
    held = nodes.groupBy(group, block, "n").agg(F.array_sort(F.collect_list(F.struct("place", "hash", *carried))).alias("nodes"))
    tall = F.when(F.col("n") <= (1 << LEVELS), F.length(F.bin(F.col("n") * 2 - 1)) - 1).otherwise(LEVELS)
    first = F.array_join(F.col("nodes")["hash"], "").cast("binary")
    rounds = F.when(F.col("tall") > 0, F.sequence(F.lit(1), F.col("tall"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(rounds, F.array(first), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    return held.withColumn("tall", tall.cast("int")).withColumn("levels", levels).drop("tall")


def _flanks(levels: Column, place: Column) -> Column:
    """A node's siblings, level by level: ``left`` and ``right`` of it, empty where there is none."""
    inside = place.bitwiseAND(F.lit((1 << LEVELS) - 1)).cast("int")
    at = lambda level, i: F.substring(level, i * DIGIT + 1, F.lit(DIGIT))

    def flank(level: Column, j: Column) -> Column:
        i = F.floor(inside / F.pow(F.lit(2), j)).cast("int")
        odd, none = i % 2 == 1, F.lit("").cast("binary")
        return F.struct(F.when(odd, at(level, i - 1)).otherwise(none).alias("left"), F.when(odd, none).otherwise(at(level, i + 1)).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), flank)


STEPS = "array<struct<left:binary,right:binary>>"


def build(nodes: DataFrame, group: str, order: list[str]) -> list[DataFrame]:
    """The blocks of a tree over each group's ``nodes``, round by round.

    ``nodes`` hold the group, ``hash`` and what else is to be kept; a group may be null and
    of any size.  Blocks of the last round hold one whole group each, so they end in its root.
    """
    placed, kept = _placed(nodes, group, order), [c for c in nodes.columns if c not in (group, "hash")]
    rounds = [saved(_blocks(placed, group, kept))]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    size = 1 << LEVELS
    while most > size:
        most = -(-most // size)
        left = F.shiftright((F.col("n") + (size - 1)).cast("long"), LEVELS)
        placed = rounds[-1].select(group, F.col("block").alias("place"), left.alias("n"), F.element_at("levels", -1).cast("string").alias("hash"))
        rounds.append(saved(_blocks(placed, group, [])))
    return rounds


def roots(rounds: list[DataFrame], group: str) -> DataFrame:
    """One row a group: the group and its tree's root, as ``hash``."""
    return rounds[-1].select(group, F.element_at("levels", -1).cast("string").alias("hash"))


def paths(rounds: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """The nodes of the first round with the columns of ``above`` and their ``steps`` (see :func:`fold`).

    ``above`` has a row for each group: the group, ``steps`` of its root in what lies above
    it, and columns to hand down.  Each round joins blocks, never leaves.
    """
    handed = [c for c in above.columns if c not in (group, "steps")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for at, blocks in reversed([*enumerate(rounds)]):
        up = above.select(F.col(group).alias("g"), F.col("block").alias("b"), *handed, F.col("steps").alias("up"))
        met = blocks.join(up, blocks[group].eqNullSafe(up["g"]) & (blocks["block"] == up["b"]))
        one = met.select(group, "levels", *handed, "up", F.explode("nodes").alias("node"))
        steps = F.concat(_flanks(F.col("levels"), F.col("node.place")), "up").alias("steps")
        own = [c for c in blocks.schema["nodes"].dataType.elementType.names if c != "place"]
        above = one.select(group, F.col("node.place").alias("block"), *[F.col(f"node.{c}").alias(c) for c in own] if at == 0 else [], *handed, steps)
    return above.drop("block")


def fold(hashed: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(steps, hashed, lambda acc, s: F.sha2(F.concat(s["left"], acc.cast("binary"), s["right"]), 256))


def proof(steps: Column) -> Column:
    """All siblings, level by level, left to right, as one hex string."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"]).cast("string")), "")


def manifest(documents: DataFrame, altered: Column | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: ``doc_id`` (the ``order`` column), ``lang`` (the ``group``), ``leaf, subroot, root, steps, altered_leaf``.

    A row's leaf is the digest of its ``fields``.  Each group's leaves ascend by ``order``
    (null first), rows alike in it by leaf; subroots ascend by group (null first).
    ``steps`` are the leaf's siblings up to the root, of which :func:`proof` is written and
    by which :func:`fold` checks a leaf.  ``altered`` (a column over ``documents``) is kept
    as ``altered_leaf``, e.g. the digest of a row as found elsewhere.

    Nulls are values of their own; repeated rows keep a leaf each; texts are hashed whole in
    one pass and never shuffled; columns besides ``fields`` are not read.  An empty table
    gives an empty result.  Leaves, blocks and places are kept in the shared checkpoint folder.
    """
    ready(documents.sparkSession)
    read = documents.select(
        documents[order].alias("doc_id"), documents[group].cast("string").alias("lang"), leaf(*[documents[f] for f in fields]).alias("hash"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered_leaf"),
    )
    rounds = build(read, "lang", ["doc_id", "hash"])
    subroots = roots(rounds, "lang")
    top = build(subroots.withColumn("all", F.lit(0)), "all", ["lang"])
    root = roots(top, "all").select("all", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    groups = paths(top, "all", root).select("lang", "root", F.col("hash").alias("subroot"), "steps")
    return paths(rounds, "lang", groups).select("doc_id", "lang", F.col("hash").alias("leaf"), "subroot", "root", "steps", "altered_leaf")


def one_more_character(documents: DataFrame) -> Column:
    """The leaf as it is if ``n_chars`` is one more, for ids whose crc32 is divisible by 7; else null."""
    fields = [documents[f] + 1 if f == "n_chars" else documents[f] for f in FIELDS]
    return F.when(id_hash(documents["doc_id"]) % 7 == 0, leaf(*fields))
