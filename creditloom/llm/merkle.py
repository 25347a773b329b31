"""Merkle manifest of a table: a 16-ary hash tree over the rows of each source, and one over the sources' roots.

A superblock is 4,096 neighbouring nodes of a tree, which are three rounds of hashing.  Going up, every superblock is folded to
its one node, and these nodes are the leaves of the next, 4,096 times smaller table, until every tree is one node.  Going
down, the siblings outside a superblock (its outer nodes, at most fifteen for each round above it) are handed from table to
table.  At the bottom the leaves and the outer nodes are cogrouped by superblock, and one function reduces the superblock
again, joins each leaf's proof and folds its altered leaf along that proof.  No task sees more than a few superblocks, however
many rows a source has.

Rows are placed in their tree by a range partitioning with running counts, whose last key is a written row number, so that a
source, a doc_id or a repeated row of any size is spread over tasks.

Defined results: NULL columns count as ``-`` (empty ones as ``0:``); rows without doc_id come first and are never altered;
equal rows are neighbours with equal leaves and proofs of their own; a source of one row has its leaf as root; an empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, written

FAN = 16
HEIGHT = 3
BLOCK = FAN**HEIGHT
#: Rows of a range partition, and leaves that share a call of the cogrouped function, about.
PART_ROWS, CALL_ROWS = 2_000_000, 2 * BLOCK
TOP = 100  # rounds above the sources are numbered from here
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = "key string, pos long, step int, before string, after string"
PROOFS = "id long, no_id boolean, leaf string, subroot string, proof_sha256 string, folded_root string"


def leaf_of(fields: list[Column]) -> Column:
    """Hash of fields, each as its UTF-8 byte count, a colon and its value, or ``-`` for NULL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def rounds_of(n: Column) -> Column:
    """Rounds of hashing that turn n nodes into one."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(FAN - 1)), F.lit(0))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos`` (from 0) within ``key`` by ``order``, and the key's number of rows ``n``.

    Partitions hold ranges of (key, order, written row number); places inside them are running numbers, and a table of
    counts by partition and key shifts them.
    """
    spark = rows.sparkSession
    kept = written(rows.withColumn("salt", F.monotonically_increasing_id()), "nodes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // PART_ROWS))
    by = ["key", *order, "salt"]
    dealt = kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    dealt = written(dealt.drop("salt").withColumn("part", F.shiftright("place", 33)), "ranges")
    runs = dealt.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("many"))
    earlier = F.sum("many").over(Window.partitionBy("key").orderBy("part")) - F.col("many")
    runs = runs.select("key", "part", (earlier - F.col("first")).alias("shift"), F.sum("many").over(Window.partitionBy("key")).alias("n"))
    return dealt.join(runs, ["key", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def block_of(pos: Column) -> Column:
    return F.shiftright(pos, (BLOCK - 1).bit_length())


def folded_blocks(nodes: DataFrame) -> DataFrame:
    """One node per superblock: its nodes in order, hashed in runs of 16 for up to three rounds."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
    blocks = nodes.groupBy("key", "n", block_of(F.col("pos")).alias("block")).agg(inside.alias("inside"))
    rounds = F.slice(F.sequence(F.lit(1), F.lit(HEIGHT)), F.lit(1), F.least(rounds_of(F.col("n")), F.lit(HEIGHT)))

    def hashed(nodes: Column, _: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FAN + 1, FAN)).cast("binary"), 256))

    last = F.aggregate(rounds, F.col("inside"), hashed)
    return blocks.select("key", F.col("block").alias("pos"), (block_of(F.col("n") - 1) + 1).alias("n"), F.element_at(last, 1).alias("digest"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (key, pos, n, digest), each of one node per superblock of the one before; the last has the roots."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        tables.append(written(folded_blocks(tables[-1]), "blocks"))
        if most <= BLOCK:
            return tables
        most = -(-most // BLOCK)


def sha(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def sides_of(nodes: list[bytes], rounds: int):
    """For each round the siblings before and after every node of a superblock, joined; and the node that remains."""
    out = []
    for _ in range(rounds):
        level = []
        for i in range(0, len(nodes), FAN):
            run = nodes[i : i + FAN]
            level += [(b"".join(run[:j]), b"".join(run[j + 1 :])) for j in range(len(run))]
        out.append(level)
        nodes = [sha(b"".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
    return out, nodes[0]


def depth(n: int) -> int:
    rounds = 0
    while FAN**rounds < n:
        rounds += 1
    return rounds


def superblocks(nodes, outer):
    """Key, first position, rows, local sides, remaining node and outer steps of each superblock of a cogroup."""
    nodes = nodes.sort_values(["key", "pos"], kind="stable")
    above: dict = {}
    for key, pos, step, before, after in outer.sort_values("step").itertuples(index=False):
        above.setdefault((key, pos), []).append((step, before.encode(), after.encode()))
    for (key, block), rows in nodes.groupby(["key", nodes["pos"] // BLOCK], sort=False):
        rounds = min(HEIGHT, depth(int(rows["n"].iloc[0])))
        local, last = sides_of([d.encode() for d in rows["digest"]], rounds)
        yield key, int(block) * BLOCK, rows, local, last, above.get((key, int(block)), [])


def handed_down(nodes: DataFrame, outer: DataFrame, step: int, buckets: int) -> DataFrame:
    """Sides of every node: those inside its superblock, numbered from ``step``, then those of the superblock."""

    def run(nodes, outer):
        import pandas as pd

        out = []
        for key, start, rows, local, _, above in superblocks(nodes, outer):
            for i in range(len(rows)):
                for r, level in enumerate(local):
                    before, after = level[i // FAN**r]
                    out.append((key, start + i, step + r, before.decode(), after.decode()))
                out += [(key, start + i, s, b.decode(), a.decode()) for s, b, a in above]
        return pd.DataFrame(out, columns=["key", "pos", "step", "before", "after"])

    return cogrouped(nodes.select("key", "pos", "n", "digest"), outer, buckets).applyInPandas(run, SIDES)


def cogrouped(nodes: DataFrame, outer: DataFrame, buckets: int):
    """Nodes and outer nodes by superblock; small superblocks share a group."""
    place = lambda block: F.pmod(F.xxhash64("key", block), F.lit(buckets))
    left = nodes.groupBy(place(block_of(F.col("pos"))).alias("bucket"))
    return left.cogroup(outer.groupBy(place(F.col("pos")).alias("bucket")))


def proven(leaves: DataFrame, outer: DataFrame, buckets: int) -> DataFrame:
    """Proof, subroot and folded root of every leaf."""

    def run(leaves, outer):
        import pandas as pd

        out = []
        for _, _, rows, local, last, above in superblocks(leaves, outer):
            subroot = last
            for step, before, after in above:
                subroot = sha(before + subroot + after) if step < TOP else subroot
            outside = b"".join(b + a for _, b, a in above)
            values = rows[["doc_id", "no_id", "digest", "altered"]].itertuples(index=False)
            for i, (doc_id, no_id, leaf, altered) in enumerate(values):
                steps = [level[i // FAN**r] for r, level in enumerate(local)]
                node = (altered or leaf).encode()
                for before, after in steps:
                    node = sha(before + node + after)
                for _, before, after in above:
                    node = sha(before + node + after)
                proof = sha(b"".join(b + a for b, a in steps) + outside)
                out.append((doc_id, no_id, leaf, subroot.decode(), proof.decode(), node.decode()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PROOFS.split(", ")])

    doc_id, altered = F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("altered", F.lit("")).alias("altered")
    shown = leaves.select("key", "pos", "n", "digest", altered, doc_id, F.col("doc_id").isNull().alias("no_id"))
    return cogrouped(shown, outer, buckets).applyInPandas(run, PROOFS)


def no_sides(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SIDES)


def descended(tables: list[DataFrame], outer: DataFrame, first: int) -> DataFrame:
    """Outer nodes of the superblocks of the lowest table, from those of the roots."""
    for height in range(len(tables) - 2, 0, -1):
        outer = written(handed_down(tables[height], outer, first + HEIGHT * height, calls(tables[height])), "outer")
    return outer


def calls(nodes: DataFrame) -> int:
    return max(1, -(-nodes.count() // CALL_ROWS))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """For each row its leaf, its source's root, the root of all, its proof's hash, and the check of an altered copy.

    ``altered`` says which rows are altered before the check (A-Z of their text lowered).  The tree stays that of the
    unaltered rows.
    """
    changed = F.coalesce(altered, F.lit(False)) if altered is not None else F.lit(False)
    fields = [F.col(c) for c in FIELDS]
    other = leaf_of([*fields[:-1], F.translate("text", UPPER, LOWER)])
    source = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = docs.select("doc_id", source.alias("key"), leaf_of(fields).alias("digest"), F.when(changed, other).alias("altered"))
    trees = climbed(written(numbered(leaves, ["doc_id", "digest"]), "leaves"))
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    subroots = written(numbered(subroots, ["name"]), "subroots")
    over = climbed(subroots)
    root = over[-1].select("digest").first()
    above = handed_down(over[0], descended(over, no_sides(docs), TOP), TOP, calls(over[0]))
    named = above.join(subroots.select("pos", "name"), "pos")
    outer = written(named.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "step", "before", "after"), "outer")
    found = proven(trees[0], descended(trees, outer, 0), calls(trees[0]))
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    top = F.lit(root.digest if root else None).cast("string")
    return found.select(
        doc_id, "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified")
    )


def every_fifth(doc_id: Column) -> Column:
    """Where 5 divides the crc32 of the decimal doc_id; never for NULL."""
    return doc_id.isNotNull() & (crc_mod(doc_id, 5) == 0)
