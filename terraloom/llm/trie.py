"""Prefix trie of conversations, with totals over subtrees by centroid decomposition.

A node is a distinct sequence of first turns; the conversations that begin with it are its members. Its key is its depth
and the exclusive-or of hashes of (place, turn) along the way, a running aggregate, so that a conversation of any length is
cut into ranges. The smallest member and the depth name a node: the members of a node's child are members of the node.

Totals over subtrees (`rollup`): the forest of parent edges is split at centroids, by the number of member rows below a
node, which the grouping of nodes gives for nothing. In each round every component of more than `block` nodes finds its
centroid, adds the total of what lies at and under it to each node from the centroid to the component's top, and
falls apart into the part above and one component for each child; half of the weight is gone from each, so that rounds are
logarithmic. Ancestors are not climbed to but looked up: the ancestor of a node at depth d is the node at place d of the
node's smallest member. Components of at most `block` nodes are split further within a task, in the same way.

Edge cases: null roles and texts are empty; null turns come first; rows that tie in their turn are ordered by a digest of role
and text; repeated rows are turns of their own; rows without a conversation id take no part; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import materialize
from terraloom.operators.ranks import running

#: nodes of a component that one task takes
BLOCK = 8192
#: ids hashed as one row: 2**12 of them at most
CHUNK_BITS = 12


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, `pos` (from 1), `digest` of role and text, `chars` of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    return running(rows, ["conv_id"], ["turn", "digest"], place="pos").drop("turn")


def with_borrowed_heads(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the first conversation of their group; h = crc32(id) mod `most`.

    A group is the ids with the same id - id % group; at most most - 1 turns are borrowed by at most 2 * group conversations.
    Adds `length`, the turns of the rebuilt conversation; one without any has a single row with pos 0.
    """
    c = F.col("conv_id")
    head, first = F.crc32(c.cast("string")) % most, c - c % group
    heads = rows.where((c % group == 0) & (F.col("pos") < most)).select(c.alias("first"), "pos", "digest", "chars")
    found = heads.groupBy("first").agg(F.count("*").alias("found"))
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", head.alias("h"), first.alias("first"))
    own = own.join(found, "first", "left").withColumn("k", F.least("h", F.coalesce("found", F.lit(0))))
    own = materialize(own.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-conversations")
    borrowed = own.join(heads, "first").where("pos <= h").select("conv_id", "pos", "digest", "chars", "length")
    kept = rows.join(own.where("n > h").select("conv_id", "h", "k", "length"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "chars", "length")
    return borrowed.unionByName(kept).unionByName(own.where("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("chars"), "length"))


def with_length(rows: DataFrame) -> DataFrame:
    """Conversations as they are, with their `length`."""
    return rows.join(rows.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id").select("conv_id", "pos", "digest", "chars", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """For each conversation and place from 0 on the key of its prefix (`a`, `b`) and of the prefix before it (`pa`, `pb`)."""
    some = rows.where("pos > 0")
    hashed = some.select("*", *[F.xxhash64(F.lit(k), "pos", "digest").alias(f"f{k}") for k in (1, 2)])
    keyed = running(hashed, ["conv_id"], ["pos"], a=("bit_xor", "f1"), b=("bit_xor", "f2"))
    keyed = keyed.select("conv_id", "pos", "chars", "length", "a", "b", F.col("a").bitwiseXOR(F.col("f1")).alias("pa"), F.col("b").bitwiseXOR(F.col("f2")).alias("pb"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("pos", "chars")], [F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "pa", "pb")]
    start = rows.where("pos = 1 or length = 0").select("conv_id", *zero[0], "length", *zero[1])
    return materialize(keyed.unionByName(start), "trie-prefixes")


def _ends(keyed: DataFrame) -> DataFrame:
    """Per node key the SHA-256 of the ids of the conversations that end there, ascending, joined by commas.

    Ids go in rows of up to 2**CHUNK_BITS; a digest is sequential, but one task reads those rows as a stream.
    """
    last = keyed.where("pos = length").select("pos", "a", "b", "conv_id", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    chunks = last.groupBy("pos", "a", "b", "chunk").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pack(out)
        if now is not None:
            yield pack([(*now, digest.hexdigest())])

    def pack(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["pos", "a", "b", "ends_sha256"])

    dealt = chunks.repartition("pos", "a", "b").sortWithinPartitions("pos", "a", "b", "chunk").select("pos", "a", "b", "ids")
    return dealt.mapInArrow(run, "pos long, a long, b long, ends_sha256 string")


def nodes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, `chars` of the last turn, `weight`, ends_sha256), and

    where ancestors are looked up: the node (`rep`) at each place (`pos`) of each smallest member (`conv_id`), and the one before it
    (`prep`). weight is the member rows at and under a node.
    """
    stats = keyed.groupBy("pos", "a", "b").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.sum(F.col("length") - F.col("pos") + 1).alias("weight")
    )
    stats = materialize(stats.join(_ends(keyed), ["pos", "a", "b"], "left"), "trie-stats")
    reps = stats.select(F.col("rep").alias("conv_id")).distinct()
    way = materialize(keyed.join(reps, "conv_id", "left_semi").join(stats.select("pos", "a", "b", "rep"), ["pos", "a", "b"]).select("conv_id", "pos", "rep"), "trie-way")
    ahead = way.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("rep").alias("prep"))
    way = materialize(way.join(ahead, ["conv_id", "pos"], "left"), "trie-lookup")
    own = way.where("conv_id = rep").select("rep", "pos", "prep").join(stats.drop("a", "b"), ["rep", "pos"])
    children = way.where("conv_id = rep and pos > 0").groupBy(F.col("prep").alias("rep"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_children"))
    out = own.join(children, ["rep", "pos"], "left").select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("prep").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        "chars", "weight", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    return materialize(out, "trie-nodes"), way


def split_at_centroids(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Totals over subtrees of one component: parents come before children, the first node is the top (its parent isn't read)."""
    n = len(parent)
    sums = [[0] * n for _ in values]
    size, branch = [0] * n, [-1] * n
    todo = [list(range(n))]
    while todo:
        part = todo.pop()
        top, total = part[0], len(part)
        for i in part:
            size[i], branch[i] = 1, -1
        centroid = top
        for i in reversed(part):
            if 2 * size[i] >= total:
                centroid = i  # children come later, so this is the deepest one
                break
            size[parent[i]] += size[i]
        below: dict[int, list[int]] = {}
        above = []
        for i in part:
            if i == centroid:
                continue
            up = parent[i] if i != top else -1
            mine = i if up == centroid else branch[up] if up >= 0 else -1
            if mine >= 0:
                branch[i] = mine
                below.setdefault(mine, []).append(i)
            else:
                above.append(i)
        for own, out in zip(values, sums, strict=True):
            total = own[centroid] + sum(own[i] for members in below.values() for i in members)
            i = centroid
            while True:
                out[i] += total
                if i == top:
                    break
                i = parent[i]
        if above:
            todo.append(above)
        todo.extend(below.values())
    return sums


def _within_tasks(parts: DataFrame, values: list[str]) -> DataFrame:
    """The rest of the rollup for components of bounded size; a task holds one at a time."""
    k = len(values)

    def solve(rows: list[tuple]) -> list[tuple]:
        at = {(r[2], r[3]): i for i, r in enumerate(rows)}
        parent = [at.get((r[4], r[3] - 1), -1) for r in rows]
        sums = split_at_centroids(parent, [[r[5 + j] for r in rows] for j in range(k)])
        return [(r[2], r[3], *[r[5 + k + j] + sums[j][i] for j in range(k)]) for i, r in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != now:
                    if held:
                        out += solve(held)
                    now, held = row[:2], []
                held.append(row)
            if out:
                yield pack(out)
        if held:
            yield pack(solve(held))

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["rep", "pos", *values])

    dealt = parts.repartition("top", "top_pos").sortWithinPartitions("top", "top_pos", "pos").select("top", "top_pos", "rep", "pos", "prep", *values, *[f"sum_{c}" for c in values])
    return dealt.mapInArrow(run, ", ".join(["rep long", "pos long", *[f"{c} long" for c in values]]))


def rollup(tree: DataFrame, way: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """conv_id, depth, and the totals of the `values` (long, not null) over each node's subtree, the node included."""
    root = tree.where("depth = 0").select(F.col("conv_id").alias("top"))
    state = tree.select(
        F.col("conv_id").alias("rep"), F.col("depth").alias("pos"), F.col("parent_conv_id").alias("prep"), "weight", *values, *[F.lit(0).cast("bigint").alias(f"sum_{c}") for c in values], F.lit(0).cast("bigint").alias("top_pos")
    ).join(F.broadcast(root), F.lit(True))  # one row
    done, ready = [], []
    comp = ["top", "top_pos"]
    while True:
        sizes = materialize(state.groupBy(*comp).agg(F.count("*").alias("size"), F.max("weight").alias("total")).where(F.col("size") > block), "trie-large")
        if not sizes.take(1):
            ready.append(state)
            break
        ready.append(state.join(sizes, comp, "left_anti"))
        large = state.join(sizes.drop("size"), comp)
        centroid = F.min_by(F.struct("rep", "pos", "weight"), "weight")
        found = large.where(2 * F.col("weight") >= F.col("total")).groupBy(*comp).agg(centroid.alias("c"))
        found = materialize(found.select(*comp, F.col("c.rep").alias("c_rep"), F.col("c.pos").alias("c_pos"), F.col("c.weight").alias("c_weight")), "trie-centroids")
        upward = way.join(found.select("c_rep", "c_pos", "top_pos"), way["conv_id"] == F.col("c_rep")).where("pos between top_pos and c_pos")
        upward = upward.select("rep", "pos", F.lit(True).alias("on_way"))
        under = way.select(F.col("conv_id").alias("rep"), F.col("pos").alias("b_pos"), F.col("rep").alias("b_rep"), F.col("prep").alias("b_prep"))
        marked = large.drop("total").join(found, comp).join(upward, ["rep", "pos"], "left")
        marked = marked.withColumn("b_pos", F.when(F.col("pos") > F.col("c_pos"), F.col("c_pos") + 1)).join(under, ["rep", "b_pos"], "left")
        marked = marked.withColumn("below", F.coalesce(F.col("b_prep") == F.col("c_rep"), F.lit(False))).withColumn("itself", (F.col("rep") == F.col("c_rep")) & (F.col("pos") == F.col("c_pos")))
        marked = materialize(marked, "trie-split")
        totals = marked.where("below or itself").groupBy(*comp).agg(*[F.sum(c).alias(f"all_{c}") for c in values])
        moved = marked.join(totals, comp).withColumn("on_way", F.coalesce("on_way", F.lit(False)))
        moved = moved.select(
            "rep", "pos", "prep", "itself", (F.col("weight") - F.when(F.col("on_way"), F.col("c_weight")).otherwise(0)).alias("weight"), *values,
            *[(F.col(f"sum_{c}") + F.when(F.col("on_way"), F.col(f"all_{c}")).otherwise(0)).alias(f"sum_{c}") for c in values],
            F.when(F.col("below"), F.col("b_rep")).otherwise(F.col("top")).alias("top"), F.when(F.col("below"), F.col("b_pos")).otherwise(F.col("top_pos")).alias("top_pos"),
        )
        moved = materialize(moved, "trie-parts")
        done.append(moved.where("itself").select("rep", "pos", *[F.col(f"sum_{c}").alias(c) for c in values]))
        state = moved.where("not itself").drop("itself")
    rest = ready[0].select(*ready[-1].columns)
    for part in ready[1:]:
        rest = rest.unionByName(part)
    out = _within_tasks(rest, values)
    for part in done:
        out = out.unionByName(part)
    return out.withColumnsRenamed({"rep": "conv_id", "pos": "depth"})


def summary(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, pos, digest, chars, length), root included."""
    tree, way = nodes(prefixes(rows))
    valued = tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    totals = rollup(valued, way, ["n_leaves", "saved_tokens"], block)
    return tree.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
