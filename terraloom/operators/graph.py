"""Lineage: ancestors, cycles, depths, project jobs and step lists.

Reachability goes by doubling: the pairs of nodes that ways of exactly 2^k edges connect come from those of 2^(k-1), and any
number of edges is a sum of powers of two. A graph of depth d takes log2(d) rounds; each is written to the shared folder, so that
lineage stays short and survives lost executors. The pairs at one distance of a forest are at most its nodes; of a dense graph they may
be the square. Sides of joins that grow with the graph are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.sources.storage import written


class Cyclic(ValueError):
    """A graph that must have no cycle has one."""


def _tasks(df: DataFrame, rows: int = 1_000_000) -> int:
    """Tasks for a shuffle of written rows: about so many rows each, so that a task's memory doesn't grow with the graph."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def _edges(edges: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, int]:
    """Distinct edges (a, b) without nulls, and the number of nodes."""
    kept = written(edges.where("id is not null and parent_id is not null").select(F.col("id").alias("a"), F.col("parent_id").alias("b")).distinct(), "graph-edges")
    nodes = kept.select("a").union(kept.select("b")).distinct().count()
    if max_nodes is not None and nodes > max_nodes:
        raise ValueError(f"the graph has {nodes} nodes, more than {max_nodes}")
    return kept, nodes


def _powers(edges: DataFrame, nodes: int) -> tuple[list[DataFrame], bool]:
    """Pairs (a, b) that ways of exactly 1, 2, 4... edges connect, while there are any; and whether a way is longer than all nodes."""
    powers = [edges]
    while powers[-1].take(1):
        if 1 << (len(powers) - 1) >= nodes:
            return powers, True
        last = powers[-1]
        powers.append(written(last.join(last.select(F.col("a").alias("b"), F.col("b").alias("_c")).hint("merge"), "b").select("a", F.col("_c").alias("b")).distinct(), "graph-power"))
    return powers[:-1], False


def lineage(edges: DataFrame, seeds: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """For each seed (`output`, `id`) all nodes that it reaches over edges (id -> parent_id), itself included, with the least `depth`.

    Nulls in edges lead nowhere; null seeds are left out; cycles are walked once. max_nodes: a larger graph is an error.
    """
    kept, nodes = _edges(edges, max_nodes)
    found = written(seeds.where("id is not null").select("output", "id").distinct().withColumn("depth", F.lit(0)), "lineage")
    for k, power in enumerate(_powers(kept, nodes)[0]):
        further = found.join(power.select(F.col("a").alias("id"), "b").hint("merge"), "id").select("output", F.col("b").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        found = written(found.unionByName(further).repartition(2 * _tasks(found), "output", "id").groupBy("output", "id").agg(F.min("depth").alias("depth")), "lineage")
    return found


def closure(edges: DataFrame, seeds: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """All nodes that the seeds (`id`) reach over edges (id -> parent_id), each with its least `depth` (0 for a seed)."""
    return lineage(edges, seeds.select(F.lit(0).alias("output"), "id"), max_nodes).select("id", "depth")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, or that lead into one: where a way starts that is longer than there are nodes."""
    kept, nodes = _edges(edges)
    powers, cyclic = _powers(kept, nodes)
    last = powers[-1] if cyclic else kept.limit(0)
    return last.select(F.col("a").alias("id")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on cycles, by strongly connected component: `id`, `cycle` (its least node). Nodes that only lead to or from one are trimmed first."""
    core = cyclic_nodes(edges)
    back = cyclic_nodes(edges.select(F.col("parent_id").alias("id"), F.col("id").alias("parent_id")))
    core = written(core.join(back.hint("merge"), "id", "left_semi"), "cycle-core")
    inside = edges.join(core.hint("merge"), "id", "left_semi").join(core.withColumnRenamed("id", "parent_id").hint("merge"), "parent_id", "left_semi")
    reach = lineage(inside, core.select(F.col("id").alias("output"), "id")).where("depth > 0").select("output", "id")
    loops = inside.where("id = parent_id").select(F.col("id").alias("output"), "id")
    back = reach.select(F.col("id").alias("output"), F.col("output").alias("id"))
    both = reach.join(back.hint("merge"), ["output", "id"], "left_semi").unionByName(loops)
    return both.groupBy(F.col("output").alias("id")).agg(F.least(F.min("id"), F.col("output")).alias("cycle"))


def topological_depth(edges: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Depth of every node, parents first: 0 without a parent, else one more than its deepest parent. A cycle is an error that names one.

    The longest way from a node up has a binary form: from the greatest power down, each node goes on from what it has reached by so
    many edges, if it can.
    """
    kept, nodes = _edges(edges, max_nodes)
    powers, cyclic = _powers(kept, nodes)
    if cyclic:
        named = cycles(edges)
        first = named.where(F.col("cycle") == named.agg(F.min("cycle")).scalar()).orderBy("id").limit(20)
        raise Cyclic(f"the graph has a cycle: {[r.id for r in first.collect()]}")
    own = kept.select("a").union(kept.select("b")).distinct()
    state = written(own.select(F.col("a").alias("id"), F.col("a").alias("at"), F.lit(0).alias("depth")), "topology")
    for k in range(len(powers) - 1, -1, -1):
        far = written(state.join(powers[k].select(F.col("a").alias("at"), "b"), "at").select("id", F.col("b").alias("at"), (F.col("depth") + (1 << k)).alias("depth")).distinct(), "topology-far")
        state = written(far.unionByName(state.join(far.select("id").distinct(), "id", "left_anti")), "topology")
    return state.select("id", "depth").distinct()


def project_jobs(seeds: DataFrame, derived: DataFrame) -> DataFrame:
    """Seed jobs and all that derive from them (edges parent_id -> id)."""
    return closure(derived.select(F.col("parent_id").alias("id"), F.col("id").alias("parent_id")), seeds).select("id")


def bad_pins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose pinned digest is not that of their parent, or whose parent is missing."""
    j = edges.join(nodes.select(F.col("id").alias("parent_id"), "sha"), "parent_id", "left")
    return j.where(~F.coalesce(F.col("pinned") == F.col("sha"), F.lit(False))).select("id", "parent_id")


def steps(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ordered operations of each output: chain (output, id, depth) joined to nodes (id, operation), deepest first."""
    j = chain.join(nodes, "id").groupBy("output").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "id", "operation"))).alias("_s"))
    return j.select("output", F.transform("_s", lambda s: s["operation"]).alias("operations"))


def lineage_steps(nodes: DataFrame, edges: DataFrame, outputs: DataFrame | None = None, max_nodes: int | None = None) -> DataFrame:
    """Processing history of each output: `output`, `place` (from 1, inputs before what is made of them), `id`, `operation`, `parameters`.

    nodes: id, operation, parameters (a map); a step's inputs come before it, steps at one depth by id. outputs: ids (`id`) whose history is
    wanted, all nodes if left out. A reference to a node that isn't there is an error, as is a cycle.
    """
    lost = edges.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("parent_id").limit(1).collect()
    if lost:
        raise ValueError(f"a recorded source is missing: {lost[0][0]}")
    seeds = (nodes if outputs is None else outputs).select(F.col("id").alias("output"), "id")
    level = topological_depth(edges, max_nodes).withColumnRenamed("depth", "_level")
    facts = written(nodes.join(level.hint("merge"), "id", "left"), "lineage-facts")
    found = lineage(edges, seeds, max_nodes)
    # one join on the id alone, so that nodes which all outputs reach can be split over tasks; then dealt by output
    j = found.drop("depth").join(facts.hint("merge"), "id").repartition(_tasks(found), "output")
    from pyspark.sql import Window

    order = Window.partitionBy("output").orderBy(F.coalesce("_level", F.lit(0)), "id")
    return j.select("output", F.row_number().over(order).alias("place"), "id", "operation", "parameters")


def relation_geometry(members: DataFrame, ways: DataFrame, max_depth: int = 8) -> DataFrame:
    """Ways of each relation, nested relations resolved; members: relation_id, type, ref. A relation nested deeper than `max_depth` is an error."""
    level = members.select(F.col("relation_id").alias("root"), "type", "ref")
    found = level.where("type = 'way'")
    for _ in range(max_depth - 1):
        level = level.where("type = 'relation'").select("root", F.col("ref").alias("relation_id")).join(members, "relation_id").select("root", "type", "ref").distinct()
        level = written(level, "relations")
        found = found.unionByName(level.where("type = 'way'"))
    deeper = level.where("type = 'relation'").select(F.col("ref").alias("relation_id"))
    if deeper.join(members.select("relation_id"), "relation_id", "left_semi").take(1):
        raise ValueError("relations are nested deeper than max_depth")
    return found.distinct().join(ways, found["ref"] == ways["way_id"]).drop("ref", "type")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: (`node`, `label`), label the least node, for every node of an edge between two.

    Rounds of two joins: all greater neighbours of a node move to its least neighbour, then all lesser ones do.
    """
    turned = lambda d: d.unionByName(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = turned(now)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(written(least, "components-least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = after


def assemble_rings(segments: DataFrame) -> DataFrame:
    """Way segments (relation_id, way_id, first_node, last_node) -> `rings` of each relation, closed by shared end nodes, and `ok`.

    Every end node must join exactly two segment ends, else `ok` is false and there are no rings. Then a ring is a connected
    component of segments, whatever their number.
    """
    rows = written(segments.select("relation_id", "first_node", "last_node").withColumn("_seg", F.monotonically_increasing_id()), "segments")
    ends = rows.select("relation_id", "_seg", F.explode(F.array("first_node", "last_node")).alias("_node"))
    joints = ends.groupBy("relation_id", "_node").agg(F.count("*").alias("_n"), F.min("_seg").alias("a"), F.max("_seg").alias("b"))
    good = written(joints.groupBy("relation_id").agg(F.bool_and(F.col("_n") == 2).alias("ok")), "rings-good")
    label = components(joints.join(good.where("ok"), "relation_id", "left_semi").select("a", "b"))
    labelled = rows.join(label.withColumnRenamed("node", "_seg"), "_seg", "left").select("relation_id", F.coalesce("label", "_seg").alias("label"))
    rings = labelled.distinct().groupBy("relation_id").agg(F.count("*").alias("_rings"))
    return good.join(rings, "relation_id").select("relation_id", F.when(F.col("ok"), F.col("_rings")).otherwise(F.lit(0)).alias("rings"), "ok")
