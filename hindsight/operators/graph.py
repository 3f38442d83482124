"""Dependency graphs and trees: hops, backward slices, paths, module lookup, closures.

Walks are loops of joins over all roots at once. Every round is written to the shared
checkpoint folder; the driver only learns whether anything new was reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.functions.names import scope_of
from hindsight.operators.ordered import first_n
from hindsight.session import SENT, Bucketed, by_rows, cut_counted, cut_dealt, cut_lineage


def hops(instance: DataFrame, edge: DataFrame, port: DataFrame, conn: DataFrame) -> DataFrame:
    """One backward hop over the whole hierarchy: (node, operand, via), nodes as full names.

    instance (path, module), edge (module, node, operand, via), port (module, port,
    direction), conn (module, inst, child, port, operand). A name defined in its module
    follows its edges; an undefined input goes up to the parent's expression, any other
    undefined name connected to a child's output goes down into it.
    """
    full = lambda path, name: F.concat(path, F.lit("."), name)
    local = instance.join(edge, "module").select(
        full(F.col("path"), F.col("node")).alias("node"), full(F.col("path"), F.col("operand")).alias("operand"), "via"
    )
    defined = edge.select(F.col("module"), F.col("node").alias("name")).distinct()
    inputs = port.where("direction = 'input'").select(F.col("module").alias("child"), "port")
    outputs = port.where("direction = 'output'").select(F.col("module").alias("child"), "port")
    parent = instance.select(F.col("path").alias("up"), "module")
    wired = parent.join(conn, "module").withColumn("path", F.concat("up", F.lit("."), "inst"))
    up = (
        wired.join(inputs, ["child", "port"])
        .join(defined.select(F.col("module").alias("child"), F.col("name").alias("port")), ["child", "port"], "left_anti")
        .select(full(F.col("path"), F.col("port")).alias("node"), full(F.col("up"), F.col("operand")).alias("operand"), F.lit("port-up").alias("via"))
    )
    own_inputs = port.where("direction = 'input'").select("module", F.col("port").alias("name"))
    down = (
        wired.join(outputs, ["child", "port"]).withColumnRenamed("operand", "name")
        .join(defined, ["module", "name"], "left_anti").join(own_inputs, ["module", "name"], "left_anti")
        .select(full(F.col("up"), F.col("name")).alias("node"), full(F.col("path"), F.col("port")).alias("operand"), F.lit("port-down").alias("via"))
    )
    return local.unionByName(up).unionByName(down)


#: Rows of a frontier at one node from which its operands are handed out to several tasks.
HOT = 1_000_000


def _steps(frontier: DataFrame, dep: DataFrame, hottest: int, hot: int) -> DataFrame:
    """(root, node, parent, via) one hop behind a frontier (root, node); ``hottest`` is the most roots at one node."""
    at = frontier.select("root", F.col("node").alias("parent"))
    if hottest <= hot:
        return at.join(dep.withColumnRenamed("node", "parent"), "parent").select("root", "parent", F.col("operand").alias("node"), "via")
    # a hub's operands go to every task that takes a share of its roots
    parts = F.ceil(F.count("*") / hot).cast("int").alias("parts")
    shares = at.groupBy("parent").agg(parts)
    dealt = at.join(shares, "parent").withColumn("part", F.expr("pmod(xxhash64(root), parts)").cast("int"))
    copies = dep.withColumnRenamed("node", "parent").join(shares, "parent").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.drop("parts").join(copies.drop("parts"), ["parent", "part"]).select("root", "parent", F.col("operand").alias("node"), "via")


def backward_slice(
    roots: DataFrame, dep: DataFrame, max_depth: int = 8, keep: DataFrame | None = None, hot: int = HOT
) -> DataFrame:
    """Breadth-first slice of every root: (root, node, depth, via, parent, truncated).

    roots (root, node), dep (node, operand, via). A node appears once per root, at its
    smallest depth, under its lowest parent there. ``keep`` (node) restricts data and
    control hops only. ``truncated`` is true for all of a root's rows if a node it has not
    reached lies behind those at ``max_depth``.

    Dependencies are bucketed by node, each once, and what is reached by (root, node), so a round
    shuffles what it adds and nothing else. Where many roots stand at few nodes, what lies behind those is sent to
    the roots instead.
    """
    if keep is not None:
        free = dep.where(~F.col("via").isin("data", "control"))
        kept = dep.where(F.col("via").isin("data", "control")).join(
            keep.select(F.col("node").alias("operand")).distinct(), "operand", "left_semi"
        )
        dep = free.unionByName(kept)
    start = roots.select(
        "root", "node", F.lit(0).alias("depth"), F.lit("root").alias("via"), F.lit(None).cast("string").alias("parent")
    )
    spark = roots.sparkSession
    adjacent, seen = Bucketed(spark, ["node"]), Bucketed(spark, ["root", "node"])
    try:
        known = adjacent.append(dep.select("node", "operand", "via").repartition(adjacent.buckets, "node").distinct())
        rows = total = seen.append(start)

        def links(depth: int) -> tuple[DataFrame, int]:
            """What lies behind the nodes of the step before, and the most roots at one of them."""
            if rows <= hot:
                return by_rows(adjacent.table(), known), rows
            front = seen.table(depth - 1)
            hottest, nodes = front.groupBy("node").count().agg(F.max("count"), F.count("*")).first()
            if nodes <= SENT:
                few, n = cut_counted(adjacent.table().join(F.broadcast(front.select("node").distinct()), "node", "left_semi"))
                if n <= SENT:
                    return F.broadcast(few), 0
            return by_rows(adjacent.table(), known), hottest

        def behind(depth: int) -> DataFrame:
            """root, node and (parent, via) of what the step before leads to and no step has."""
            after, hottest = links(depth)
            reached = _steps(by_rows(seen.table(depth - 1), rows), after, hottest, hot).groupBy("root", "node")
            reached = reached.agg(F.min(F.struct("parent", "via")).alias("p"))
            return reached.join(by_rows(seen.table().select("root", "node"), total), ["root", "node"], "left_anti")

        more = None
        for depth in range(1, max_depth + 2):
            if not rows:
                break
            if depth > max_depth:  # parents are not asked for
                more, unreached = cut_counted(behind(depth).select("root").distinct())
            else:
                rows = seen.append(behind(depth).select("root", "node", F.lit(depth).alias("depth"), "p.via", "p.parent"))
                total += rows
        steps = seen.rows().drop("step")
    finally:
        adjacent.drop(), seen.drop()
    if more is None or not unreached:
        return steps.withColumn("truncated", F.lit(False))
    marked = steps.join(by_rows(more.withColumn("truncated", F.lit(True)), unreached), "root", "left")
    return marked.withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def cap_nodes(steps: DataFrame, max_nodes: int) -> DataFrame:
    """The first nodes of every root in breadth-first order, and whether there were more, or more behind the depth."""
    more = cut_dealt(first_n(steps, ["root"], [F.col("depth"), F.col("node")], max_nodes + 1), ["root"])
    flags = more.groupBy("root").agg((F.max("truncated") | (F.max("rank") > max_nodes)).alias("truncated"))
    return more.where(F.col("rank") <= max_nodes).drop("rank", "truncated").join(flags.hint("merge"), "root")


def module_slice(
    roots: DataFrame, edge: DataFrame, max_depth: int = 6, follow_control: bool = True
) -> DataFrame:
    """Slice inside modules: roots (module, node); only names defined in the module count."""
    if not follow_control:
        edge = edge.where("via = 'data'")
    defined = edge.select("module", F.col("node").alias("operand")).distinct()
    kept = edge.join(defined, ["module", "operand"], "left_semi")
    inside = lambda c: F.concat_ws(":", "module", c)
    dep = kept.select(inside("node").alias("node"), inside("operand").alias("operand"), "via")
    return backward_slice(roots.select(inside("node").alias("root"), inside("node").alias("node")), dep, max_depth)


def drivers(steps: DataFrame, refs: DataFrame) -> DataFrame:
    """A slice without its roots, each node with its first source reference (node, ref)."""
    first = refs.groupBy("node").agg(F.min("ref").alias("ref"))
    return steps.where("depth > 0").join(first, "node", "left").select("root", "depth", "via", "node", "ref", "truncated")


def without_drivers(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """Roots nothing drives."""
    return roots.select("root").join(steps.where("depth > 0").select("root").distinct(), "root", "left_anti")


def require_drivers(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps``, or a ValueError that names a root nothing drives."""
    bare = without_drivers(roots, steps).orderBy("root").limit(1).collect()
    if bare:
        raise ValueError(f"nothing drives {bare[0].root}")
    return steps


# ---- trees -----------------------------------------------------------------

def instance_paths(nodes: DataFrame) -> DataFrame:
    """(id, parent, name, module) to (id, path, module) with dotted paths.

    Every round doubles how far up a node has looked, so depth d takes log2(d) rounds. A round
    after which no fewer nodes are on their way shows that the rest hang on a cycle of
    parents; their path is NULL.
    """
    walk = cut_lineage(nodes.select("id", F.col("parent").alias("up"), F.col("name").alias("path")))
    open_ = None
    while (now := walk.where("up IS NOT NULL").count()) and now != open_:
        open_ = now
        above = walk.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        walk = cut_lineage(
            walk.join(above, "up", "left").select(
                "id", F.col("next").alias("up"),
                F.when(F.col("head").isNotNull(), F.concat("head", F.lit("."), "path")).otherwise(F.col("path")).alias("path"),
            )
        )
    path = F.when(F.col("up").isNull(), F.col("path")).alias("path")
    return walk.select("id", path).join(nodes.select("id", "module"), "id")


def _suffixes(path: str):
    parts = F.split(path, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")
    )


def suffix_index(instance: DataFrame) -> DataFrame:
    """(suffix, module): every suffix of every path; NULL where two modules claim it."""
    rows = instance.select(F.explode(_suffixes("path")).alias("suffix"), "module")
    return rows.groupBy("suffix").agg(F.when(F.min("module") == F.max("module"), F.min("module")).alias("module"))


def resolve_modules(signals: DataFrame, index: DataFrame) -> DataFrame:
    """(path, module): longest suffix of a signal's scope that names one module.

    Scopes are resolved once each and joined back to their signals.
    """
    scoped = signals.select("path", scope_of(F.col("path")).alias("scope")).distinct()
    tries = scoped.select("scope").distinct().where("scope <> ''").select("scope", F.explode(_suffixes("scope")).alias("suffix"))
    found = tries.join(index.where("module IS NOT NULL"), "suffix").groupBy("scope").agg(
        F.max_by("module", F.length("suffix")).alias("module")
    )
    return scoped.join(found, "scope", "left").select("path", "module")


def signal_sources(resolved: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, module, file, line, col): declared references of every resolved signal."""
    leaf = F.substring_index("path", ".", -1)
    return resolved.withColumn("signal", leaf).join(declared, ["module", "signal"]).select("path", "module", "file", "line", "col")


def source_coverage(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals, those with a source and the share, by run-wide total."""
    hit = sources.select("path").distinct().withColumn("hit", F.lit(1))
    return resolved.join(hit, "path", "left").agg(
        F.count("*").alias("signals"), F.count("hit").alias("with_source"), (F.count("hit") / F.count("*")).alias("share")
    )


# Bases that make a class a module, and those that make it plain data.
MODULE_BASES = (
    "Module", "MultiIOModule", "RawModule", "ImplicitModule", "LazyModule", "LazyModuleImp", "CoreModule", "BoomModule",
)
DATA_BASES = ("Bundle", "BoomBundle", "CoreBundle", "Record", "Data", "UInt", "SInt", "Bits")


def module_closure(bases: DataFrame, modules=MODULE_BASES, data=DATA_BASES) -> DataFrame:
    """(name, is_module): does the chain of bases (name, base, seq) end in a module base.

    The first declaration of a name counts. Pointer doubling; after a round that settles nothing, what is left is a cycle.
    Unknown bases and cycles are no modules.
    """
    final = [*modules, *data]
    walk = cut_lineage(bases.groupBy("name").agg(F.min_by("base", "seq").alias("at")))
    settled = -1
    while True:
        done = walk.where(F.col("at").isin(final) | F.col("at").isNull()).count()
        if done == settled:
            break
        settled = done
        above = walk.select(F.col("name").alias("at"), F.col("at").alias("next"))
        walk = cut_lineage(
            walk.join(above, "at", "left").select(
                "name", F.when(F.col("at").isin(final), F.col("at")).otherwise(F.col("next")).alias("at")
            )
        )
    own = F.col("name").isin(list(modules))
    return walk.select("name", F.coalesce(own | F.col("at").isin(list(modules)), F.lit(False)).alias("is_module"))
