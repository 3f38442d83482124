"""Which inputs account for a value: evaluation, responsibility, causal chains.

``gates``    (node, op, width, hi, lo): what computes a node; op ``reg`` holds state.
``operands`` (node, pos, operand, shift, operand_width): its inputs in order; shift and
             width place an operand of a concatenation.
``traced``   (node, value): what the recording holds, NULL for unknown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.operators.graph import backward_slice, cap_nodes
from hindsight.operators.ordered import first_n
from hindsight.session import Bucketed, by_rows, cut_counted, cut_dealt, cut_lineage, noted_copies, remove_copies


#: Bits of the values that evaluation holds; what needs more is NULL with the reason ``wide``.
HELD = 63


def _mask(bits: Column) -> Column:
    """Ones in the lowest ``bits``; NULL where a value would not hold them."""
    ones = F.when(bits == HELD, F.lit((1 << HELD) - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)
    return F.when(bits <= HELD, ones)


def _bits(value: Column) -> Column:
    """Bits up to the highest that is set."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def _result(op: Column) -> Column:
    """Value of a gate from its aggregated operands; NULL in, NULL out."""
    a, b = F.col("v0"), F.col("v1")
    flag = lambda c: F.when(c, 1).when(~c, 0).cast("long")
    one_or = lambda x, other: F.when(F.col("n") == 1, x).otherwise(other)
    width = F.col("width")
    table = {
        "&": one_or(flag(a == _mask(width)), F.col("all_and")), "|": one_or(flag(a != 0), F.col("all_or")),
        "^": one_or((F.bit_count(a) % 2).cast("long"), F.col("all_xor")),
        "&&": flag((a != 0) & (b != 0)), "||": flag((a != 0) | (b != 0)),
        "~": F.bitwise_not(a).bitwiseAND(_mask(width)), "!": flag(a == 0),
        "==": flag(a == b), "!=": flag(a != b), "<": flag(a < b), ">": flag(a > b), "<=": flag(a <= b), ">=": flag(a >= b),
        "+": F.col("total"), "-": one_or((-a).bitwiseAND(_mask(width)), a - b), "*": F.try_multiply(a, b),
        "/": F.when(b == 0, 0).otherwise(F.expr("v0 div nullif(v1, 0)")), "%": F.when(b == 0, 0).otherwise(F.try_mod(a, b)),
        "<<": F.when(a == 0, 0).when(_bits(a) + b <= HELD, F.expr("shiftleft(v0, cast(least(v1, 63) as int))")), ">>": F.expr("shiftright(v0, cast(least(v1, 63) as int))"),
        ">>>": F.expr("shiftright(v0 - if((shiftright(v0, cast(width - 1 as int)) & 1) = 1, shiftleft(1L, cast(width as int)), 0L), cast(least(v1, 63) as int))").bitwiseAND(F.when(width < HELD, _mask(width))),
        "slice": F.expr("shiftright(v0, cast(least(lo, 63) as int))").bitwiseAND(_mask(F.col("hi") - F.col("lo") + 1)),
        "index": F.expr("shiftright(v0, cast(if(v1 > 63, 63, least(v1 * width, 63)) as int))").bitwiseAND(_mask(width)),
        "concat": F.col("joined"), "id": a,
    }
    out = F
    for name, value in table.items():
        out = out.when(op == name, value)
    return F.when(F.col("n_null") == 0, out)


STATE = ["node", "op", "width", "hi", "lo", "n"]


def _arrivals(fan: DataFrame, fresh: DataFrame) -> DataFrame:
    """What newly settled inputs add to each gate."""
    v = F.col("value")
    part = v.bitwiseAND(_mask(F.least(F.col("operand_width"), F.lit(HELD))))
    over = F.col("concat") & (part != 0) & (_bits(part) + F.col("shift") > HELD)
    at = lambda p: F.max(F.when(F.col("pos") == p, v)).alias(f"v{p}")
    here = lambda p: F.max(F.col("pos") == p).alias(f"ok{p}")
    return fan.join(fresh.withColumnRenamed("node", "operand"), "operand").groupBy("node").agg(
        F.count("*").alias("n_ok"), F.count_if(v.isNull() | F.coalesce(over, F.lit(False))).alias("n_null"), *[at(p) for p in range(3)], *[here(p) for p in range(3)],
        F.bit_and(v).alias("all_and"), F.bit_or(v).alias("all_or"), F.bit_xor(v).alias("all_xor"), F.try_sum(v).alias("total"),
        F.bit_or(F.when(F.col("concat") & ~over & (part != 0), F.call_function("shiftleft", part, F.col("shift").cast("int"))).otherwise(0)).alias("joined"),
    )


def _merge(state: DataFrame, more: DataFrame) -> DataFrame:
    both = state.unionByName(more.withColumn("done", F.lit(False)))
    same = lambda fn, *cs: [fn(c).alias(c) for c in cs]
    return both.groupBy("node").agg(
        *same(F.sum, "n_ok", "n_null"), *same(F.max, "v0", "v1", "v2", "ok0", "ok1", "ok2", "done"), *same(F.bit_and, "all_and"),
        *same(F.bit_or, "all_or", "joined"), *same(F.bit_xor, "all_xor"), *same(F.try_sum, "total"),
    )


def evaluate(gates: DataFrame, operands: DataFrame, traced: DataFrame, large: int = 1_000_000) -> DataFrame:
    """(node, value, reason) for traced nodes, gates and everything they read.

    ``reason`` says why a value is NULL: ``unknown`` (it or what it needs is not recorded),
    ``wide`` (its gate or its recorded value needs more than ``HELD`` bits) or ``loop``.

    A traced value wins. Registers and undefined names without one stay NULL, NULL
    propagates, a mux only needs its selector and the arm taken, and what never settles
    is a loop and NULL. Each round hands only newly settled values to the gates that read
    them; a gate is a fixed-size state that merges what arrives, however many inputs it has,
    and goes when all have.

    Inputs are dealt out by what they read, gates and what is settled by name, each once, so that a
    round shuffles what arrives and nothing else. Where there are more than ``large`` inputs,
    those delivered go each time the gates that wait have halved. The result is a table dealt out by node; what
    was written on the way to it is removed.
    """
    spark = operands.sparkSession
    held = F.when(F.col("value") < F.lit(str(1 << HELD)).cast("decimal(20,0)"), F.col("value")).cast("long").alias("value")
    known = traced.where("value IS NOT NULL").select("node", held)
    none = F.lit(None).cast("long").alias("value")
    settled = Bucketed(spark, ["node"])
    with noted_copies() as made:
        n_fresh = settled.append(known.select("*", F.when(F.col("value").isNull(), "wide").alias("reason")))
        told = settled.table(0).select("node").hint("merge")
        sizes = operands.groupBy("node").agg(F.count("*").alias("n")).hint("merge")
        gated = cut_dealt(gates.where("op <> 'reg'").join(told, "node", "left_anti").join(sizes, "node").select(*STATE), ["node"])
        names = gated.select("node").hint("merge")
        reads = gated.select("node", (F.col("op") == "concat").alias("concat")).hint("merge")
        fan = cut_dealt(operands.join(reads, "node").select("node", "pos", "operand", "shift", "operand_width", "concat"), ["operand"])
        read = fan.select(F.col("operand").alias("node")).distinct().join(told, "node", "left_anti").join(names, "node", "left_anti")
        idle = gates.select("node").join(told, "node", "left_anti").join(names, "node", "left_anti")
        n_fresh += settled.append(read.unionByName(idle).distinct().select("node", none, F.lit("unknown").alias("reason")))
        fresh, rows = settled.table(), fan.count()
        mux = F.col("op") == "?:"
        arm = lambda a, b: F.when(F.col("v0") != 0, F.col(a)).otherwise(F.col(b))
        ready = F.when(mux, (F.col("n_ok") == F.col("n")) | F.col("ok0") & (F.col("v0").isNull() | arm("ok1", "ok2"))).otherwise(
            (F.col("n_null") > 0) | (F.col("n_ok") == F.col("n"))
        )
        value = F.when(mux, F.when(F.col("v0").isNotNull(), arm("v1", "v2"))).otherwise(_result(F.col("op")))
        why = F.when(F.col("value").isNull(), F.when(F.col("width") > HELD, "wide").otherwise("unknown")).alias("reason")
        waiting = halved = gated.count()
        state = None
        while waiting:
            more = _arrivals(fan, by_rows(fresh.select("node", "value"), n_fresh))
            merged = _merge(state, more) if state is not None else more.withColumn("done", F.lit(False))
            judged = merged.join(gated.hint("merge"), "node").withColumn("fresh", ~F.col("done") & ready).withColumn("value", value.cast("long"))
            judged = cut_dealt(judged, ["node"])
            last = settled.steps
            n_fresh = settled.append(judged.where("fresh").select("node", "value", why))
            if not n_fresh:
                break
            fresh, waiting = settled.table(last), waiting - n_fresh
            full = (F.col("done") | F.col("fresh")) & (F.col("n_ok") == F.col("n"))  # nothing more arrives
            state = judged.where(~full).withColumn("done", F.col("done") | F.col("fresh")).drop("fresh", "value", *STATE[1:])
            if rows > large and 2 * waiting < halved:
                halved = waiting
                given = settled.table(before=last).select(F.col("node").alias("operand"))
                fan = cut_dealt(fan.join(given.hint("merge"), "operand", "left_anti"), ["operand"])
        settled.append(names.join(settled.table().select("node").hint("merge"), "node", "left_anti").select("node", none, F.lit("loop").alias("reason")))
        used = [*made, settled.path]
        result = cut_dealt(settled.table(), ["node"])
    settled.drop()
    remove_copies(spark, used)
    return result


def responsible(gates: DataFrame, operands: DataFrame, values: DataFrame) -> DataFrame:
    """(node, pos, operand, value, node_value): the operands that account for each value.

    AND at 0 blames only its zeros, OR above 0 only what is above 0, a mux its selector
    and the arm taken; every other gate all it reads.
    """
    op_v = values.select(F.col("node").alias("operand"), "value").hint("merge")
    node_v = values.select("node", F.col("value").alias("node_value")).hint("merge")
    first = operands.where("pos = 0").select("node", "operand").join(gates.where("op = '?:'").select("node").hint("merge"), "node")
    picks = first.join(op_v, "operand", "left").groupBy("node").agg(F.max("value").alias("sel"))
    known = gates.select("node", "op").join(node_v, "node", "left").join(picks.hint("merge"), "node", "left")
    rows = operands.select("node", "pos", "operand").join(op_v, "operand", "left").join(known.hint("merge"), "node")
    arm = F.when(F.coalesce("sel", F.lit(0)) != 0, 1).otherwise(2)
    keep = (
        F.when(F.col("op").isin("&", "&&") & (F.col("node_value") == 0), F.col("value") == 0)
        .when(F.col("op").isin("|", "||") & (F.col("node_value") != 0), F.coalesce(F.col("value") != 0, F.lit(False)))
        .when(F.col("op") == "?:", (F.col("pos") == 0) | (F.col("pos") == arm))
        .otherwise(True)
    )
    return rows.where(F.coalesce(keep, F.lit(False))).select("node", "pos", "operand", "value", "node_value")


def selected_elements(gates: DataFrame, operands: DataFrame, values: DataFrame) -> DataFrame:
    """(node, operand): for ``base[i]`` over a concatenation the one element read.

    Operand 0 of an ``index`` gate is the base, operand 1 the index. Elements are listed
    most significant first, so element i stands at position n-1-i.
    """
    picked = by_rows(*cut_counted(gates.where("op = 'index'").select("node")))
    reads, n = cut_counted(operands.where("pos < 2").join(picked, "node").select("node", "pos", "operand"))
    base = reads.where("pos = 0").select("node", F.col("operand").alias("base"))
    index = by_rows(reads.where("pos = 1").select("node", F.col("operand").alias("index")), n)
    at = values.select(F.col("node").alias("index"), F.col("value").alias("i")).where("i IS NOT NULL").join(index, "index").select("node", "i")
    joined = by_rows(*cut_counted(gates.where("op = 'concat'").select("node")))
    parts = operands.join(joined, "node").select(F.col("node").alias("base"), "pos", "operand")
    sizes = parts.groupBy("base").agg(F.count("*").alias("n"))
    wanted = base.join(at.hint("merge"), "node").join(sizes.hint("merge"), "base").withColumn("pos", F.col("n") - 1 - F.col("i")).where("pos >= 0 AND i >= 0")
    return wanted.join(parts.hint("merge"), ["base", "pos"]).select("node", "operand", "i")


def blame_edges(
    gates: DataFrame, operands: DataFrame, values: DataFrame, controls: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """(node, operand, via): what a causal walk may follow.

    Responsible operands, an indexed element instead of its whole base, the control
    names of registers (node, operand), and structural hops of undefined names.
    """
    picked, n = cut_counted(selected_elements(gates, operands, values))
    blamed = responsible(gates, operands, values).select("node", "pos", "operand")
    whole = picked.select("node", F.lit(0).alias("pos"))
    out = blamed.join(by_rows(whole, n), ["node", "pos"], "left_anti").select("node", "operand", F.lit("accounts for the value").alias("via"))
    out = out.unionByName(picked.select("node", "operand", F.lit("accounts for the value").alias("via")))
    if controls is not None:
        regs = gates.where("op = 'reg'").select("node").hint("merge")
        out = out.unionByName(controls.join(regs, "node").select("node", "operand", F.lit("control").alias("via")))
    if links is not None:
        out = out.unionByName(links.join(gates.select("node").hint("merge"), "node", "left_anti").select("node", "operand", "via"))
    return out.repartition("node").distinct()  # by node, as walks need them


def why(
    roots: DataFrame, edges: DataFrame, values: DataFrame | None, last_change: DataFrame | None, facts: DataFrame, max_depth: int = 12,
    max_nodes: int | None = None,
) -> DataFrame:
    """Causal chain of every root: (root, depth, node, via, parent, value, last_change, module, ref, expr, truncated).

    roots (root, node); last_change (node, last_change); facts (node, module, ref, expr). With ``max_nodes`` a chain is its
    first links by depth and name. ``truncated`` says whether depth or number of nodes left any link of the root out.
    Where nobody asks for ``values`` or ``last_change`` they may be None, and are NULL then.
    """
    steps = backward_slice(roots, edges, max_depth)
    if max_nodes is not None:
        steps = cap_nodes(steps, max_nodes)
    for known, name in ((values, "value"), (last_change, "last_change")):
        steps = steps.withColumn(name, F.lit(None).cast("long")) if known is None else steps.join(known.hint("merge"), "node", "left")
    return (
        steps.join(facts.hint("merge"), "node", "left")
        .select("root", "depth", "node", "via", "parent", "value", "last_change", "module", "ref", "expr", "truncated")
    )


def cross_memory(chain: DataFrame, reads: DataFrame, hop: DataFrame, below: DataFrame) -> DataFrame:
    """Continue chains that end in a memory from the write that filled it.

    reads (node, mem): read ports; hop (root, mem, write_cycle, port): the write found
    for a chain; below: chains at the write cycle, rooted at (root, mem). Links keep what is
    known of them; a marker is reached ``via`` the memory. The memory's other port links are dropped, a marker row and the sub-chain come in, one level
    below the shallowest read port of the chain.
    """
    chain = cut_dealt(chain, ["root"])
    ends = chain.join(reads.hint("merge"), "node").join(hop.hint("merge"), ["root", "mem"]).groupBy("root").agg(
        F.min(F.struct("depth", "node", "mem", "write_cycle", "port")).alias("x")
    ).select("root", F.col("x.depth").alias("at"), F.col("x.node").alias("read"), "x.mem", "x.write_cycle", "x.port")
    ends = cut_dealt(ends, ["root"])
    cols = ["root", "depth", "node", "via", "parent", "value", "last_change", "module", "ref"]
    kept = chain.join(ends.select("root", "mem", "read").hint("merge"), "root", "left").where(
        F.col("mem").isNull() | ~F.coalesce(F.col("node").startswith(F.concat("mem", F.lit("."))), F.lit(False)) | (F.col("node") == F.col("read"))
    ).select(*cols)
    text = F.concat(F.lit("-- written at cycle "), "write_cycle", F.lit(" by port "), "port", F.lit(" --"))
    unknown = F.lit(None).cast("string")
    marks = ends.select(
        "root", F.col("at").alias("depth"), text.alias("node"), F.lit("memory").alias("via"), F.col("read").alias("parent"),
        F.lit(None).cast("long").alias("value"), F.col("write_cycle").alias("last_change"), unknown.alias("module"), unknown.alias("ref"),
    )
    sub = below.join(ends.select("root", "mem", "at").hint("merge"), ["root", "mem"]).withColumn("depth", F.col("depth") + F.col("at") + 1).select(*cols)
    return kept.unionByName(marks).unionByName(sub)


def _shown(node: Column) -> Column:
    """Links worth showing: no temporaries, memory internals, clocks or names above the root."""
    leaf = F.substring_index(node, ".", -1)
    return node.startswith("--") | ~(
        leaf.startswith("_") | node.contains("_ext.") | leaf.isin("reset", "clock") | node.startswith("TOP.")
    )


def _below_anchor(chain: DataFrame, anchors: DataFrame) -> DataFrame:
    """(root, node): links whose parents lead to their root's anchor (root, anchor)."""
    below = chain.where("parent IS NOT NULL").join(anchors.select("root").hint("merge"), "root", "left_semi").select("root", "parent", "node")
    parent = cut_dealt(below.repartition("root", "parent").distinct(), ["root", "parent"]).hint("merge")
    reached = Bucketed(chain.sparkSession, ["root", "node"])
    try:
        rows = reached.append(anchors.select("root", F.col("anchor").alias("node")))
        while rows:  # ends, as what was reached is left out
            frontier = by_rows(reached.table(reached.steps - 1).withColumnRenamed("node", "parent"), rows)
            down = frontier.join(parent, ["root", "parent"]).select("root", "node").distinct()
            rows = reached.append(down.join(reached.table().hint("merge"), ["root", "node"], "left_anti"))
        return reached.rows().drop("step")
    finally:
        reached.drop()


def chain_digest(chain: DataFrame, total: int = 22) -> DataFrame:
    """One telling link per depth of every chain, at most ``total``; ``truncated`` says whether there were more.

    A root value that is not NULL, 0 or 1 marks a path: at depths where a link carries
    it only those stay, and below the deepest of them only its descendants. Otherwise
    links rank by how close to the root's own last change they moved; those that never
    moved or were never observed come last.
    """
    chain = cut_dealt(chain, ["root"])  # what is asked of each root needs no shuffle
    head = F.col("depth") == 0
    heads = chain.groupBy("root").agg(
        F.max(F.when(head, F.col("value"))).alias("root_value"), F.max(F.when(head, F.col("last_change"))).alias("root_change"),
        F.min("last_change").alias("floor"), F.max(head).alias("has"),
    ).where("has").drop("has")
    shown = chain.where(_shown(F.col("node")))
    marks = F.col("node").startswith("--")
    distinctive = F.col("root_value").isNotNull() & ~F.col("root_value").isin(0, 1)
    carries = F.coalesce(F.col("value") == F.col("root_value"), F.lit(False))
    hits = shown.join(heads.hint("merge"), "root").where(distinctive & carries)
    hits = hits.groupBy("root").agg(F.collect_set("depth").alias("carried"), F.min(F.struct((-F.col("depth")).alias("up"), "node")).alias("d"))
    hits = hits.select("root", "carried", (-F.col("d.up")).alias("anchor_depth"), F.col("d.node").alias("anchor"))
    known = cut_dealt(heads.join(hits.hint("merge"), "root", "left"), ["root"])
    level = F.coalesce(F.array_contains("carried", F.col("depth")), F.lit(False))
    kept = shown.join(known.hint("merge"), "root").where(marks | ~distinctive | ~level | carries)
    sure = F.col("anchor").isNull() | marks | (F.col("depth") <= F.col("anchor_depth"))
    under = _below_anchor(chain, known.where("anchor IS NOT NULL").select("root", "anchor"))
    asked = kept.where(~sure).join(under.hint("merge"), ["root", "node"])  # a semi-join would be made of the whole chain
    kept = kept.where(sure).unionByName(asked.select(*kept.columns))
    still = F.col("last_change").isNull() | F.col("root_change").isNull() | (F.col("last_change") == F.col("floor"))
    group = F.when(distinctive, F.when(carries, 0).otherwise(1)).otherwise(F.when(still, 1).otherwise(0))
    away = F.when(distinctive | still, 0).otherwise(F.abs(F.col("last_change") - F.col("root_change")))
    ranked = kept.withColumn("_group", group).withColumn("_away", away.cast("long"))
    links = ranked.where(~marks)
    one = links.groupBy("root", "depth").agg(F.min(F.struct("_group", "_away", "node", "value", "last_change", "ref", "parent")).alias("l")).select(
        "root", "depth", "l.node", "l.value", "l.last_change", "l.ref", "l.parent"
    )
    rows = one.unionByName(ranked.where(marks).select(*one.columns))
    more = cut_lineage(first_n(rows, ["root"], [F.col("depth"), F.when(marks, 0).otherwise(1), F.col("node")], total + 1))
    flags = more.groupBy("root").agg((F.max("rank") > total).alias("truncated"))
    return more.where(F.col("rank") <= total).drop("rank").join(flags.hint("merge"), "root")


def committing_lane(state: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, lane): the lane that retired the offending write, 0 when none fits.

    state (run_id, lane, valid, dest) at the finding; findings (run_id, reg).
    """
    fits = state.join(findings.where("reg IS NOT NULL"), "run_id").where("valid = 1 AND dest = reg")
    first = fits.groupBy("run_id").agg(F.min("lane").alias("lane"))
    return findings.select("run_id").join(first, "run_id", "left").select("run_id", F.coalesce("lane", F.lit(0)).alias("lane"))


def trace_roots(findings: DataFrame, lanes: DataFrame, wdata_node: str, pc_node: str) -> DataFrame:
    """(root, node) to explain: the lane's data for a wrong value, the fetch address for a wrong pc."""
    wrong = findings.where(F.col("kind") == "wdata").join(lanes, "run_id").select(
        F.col("run_id").cast("string").alias("root"), F.concat(F.lit(wdata_node), "lane").alias("node")
    )
    fetched = findings.where(F.col("kind") == "pc").select(F.col("run_id").cast("string").alias("root"), F.lit(pc_node).alias("node"))
    return wrong.unionByName(fetched)


def chain_files(chain: DataFrame, truth: DataFrame) -> DataFrame:
    """Per chain: files and modules it names, and whether the true file is among them.

    truth (root, file). Only counts leave the join, the names stay rows.
    """
    file = F.regexp_extract("ref", r"([^/:]+\.scala)", 1)
    named = chain.select("root", F.when(file != "", file).alias("file"), F.substring_index("node", ".", 1).alias("module"))
    named = cut_dealt(named, ["root"])  # so that counts need no shuffle
    counts = named.groupBy("root").agg(F.count_distinct("file").alias("files"), F.count_distinct("module").alias("modules"))
    hits = named.join(truth.hint("merge"), ["root", "file"], "left_semi").select("root").distinct().withColumn("hit", F.lit(True))
    return truth.join(counts.hint("merge"), "root", "left").join(hits.hint("merge"), "root", "left").select(
        "root", "file", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("modules", F.lit(0)).alias("modules"),
        F.coalesce("hit", F.lit(False)).alias("hit"),
    )


def chain_export(digest: DataFrame, heads: DataFrame, windows: DataFrame, block: Column) -> DataFrame:
    """One row per chain: header, links as JSON in depth order, and window bounds.

    heads (root, …); windows (root, lo, hi) of a re-capture, else the span of the links'
    last changes. A digest is bounded, so its links fit one row.
    """
    link = F.struct("depth", F.col("node").alias("signal"), "value", F.col("last_change").alias("stopped"), block.alias("block"))
    packed = digest.groupBy("root").agg(
        F.to_json(F.array_sort(F.collect_list(link))).alias("links"), F.count("*").alias("n_links"),
        F.min("last_change").alias("_lo"), F.max("last_change").alias("_hi"),
    )
    return heads.join(packed, "root", "left").join(windows, "root", "left").select(
        *[F.col(c) for c in heads.columns], F.coalesce("n_links", F.lit(0)).alias("n_links"), "links",
        F.coalesce("lo", "_lo").alias("window_lo"), F.coalesce("hi", "_hi").alias("window_hi"),
    )
