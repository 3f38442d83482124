"""Dependency graphs over the order tables and netlist text rendered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.operators import graph
from hindsight.plans import runlogs
from hindsight.plans.registry import query, table
from hindsight.sources import netlist, runlog

# ---- netlist text -------------------------------------------------------------


def module_text(spark, folder) -> DataFrame:
    """A module per supplier; every line item adds a wire and a clocked block."""
    rows = runlogs.sequenced(spark, folder)
    red, scaffold = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("$") else F.col(x[1:]).cast("string") for x in p])
    steps = [
        cat("  wire [7:0] w_", "$seq", " = p_", "$l_partkey", " & 8'h3 | o_", "$l_orderkey", ";\t// @[a.scala:", "$l_linenumber", ":3]"),
        cat("  always @(posedge clock) begin"),
        cat("    if (c_", "$l_linenumber", ") begin"),
        F.when(red, cat("      if (d_", "$disc", " & ~e_", "$tax", ") begin")),
        cat("        r_", "$l_partkey", " <= x_", "$l_orderkey", ";"),
        F.when(red, cat("      end else begin")),
        F.when(red, cat("        r_", "$l_partkey", " <= y_", "$l_linenumber", ";")),
        F.when(red, cat("      end")),
        cat("    end"),
        cat("  end // always @(posedge)"),
        F.when(scaffold, cat("`ifdef ENABLE_INITIAL_REG_")),
        F.when(scaffold, cat("  assign z_", "$l_partkey", " = RANDOM_1;")),
        F.when(scaffold, cat("`endif // ENABLE_INITIAL_REG_")),
    ]
    at = [F.struct((F.col("seq") * 16 + i).alias("line_no"), s.alias("text")) for i, s in enumerate(steps)]
    return rows.select(F.concat(F.lit("M"), "run_id").alias("module"), F.inline(F.array(*at))).where("text IS NOT NULL")


@query("A23_fanin_extract", runlogs.SQL + """
, e AS (
  SELECT 'M' || run_id AS module, 'w_' || seq AS node, 'p_' || l_partkey AS operand, 'data' AS via FROM c
  UNION SELECT 'M' || run_id, 'w_' || seq, 'o_' || l_orderkey, 'data' FROM c
  UNION SELECT 'M' || run_id, 'r_' || l_partkey, 'x_' || l_orderkey, 'data' FROM c
  UNION SELECT 'M' || run_id, 'r_' || l_partkey, 'c_' || l_linenumber, 'control' FROM c
  UNION SELECT 'M' || run_id, 'r_' || l_partkey, 'y_' || l_linenumber, 'data' FROM c WHERE l_returnflag = 'R'
  UNION SELECT 'M' || run_id, 'r_' || l_partkey, 'd_' || disc, 'control' FROM c WHERE l_returnflag = 'R'
  UNION SELECT 'M' || run_id, 'r_' || l_partkey, 'e_' || tax, 'control' FROM c WHERE l_returnflag = 'R')
SELECT * FROM e
""")
def a23(spark, folder):
    return netlist.fanin(netlist.statements(module_text(spark, folder)))


def wiring_text(spark, folder) -> DataFrame:
    """A parent module per nation with an instance per customer, every eleventh malformed."""
    n = table(spark, folder, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("module"))
    head = ["module X (", "  input         clock,", "  input  [3:0]  io_in,  // @[x.scala:1:1]", "  output [7:0]  io_out", ");"]
    header = n.select("module", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no").cast("long") - 10
    )
    k = F.col("c_custkey")
    body = [
        F.concat(F.lit("  S"), k % 7, F.lit(" s"), k, F.lit(" (\t// @[x.scala:9:9]")), F.lit("    .clock  (clock),"),
        F.concat(F.lit("    .io_in  (a_"), k, F.lit(" & b_"), k % 5, F.lit("),\t// note")), F.lit("    // comment"),
        F.when(k % 11 == 0, "    garbage here").otherwise(""), F.concat(F.lit("    .io_out (_s"), k, F.lit("_io_out)")), F.lit("  );"),
    ]
    at = [F.struct((k * 8 + i).alias("line_no"), b.alias("text")) for i, b in enumerate(body)]
    inst = table(spark, folder, "customer").select(F.concat(F.lit("N"), "c_nationkey").alias("module"), F.inline(F.array(*at)))
    return header.unionByName(inst)


@query("A24_wiring_extract", """
WITH k AS (SELECT 'N' || c_nationkey AS module, 's' || c_custkey AS inst, 'S' || (c_custkey % 7) AS child, c_custkey AS k FROM customer WHERE c_custkey % 11 <> 0)
SELECT module, inst, child, 'clock' AS port, 'clock' AS operand FROM k
UNION ALL SELECT module, inst, child, 'io_in', 'a_' || k FROM k UNION ALL SELECT module, inst, child, 'io_in', 'b_' || (k % 5) FROM k
UNION ALL SELECT module, inst, child, 'io_out', '_s' || k || '_io_out' FROM k
""")
def a24(spark, folder):
    return netlist.wiring(netlist.connections(wiring_text(spark, folder)))


@query("A24_ports", """
SELECT 'N' || n_nationkey AS module, unnest(['clock', 'io_in', 'io_out']) AS port, unnest(['input', 'input', 'output']) AS direction FROM nation
""")
def a24p(spark, folder):
    return netlist.ports(wiring_text(spark, folder))


@query("A25_decl_dims", """
SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN p_size + 1 ELSE (p_size + 1) * (p_partkey % 9 + 1) END AS BIGINT) AS total,
       CAST(CASE p_partkey % 3 WHEN 2 THEN p_partkey % 9 + 1 ELSE 1 END AS BIGINT) AS elem FROM part
""")
def a25(spark, folder):
    one = F.concat(F.lit("["), "p_size", F.lit(":0]"))
    two = F.concat(one, F.lit(" [0 : "), F.col("p_partkey") % 9, F.lit("]"))
    text = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, one).otherwise(two)
    total, elem = netlist.decl_dims(F.col("ranges"))
    return table(spark, folder, "part").select("p_partkey", text.alias("ranges")).select("p_partkey", total.alias("total"), elem.alias("elem"))


# ---- instance tree --------------------------------------------------------------

TREE = """
WITH tree AS (
  SELECT 'P' || s_suppkey AS id, 'R' || n_regionkey || '.N' || n_nationkey || '.S' || s_suppkey || '.P' || (s_suppkey % 5) AS path, 'Leaf' || (s_suppkey % 3) AS module
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey || '.N' || n_nationkey || '.S' || s_suppkey, 'M' || (s_suppkey % 7) FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey || '.N' || n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 'Region' FROM region),
sfx0 AS (SELECT module, string_split(path, '.') AS p FROM tree),
sfx1 AS (SELECT module, array_to_string(p[i:], '.') AS suffix FROM (SELECT module, p, unnest(range(1, len(p) + 1)) AS i FROM sfx0)),
sfx AS (SELECT suffix, CASE WHEN min(module) = max(module) THEN min(module) END AS module FROM sfx1 GROUP BY 1),
sig AS (SELECT DISTINCT 'TOP.' || t.path || '.p_' || (p_partkey % 50) AS path FROM part JOIN tree t ON t.id = 'S' || (p_partkey % 100)
        UNION SELECT DISTINCT 'DUT.P' || (p_partkey % 5) || '.q_' || p_size FROM part),
sc AS (SELECT path, string_split(regexp_replace(path, '\\.[^.]*$', ''), '.') AS p FROM sig),
tr AS (SELECT path, array_to_string(p[i:], '.') AS suffix, i FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM sc)),
res AS (SELECT s.path, arg_min(f.module, tr.i) FILTER (f.module IS NOT NULL) AS module FROM sig s LEFT JOIN tr USING (path) LEFT JOIN sfx f USING (suffix) GROUP BY s.path)
"""


def nodes(spark, folder) -> DataFrame:
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    row = lambda df, i, parent, name, module: df.select(i.alias("id"), parent.alias("parent"), name.alias("name"), module.alias("module"))
    tag = lambda t, c: F.concat(F.lit(t), c)
    key = F.col("s_suppkey")
    return (
        row(s, tag("P", key), tag("S", key), tag("P", key % 5), tag("Leaf", key % 3))
        .unionByName(row(s, tag("S", key), tag("N", F.col("s_nationkey")), tag("S", key), tag("M", key % 7)))
        .unionByName(row(n, tag("N", F.col("n_nationkey")), tag("R", F.col("n_regionkey")), tag("N", F.col("n_nationkey")), F.lit("Nation")))
        .unionByName(row(r, tag("R", F.col("r_regionkey")), F.lit(None).cast("string"), tag("R", F.col("r_regionkey")), F.lit("Region")))
    )


def instances(spark, folder) -> DataFrame:
    return graph.instance_paths(nodes(spark, folder))


def signals(spark, folder) -> DataFrame:
    p = table(spark, folder, "part")
    tree = instances(spark, folder).select("id", F.col("path").alias("scope"))
    under = p.select(F.concat(F.lit("S"), F.col("p_partkey") % 100).alias("id"), (F.col("p_partkey") % 50).alias("k")).join(tree, "id")
    own = under.select(F.concat(F.lit("TOP."), "scope", F.lit(".p_"), "k").alias("path"))
    lone = p.select(F.concat(F.lit("DUT.P"), F.col("p_partkey") % 5, F.lit(".q_"), "p_size").alias("path"))
    return own.unionByName(lone).distinct()


@query("A19_instance_paths", TREE + "SELECT id, path, module FROM tree")
def a19(spark, folder):
    return instances(spark, folder).select("id", "path", "module")


@query("A20_suffix_index", TREE + "SELECT suffix, module FROM sfx")
def a20(spark, folder):
    return graph.suffix_index(instances(spark, folder))


def resolved(spark, folder) -> DataFrame:
    return graph.resolve_modules(signals(spark, folder), graph.suffix_index(instances(spark, folder)))


@query("A21_resolve_module", TREE + "SELECT path, module FROM res")
def a21(spark, folder):
    return resolved(spark, folder)


DECLARED = runlogs.LOCATORS.replace("WITH d AS", ", d AS") + """
, fst AS (SELECT module, signal, min(line_no) AS line_no FROM refs GROUP BY ALL),
decl AS (SELECT module, signal, r.file AS file, r.line AS line, r.col AS col FROM refs SEMI JOIN fst USING (module, signal, line_no)),
src AS (SELECT res.path, res.module, file, line, col FROM res JOIN decl ON decl.module = res.module AND decl.signal = split_part(res.path, '.', -1))
"""


def sources(spark, folder):
    found = resolved(spark, folder)
    return found, graph.signal_sources(found, runlog.declarations(runlogs.declared(spark, folder)))


@query("A22_signal_source", TREE + DECLARED + "SELECT * FROM src")
def a22(spark, folder):
    return sources(spark, folder)[1]


@query("A22_source_coverage", TREE + DECLARED + """
SELECT count(*) AS signals, count(*) FILTER (path IN (SELECT path FROM src)) AS with_source, count(*) FILTER (path IN (SELECT path FROM src)) / count(*) AS share FROM res
""")
def a22c(spark, folder):
    return graph.source_coverage(*sources(spark, folder))


@query("B13_source_of", TREE + DECLARED + """
SELECT path, file, line, CAST(row_number() OVER (PARTITION BY path ORDER BY line, file, col) AS INTEGER) AS rank,
       count(*) OVER (PARTITION BY path) > 500 AS truncated FROM src
QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, file, col) <= 500
""")
def b13(spark, folder):
    from hindsight.operators.results import capped_per_key

    found = sources(spark, folder)[1]
    return capped_per_key(found, ["path"], [F.col("line"), F.col("file"), F.col("col")], 500).select("path", "file", "line", "rank", "truncated")


# ---- dependency graph -------------------------------------------------------------

HOPS = """
WITH instance AS (
  SELECT 'top.N' || n_nationkey AS path, 'Nat' AS module FROM nation UNION ALL SELECT 'top', 'Top'
  UNION ALL SELECT 'top.N' || s_nationkey || '.S' || s_suppkey, 'Sup' || (s_suppkey % 7) FROM supplier),
edge AS (
  SELECT DISTINCT 'Sup' || (p_partkey % 7) AS module, 'w' || p_size AS node, 'w' || (p_size // 2) AS operand, CASE WHEN p_size % 2 = 0 THEN 'data' ELSE 'control' END AS via FROM part WHERE p_size > 1
  UNION SELECT DISTINCT 'Sup' || (p_partkey % 7), 'io_out', 'w' || p_size, 'data' FROM part UNION SELECT DISTINCT 'Nat', 'n' || p_size, 'q' || (p_size % 5), 'data' FROM part),
port AS (
  SELECT DISTINCT 'Sup' || (s_suppkey % 7) AS module, unnest(['w1', 'io_out']) AS port, unnest(['input', 'output']) AS direction FROM supplier),
conn AS (
  SELECT 'Nat' AS module, 'S' || s_suppkey AS inst, 'Sup' || (s_suppkey % 7) AS child, 'w1' AS port, 'n' || (s_suppkey % 50 + 1) AS operand FROM supplier
  UNION ALL SELECT 'Nat', 'S' || s_suppkey, 'Sup' || (s_suppkey % 7), 'io_out', '_S' || s_suppkey || '_io_out' FROM supplier),
local AS (SELECT path || '.' || node AS node, path || '.' || operand AS operand, via FROM instance JOIN edge USING (module)),
wired AS (SELECT i.path AS up, i.path || '.' || c.inst AS path, c.* FROM instance i JOIN conn c USING (module)),
upw AS (SELECT path || '.' || port AS node, up || '.' || operand AS operand, 'port-up' AS via FROM wired w WHERE EXISTS (SELECT 1 FROM port p WHERE p.module = w.child AND p.port = w.port AND p.direction = 'input')
        AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.module = w.child AND e.node = w.port)),
down AS (SELECT up || '.' || operand AS node, path || '.' || port AS operand, 'port-down' AS via FROM wired w WHERE EXISTS (SELECT 1 FROM port p WHERE p.module = w.child AND p.port = w.port AND p.direction = 'output')
        AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.module = w.module AND e.node = w.operand))
"""


@query("D01_step", HOPS + "SELECT * FROM local UNION ALL SELECT * FROM upw UNION ALL SELECT * FROM down")
def d01(spark, folder):
    n, s, p = (table(spark, folder, t) for t in ("nation", "supplier", "part"))
    tag = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    sk, sup, size = F.col("s_suppkey"), tag("Sup", F.col("s_suppkey") % 7), F.col("p_size")
    instance = (
        n.select(tag("top.N", F.col("n_nationkey")).alias("path"), F.lit("Nat").alias("module"))
        .unionByName(s.select(tag("top.N", F.col("s_nationkey"), ".S", sk).alias("path"), sup.alias("module")))
    )
    mod = tag("Sup", F.col("p_partkey") % 7)
    edge = (
        p.where("p_size > 1").select(mod.alias("module"), tag("w", size).alias("node"), tag("w", F.floor(size / 2)).alias("operand"),
                                     F.when(size % 2 == 0, "data").otherwise("control").alias("via"))
        .unionByName(p.select(mod.alias("module"), F.lit("io_out").alias("node"), tag("w", size).alias("operand"), F.lit("data").alias("via")))
        .unionByName(p.select(F.lit("Nat").alias("module"), tag("n", size).alias("node"), tag("q", size % 5).alias("operand"), F.lit("data").alias("via")))
        .distinct()
    )
    sides = F.array(
        F.struct(F.lit("w1").alias("port"), F.lit("input").alias("direction"), tag("n", sk % 50 + 1).alias("operand")),
        F.struct(F.lit("io_out").alias("port"), F.lit("output").alias("direction"), tag("_S", sk, "_io_out").alias("operand")),
    )
    wires = s.select(F.lit("Nat").alias("module"), tag("S", sk).alias("inst"), sup.alias("child"), F.inline(sides))
    port = wires.select(F.col("child").alias("module"), "port", "direction").distinct()
    return graph.hops(instance, edge, port, wires.drop("direction"))


GR = """
WITH RECURSIVE dep AS (
  SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS operand, 'data' AS via FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'data' FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey, 'control' FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'port-up' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'port-up' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'port-up' FROM nation),
root AS (SELECT 'o' || o_orderkey AS node FROM orders),
"""
WALK = """
walk(root, node, depth) AS (
  SELECT node, node, 0 FROM root UNION SELECT w.root, d.operand, w.depth + 1 FROM walk w JOIN {dep} d ON d.node = w.node WHERE w.depth < {depth}),
near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL),
par AS (SELECT n.root, n.node, min(struct_pack(p := d.node, v := d.via)) AS b FROM near n JOIN {dep} d ON d.operand = n.node
        JOIN near m ON m.root = n.root AND m.node = d.node AND m.depth = n.depth - 1 GROUP BY ALL),
deeper AS (SELECT DISTINCT n.root FROM near n JOIN {dep} d ON d.node = n.node WHERE n.depth = {depth}
           AND NOT EXISTS (SELECT 1 FROM near m WHERE m.root = n.root AND m.node = d.operand)),
slice AS (SELECT n.root, n.node, n.depth, CASE WHEN depth = 0 THEN 'root' ELSE b.v END AS via, b.p AS parent,
                 n.root IN (FROM deeper) AS truncated FROM near n LEFT JOIN par USING (root, node))
"""


def dependencies(spark, folder) -> DataFrame:
    o, li, s, c, n = (table(spark, folder, t) for t in ("orders", "lineitem", "supplier", "customer", "nation"))
    def edge(df, a, ak, b, bk, via):
        return df.select(F.concat(F.lit(a), ak).alias("node"), F.concat(F.lit(b), bk).alias("operand"), F.lit(via).alias("via"))

    return (
        edge(o, "o", "o_orderkey", "c", "o_custkey", "data")
        .unionByName(edge(li, "o", "l_orderkey", "p", "l_partkey", "data"))
        .unionByName(edge(li, "o", "l_orderkey", "s", "l_suppkey", "control"))
        .unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "port-up"))
        .unionByName(edge(c, "c", "c_custkey", "n", "c_nationkey", "port-up"))
        .unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey", "port-up"))
    )


def order_roots(spark, folder) -> DataFrame:
    node = F.concat(F.lit("o"), "o_orderkey")
    return table(spark, folder, "orders").select(node.alias("root"), node.alias("node"))


@query("D03_hier_slice", GR + WALK.format(dep="dep", depth=8) + "SELECT root, node, CAST(depth AS INTEGER) AS depth, via, parent, truncated FROM slice")
def d03(spark, folder):
    return graph.backward_slice(order_roots(spark, folder), dependencies(spark, folder), 8)


@query("D03_hier_slice_keep", GR + """
kd AS (SELECT * FROM dep WHERE via = 'port-up' OR operand IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)),
""" + WALK.format(dep="kd", depth=8) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS rn, count(*) OVER (PARTITION BY root) AS n FROM slice)
SELECT root, node, CAST(depth AS INTEGER) AS depth, via, parent, n > 6 OR truncated AS truncated FROM r WHERE rn <= 6
""")
def d03k(spark, folder):
    keep = table(spark, folder, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.cap_nodes(graph.backward_slice(order_roots(spark, folder), dependencies(spark, folder), 8, keep), 6)


@query("D02_module_slice", """
WITH RECURSIVE edge AS (
  SELECT DISTINCT l_suppkey AS module, 'o' || l_orderkey AS node, 'p' || l_partkey AS operand, 'data' AS via FROM lineitem
  UNION ALL SELECT DISTINCT l_suppkey, 'p' || l_partkey, 'q' || (l_partkey // 4), 'control' FROM lineitem
  UNION ALL SELECT DISTINCT l_suppkey, 'q' || (l_partkey // 4), 'q' || (l_partkey // 16), 'data' FROM lineitem),
dep AS (SELECT module || ':' || node AS node, module || ':' || operand AS operand, via FROM edge e WHERE EXISTS (SELECT 1 FROM edge d WHERE d.module = e.module AND d.node = e.operand)),
root AS (SELECT DISTINCT l_suppkey || ':o' || l_orderkey AS node FROM lineitem),
""" + WALK.format(dep="dep", depth=6) + "SELECT root, node, CAST(depth AS INTEGER) AS depth, via, parent, truncated FROM slice")
def d02(spark, folder):
    li = table(spark, folder, "lineitem")
    tag = lambda t, c: F.concat(F.lit(t), c)
    k = F.col("l_partkey")
    def rows(node, operand, via):
        return li.select(F.col("l_suppkey").alias("module"), node.alias("node"), operand.alias("operand"), F.lit(via).alias("via"))

    edge = (
        rows(tag("o", F.col("l_orderkey")), tag("p", k), "data").unionByName(rows(tag("p", k), tag("q", F.floor(k / 4)), "control"))
        .unionByName(rows(tag("q", F.floor(k / 4)), tag("q", F.floor(k / 16)), "data"))
    )
    roots = li.select(F.col("l_suppkey").alias("module"), tag("o", F.col("l_orderkey")).alias("node")).distinct()
    return graph.module_slice(roots, edge, 6)


@query("D04_drivers", GR + WALK.format(dep="dep", depth=3) + """
, ref AS (SELECT 's' || s_suppkey AS node, s_name || '.scala:' || s_nationkey AS ref FROM supplier UNION ALL SELECT 'p' || p_partkey, replace(p_name, ' ', '_') || '.scala:' || p_size FROM part)
SELECT root, CAST(depth AS INTEGER) AS depth, via, node, (SELECT min(ref) FROM ref WHERE ref.node = slice.node) AS ref, truncated FROM slice WHERE depth > 0
""")
def d04(spark, folder):
    s, p = table(spark, folder, "supplier"), table(spark, folder, "part")
    refs = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat("s_name", F.lit(".scala:"), "s_nationkey").alias("ref")).unionByName(
        p.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".scala:"), "p_size").alias("ref"))
    )
    roots = order_roots(spark, folder)
    steps = graph.backward_slice(roots, dependencies(spark, folder), 3)
    return graph.drivers(graph.require_drivers(roots, steps), refs)


@query("D03_hier_slice_short", GR + WALK.format(dep="dep", depth=2) + "SELECT root, node, CAST(depth AS INTEGER) AS depth, via, parent, truncated FROM slice")
def d03s(spark, folder):
    return graph.backward_slice(order_roots(spark, folder), dependencies(spark, folder), 2)


@query("F17_module_closure", """
WITH RECURSIVE b AS (
  SELECT 'C' || c_custkey AS name, CASE c_custkey WHEN 0 THEN 'Module' WHEN 1 THEN 'Bundle' WHEN 5 THEN 'C2' WHEN 2 THEN 'C5' WHEN 7 THEN 'Mystery' ELSE 'C' || (c_custkey // 3) END AS base FROM customer),
w(name, cur, hops) AS (SELECT name, base, 1 FROM b UNION ALL SELECT w.name, b.base, hops + 1 FROM w JOIN b ON b.name = w.cur WHERE hops < 40)
SELECT b.name, EXISTS (SELECT 1 FROM w WHERE w.name = b.name AND w.cur = 'Module') AS is_module FROM b
""")
def f17(spark, folder):
    k = F.col("c_custkey")
    base = (
        F.when(k == 0, "Module").when(k == 1, "Bundle").when(k == 5, "C2").when(k == 2, "C5").when(k == 7, "Mystery")
        .otherwise(F.concat(F.lit("C"), F.floor(k / 3)))
    )
    bases = table(spark, folder, "customer").select(F.concat(F.lit("C"), k).alias("name"), base.alias("base"), k.alias("seq"))
    return graph.module_closure(bases)
