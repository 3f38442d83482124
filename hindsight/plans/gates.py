"""Values and causes over a gate tree: line items feed orders, customers, nations, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.operators import blame
from hindsight.operators.ordered import position
from hindsight.plans import runlogs
from hindsight.plans.registry import query, table
from hindsight.session import cut_dealt
from hindsight.sources import runlog

ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SPAN = 1 << 20
ORDER_OPS, CUSTOMER_OPS = ["&", "|", "^", "+"], ["&", "|", "?:", "!="]

SQL = """
WITH RECURSIVE li AS (
  SELECT *, 'l' || l_orderkey || '.' || pos AS node, CASE WHEN tax = 8 AND disc = 10 THEN NULL WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0
           WHEN l_quantity > 25 THEN 1 ELSE 0 END AS v
  FROM (SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(round(l_discount * 100) AS INTEGER) AS disc,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
            l_returnflag, l_linestatus, l_shipdate) - 1 AS pos FROM lineitem)),
ov AS (
  SELECT l_orderkey AS k, CASE WHEN count(*) <> count(v) THEN NULL ELSE CASE l_orderkey % 4 WHEN 0 THEN bit_and(v) WHEN 1 THEN bit_or(v) WHEN 2 THEN bit_xor(v)
           ELSE CAST(sum(v) AS INTEGER) END END AS v FROM li GROUP BY l_orderkey),
oo AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, ov.v FROM orders LEFT JOIN ov ON k = o_orderkey),
cv AS (
  SELECT o_custkey AS k, CASE o_custkey % 4
    WHEN 0 THEN CASE WHEN count(*) <> count(v) THEN NULL WHEN count(*) = 1 THEN CASE WHEN max(v) = 1 THEN 1 ELSE 0 END ELSE bit_and(v) END
    WHEN 1 THEN CASE WHEN count(*) <> count(v) THEN NULL WHEN count(*) = 1 THEN CASE WHEN max(v) <> 0 THEN 1 ELSE 0 END ELSE bit_or(v) END
    WHEN 2 THEN CASE WHEN max(v) FILTER (pos = 0) IS NULL THEN NULL WHEN max(v) FILTER (pos = 0) <> 0 THEN max(v) FILTER (pos = 1) ELSE max(v) FILTER (pos = 2) END
    ELSE CASE WHEN count(*) <> count(v) OR count(*) = 1 THEN NULL WHEN max(v) FILTER (pos = 0) <> max(v) FILTER (pos = 1) THEN 1 ELSE 0 END END AS v
  FROM oo GROUP BY o_custkey),
cc AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, cv.v FROM customer LEFT JOIN cv ON k = c_custkey),
nv AS (SELECT c_nationkey AS k, CASE WHEN max(v) FILTER (pos = 0) IS NULL THEN NULL WHEN max(v) FILTER (pos = 0) <> 0 THEN max(v) FILTER (pos = 1) ELSE max(v) FILTER (pos = 2) END AS v FROM cc GROUP BY 1),
nn AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, nv.v FROM nation LEFT JOIN nv ON k = n_nationkey),
rv AS (SELECT n_regionkey AS k, CASE WHEN count(*) <> count(v) THEN NULL ELSE bit_and(v) END AS v FROM nn GROUP BY 1),
val AS (
  SELECT node, CAST(v AS BIGINT) AS value FROM li UNION ALL SELECT 'o' || o_orderkey, v FROM oo UNION ALL SELECT 'c' || c_custkey, v FROM cc
  UNION ALL SELECT 'n' || n_nationkey, v FROM nn UNION ALL SELECT 'r' || k, v FROM rv),
gate AS (
  SELECT DISTINCT 'o' || l_orderkey AS node, ['&', '|', '^', '+'][l_orderkey % 4 + 1] AS op FROM lineitem UNION ALL SELECT DISTINCT 'c' || o_custkey, ['&', '|', '?:', '!='][o_custkey % 4 + 1] FROM orders
  UNION ALL SELECT DISTINCT 'n' || c_nationkey, '?:' FROM customer UNION ALL SELECT DISTINCT 'r' || n_regionkey, '&' FROM nation),
opd AS (
  SELECT 'o' || l_orderkey AS node, pos, node AS operand FROM li UNION ALL SELECT 'c' || o_custkey, pos, 'o' || o_orderkey FROM oo
  UNION ALL SELECT 'n' || c_nationkey, pos, 'c' || c_custkey FROM cc UNION ALL SELECT 'r' || n_regionkey, pos, 'n' || n_nationkey FROM nn),
sel AS (SELECT o.node, v.value AS sel FROM opd o JOIN val v ON v.node = o.operand WHERE o.pos = 0),
resp AS (
  SELECT o.node, o.pos, o.operand, ovv.value, nvv.value AS node_value FROM opd o JOIN gate g ON g.node = o.node LEFT JOIN val ovv ON ovv.node = o.operand
  LEFT JOIN val nvv ON nvv.node = o.node LEFT JOIN sel s ON s.node = o.node
  WHERE CASE WHEN g.op = '&' AND nvv.value = 0 THEN ovv.value = 0 WHEN g.op = '|' AND nvv.value <> 0 THEN coalesce(ovv.value <> 0, FALSE)
        WHEN g.op = '?:' THEN o.pos = 0 OR o.pos = CASE WHEN coalesce(s.sel, 0) <> 0 THEN 1 ELSE 2 END ELSE TRUE END),
moved AS (SELECT node, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS last_change FROM li
          UNION ALL SELECT 'o' || o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus <> 'P'
          UNION ALL SELECT 'c' || c_custkey, 3000 + c_custkey % 900 FROM customer),
fact AS (SELECT node, 'L' AS module, 'gen/l' || (l_suppkey % 9) || '.scala:' || l_linenumber AS ref, NULL AS expr FROM li
         UNION ALL SELECT 'o' || o_orderkey, 'O', 'gen/o' || (o_custkey % 5) || '.scala:1', ['&', '|', '^', '+'][o_orderkey % 4 + 1] FROM orders
         UNION ALL SELECT 'c' || c_custkey, 'C', 'gen/c.scala:2', ['&', '|', '?:', '!='][c_custkey % 4 + 1] FROM customer)
"""

WHY = """
, root AS ({roots}),
bl AS (SELECT DISTINCT node, operand, 'accounts for the value' AS via FROM resp {more}),
walk(root, node, depth) AS (SELECT root, node, 0 FROM root UNION SELECT w.root, d.operand, w.depth + 1 FROM walk w JOIN bl d ON d.node = w.node WHERE w.depth < {depth}),
near AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL),
par AS (SELECT n.root, n.node, min(struct_pack(p := d.node, v := d.via)) AS b FROM near n JOIN bl d ON d.operand = n.node
        JOIN near m ON m.root = n.root AND m.node = d.node AND m.depth = n.depth - 1 GROUP BY ALL),
deeper AS (SELECT DISTINCT n.root FROM near n JOIN bl d ON d.node = n.node WHERE n.depth = {depth} AND NOT EXISTS (SELECT 1 FROM near m WHERE m.root = n.root AND m.node = d.operand)),
chain AS (
  SELECT n.root, CAST(n.depth AS INTEGER) AS depth, n.node, CASE WHEN n.depth = 0 THEN 'root' ELSE b.v END AS via, b.p AS parent, v.value, m.last_change, f.module, f.ref, f.expr, n.root IN (FROM deeper) AS truncated
  FROM near n LEFT JOIN par USING (root, node) LEFT JOIN val v ON v.node = n.node LEFT JOIN moved m ON m.node = n.node LEFT JOIN fact f ON f.node = n.node)
"""
DIGEST = """
, hd AS (SELECT root, max(value) FILTER (depth = 0) AS rv, max(last_change) FILTER (depth = 0) AS rc, min(last_change) AS fl,
                coalesce(max(value) FILTER (depth = 0) NOT IN (0, 1), FALSE) AS dis FROM chain GROUP BY 1),
k0 AS (SELECT c.*, rv, rc, fl, dis, coalesce(c.value = rv, FALSE) AS car FROM chain c JOIN hd USING (root)
       WHERE NOT (split_part(node, '.', -1) LIKE '\\_%' ESCAPE '\\' OR node LIKE '%\\_ext.%' ESCAPE '\\' OR split_part(node, '.', -1) IN ('reset', 'clock') OR node LIKE 'TOP.%')),
k1 AS (SELECT * FROM (SELECT *, max(CASE WHEN dis AND car THEN 1 ELSE 0 END) OVER (PARTITION BY root, depth) AS any_car FROM k0) WHERE NOT dis OR any_car = 0 OR car),
an AS (SELECT root, depth AS ad, node AS anchor FROM k1 WHERE dis AND car QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth DESC, node) = 1),
und(root, node) AS (SELECT root, anchor FROM an UNION SELECT c.root, c.node FROM und u JOIN chain c ON c.root = u.root AND c.parent = u.node),
k2 AS (SELECT k1.* FROM k1 LEFT JOIN an USING (root) LEFT JOIN und u ON u.root = k1.root AND u.node = k1.node WHERE an.anchor IS NULL OR depth <= ad OR u.node IS NOT NULL),
rk AS (SELECT *, CASE WHEN dis THEN CASE WHEN car THEN 0 ELSE 1 END WHEN last_change IS NULL OR rc IS NULL OR last_change = fl THEN 1 ELSE 0 END AS g,
              CASE WHEN dis OR last_change IS NULL OR rc IS NULL OR last_change = fl THEN 0 ELSE abs(last_change - rc) END AS aw FROM k2),
digest AS (SELECT root, depth, node, value, last_change, ref, parent FROM (
  SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY root, depth ORDER BY g, aw, node) = 1) QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, node) <= 22)
, full_digest AS (SELECT digest.*, (SELECT count(DISTINCT depth) FROM rk WHERE rk.root = digest.root) > 22 AS truncated FROM digest)
"""
CUSTOMERS = WHY.format(roots="SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS node FROM customer", more="", depth=12)


def items(spark, folder) -> DataFrame:
    """Line items with their position in the order, written once for all that read it."""
    li = position(table(spark, folder, "lineitem"), ["l_orderkey"], ORDER, SPAN, "n").withColumn("pos", F.col("n") - 1)
    return blame.cut_lineage(li.drop("n", "l_partkey", "l_extendedprice", "l_linestatus"))


def tree(spark, folder, li: DataFrame | None = None):
    """gates, operands, traced"""
    li = li if li is not None else items(spark, folder)
    o = position(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], SPAN, "n").withColumn("pos", F.col("n") - 1)
    c = position(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], SPAN, "n").withColumn("pos", F.col("n") - 1)
    n = position(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], ["n_nationkey"], SPAN, "n").withColumn("pos", F.col("n") - 1)
    tag = lambda t, k: F.concat(F.lit(t), k)
    leaf = F.concat(F.lit("l"), "l_orderkey", F.lit("."), "pos")

    def inputs(df, t, key, operand):
        return df.select(tag(t, key).alias("node"), "pos", operand.alias("operand"), F.lit(0).alias("shift"), F.lit(1).alias("operand_width"))

    operands = (
        inputs(li, "o", "l_orderkey", leaf).unionByName(inputs(o, "c", "o_custkey", tag("o", "o_orderkey")))
        .unionByName(inputs(c, "n", "c_nationkey", tag("c", "c_custkey"))).unionByName(inputs(n, "r", "n_regionkey", tag("n", "n_nationkey")))
    )

    def gate(df, t, key, ops):
        op = F.element_at(F.array(*[F.lit(x) for x in ops]), (F.col(key) % len(ops) + 1).cast("int"))
        return df.select(tag(t, F.col(key)).alias("node"), op.alias("op"), F.lit(1).alias("width"), F.lit(0).alias("hi"), F.lit(0).alias("lo")).distinct()

    gates = (
        gate(table(spark, folder, "lineitem").select("l_orderkey"), "o", "l_orderkey", ORDER_OPS)
        .unionByName(gate(table(spark, folder, "orders").select("o_custkey"), "c", "o_custkey", CUSTOMER_OPS))
        .unionByName(gate(table(spark, folder, "customer").select("c_nationkey"), "n", "c_nationkey", ["?:"]))
        .unionByName(gate(table(spark, folder, "nation").select("n_regionkey"), "r", "n_regionkey", ["&"]))
    )
    tax, disc = F.round(F.col("l_tax") * 100), F.round(F.col("l_discount") * 100)
    bit = F.when((tax == 8) & (disc == 10), None).when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).when(F.col("l_quantity") > 25, 1).otherwise(0)
    traced = li.select(leaf.alias("node"), bit.cast("long").alias("value"))
    return cut_dealt(gates, ["node"]), cut_dealt(operands, ["node"]), traced


def context(spark, folder, li: DataFrame):
    """last_change and facts of the nodes"""
    leaf = F.concat(F.lit("l"), "l_orderkey", F.lit("."), "pos")
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    day = lambda col: F.datediff(F.col(col).cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    op = lambda key, ops: F.element_at(F.array(*[F.lit(x) for x in ops]), (F.col(key) % len(ops) + 1).cast("int")).alias("expr")
    onode, cnode = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "c_custkey")
    moved = (
        li.select(leaf.alias("node"), day("l_shipdate").alias("last_change"))
        .unionByName(o.where("o_orderstatus <> 'P'").select(onode.alias("node"), day("o_orderdate").alias("last_change")))
        .unionByName(c.select(cnode.alias("node"), (F.col("c_custkey") % 900 + 3000).alias("last_change")))
    )
    facts = (
        li.select(leaf.alias("node"), F.lit("L").alias("module"), F.concat(F.lit("gen/l"), F.col("l_suppkey") % 9, F.lit(".scala:"), "l_linenumber").alias("ref"), F.lit(None).cast("string").alias("expr"))
        .unionByName(o.select(onode.alias("node"), F.lit("O").alias("module"), F.concat(F.lit("gen/o"), F.col("o_custkey") % 5, F.lit(".scala:1")).alias("ref"), op("o_orderkey", ORDER_OPS)))
        .unionByName(c.select(cnode.alias("node"), F.lit("C").alias("module"), F.lit("gen/c.scala:2").alias("ref"), op("c_custkey", CUSTOMER_OPS)))
    )
    return moved, facts


@query("D05_evaluate", SQL + "SELECT node, value, CASE WHEN value IS NULL THEN 'unknown' END AS reason FROM val")
def d05(spark, folder):
    return blame.evaluate(*tree(spark, folder))


@query("D06_responsible", SQL + "SELECT * FROM resp")
def d06(spark, folder):
    gates, operands, traced = tree(spark, folder)
    return blame.responsible(gates, operands, blame.evaluate(gates, operands, traced))


def customer_chains(spark, folder, roots: DataFrame | None = None, links: DataFrame | None = None, told: bool = True, **limits) -> DataFrame:
    """Chains of ``roots``, or of all customers; values and last changes of their links only if they are ``told``."""
    li = items(spark, folder)
    gates, operands, traced = tree(spark, folder, li)
    values = blame.evaluate(gates, operands, traced)
    edges = blame.blame_edges(gates, operands, values, links=links)
    if roots is None:
        node = F.concat(F.lit("c"), "c_custkey")
        roots = table(spark, folder, "customer").select(node.alias("root"), node.alias("node"))
    moved, facts = context(spark, folder, li)
    return blame.why(roots, edges, values if told else None, moved if told else None, facts, **limits)


@query("D07_why", SQL + CUSTOMERS + "SELECT * FROM chain")
def d07(spark, folder):
    return customer_chains(spark, folder)


@query("D07_why_capped", SQL + WHY.format(roots="SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS node FROM customer", more="", depth=1) + """
, r AS (SELECT * EXCLUDE (truncated), row_number() OVER (PARTITION BY root ORDER BY depth, node) AS rn, count(*) OVER (PARTITION BY root) > 6 OR truncated AS truncated FROM chain)
SELECT * EXCLUDE (rn) FROM r WHERE rn <= 6
""")
def d07_capped(spark, folder):
    return customer_chains(spark, folder, max_depth=1, max_nodes=6)


@query("D08_element_select", SQL + """
, n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'x' || o_orderkey AS node, 'l' || o_orderkey || '.' || (n - 1 - o_custkey % 4) AS operand, o_custkey % 4 AS i
FROM orders JOIN n ON k = o_orderkey WHERE n - 1 - o_custkey % 4 >= 0
""")
def d08(spark, folder):
    _, operands, _ = tree(spark, folder)
    o = table(spark, folder, "orders")
    tag = lambda t: F.concat(F.lit(t), "o_orderkey")
    gates = o.select(F.inline(F.array(
        F.struct(tag("x").alias("node"), F.lit("index").alias("op")), F.struct(tag("o").alias("node"), F.lit("concat").alias("op"))
    )))
    reads = o.select(tag("x").alias("node"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("pos"), tag("o").alias("operand")), F.struct(F.lit(1).cast("long").alias("pos"), tag("i").alias("operand"))
    )))
    index = o.select(tag("i").alias("node"), (F.col("o_custkey") % 4).alias("value"))
    return blame.selected_elements(gates, operands.select("node", "pos", "operand").unionByName(reads), index)


@query("D09_why_cross_memory", SQL + CUSTOMERS + """
, rd AS (SELECT node, 'l' || l_orderkey AS mem FROM li WHERE pos = 0),
hop AS (SELECT 'c' || o_custkey AS root, 'l' || o_orderkey AS mem, o_orderkey AS write_cycle, 'W' || (o_orderkey % 2) AS port FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT c.root, c.depth AS "at", c.node AS "read", h.mem, h.write_cycle, h.port FROM chain c JOIN rd USING (node) JOIN hop h ON h.root = c.root AND h.mem = rd.mem
      QUALIFY row_number() OVER (PARTITION BY c.root ORDER BY c.depth, c.node, h.mem, h.write_cycle, h.port) = 1),
bel AS (SELECT 'c' || o_custkey AS root, 'l' || o_orderkey AS mem, unnest([0, 1])::INTEGER AS depth, unnest(['w' || o_orderkey, 'q' || o_orderkey]) AS node, unnest(['root', 'data']) AS via, unnest([NULL, 'w' || o_orderkey]) AS parent,
               unnest([7, NULL])::BIGINT AS value, o_orderkey AS last_change, unnest(['W', 'Q']) AS module, unnest(['w.scala:' || o_custkey, NULL]) AS ref FROM orders)
SELECT c.root, c.depth, c.node, c.via, c.parent, c.value, c.last_change, c.module, c.ref FROM chain c LEFT JOIN x USING (root) WHERE x.mem IS NULL OR NOT starts_with(c.node, x.mem || '.') OR c.node = x."read"
UNION ALL SELECT root, "at", '-- written at cycle ' || write_cycle || ' by port ' || port || ' --', 'memory', "read", NULL, write_cycle, NULL, NULL FROM x
UNION ALL SELECT b.root, CAST(b.depth + x."at" + 1 AS INTEGER), b.node, b.via, b.parent, b.value, b.last_change, b.module, b.ref FROM bel b JOIN x ON x.root = b.root AND x.mem = b.mem
""")
def d09(spark, folder):
    o = table(spark, folder, "orders")
    root, mem = F.concat(F.lit("c"), "o_custkey").alias("root"), F.concat(F.lit("l"), "o_orderkey").alias("mem")
    reads = table(spark, folder, "lineitem").select(F.concat(F.lit("l"), "l_orderkey").alias("mem")).distinct().withColumn("node", F.concat("mem", F.lit(".0")))
    hop = o.where("o_orderstatus = 'F'").select(root, mem, F.col("o_orderkey").alias("write_cycle"), F.concat(F.lit("W"), F.col("o_orderkey") % 2).alias("port"))
    w, q = F.concat(F.lit("w"), "o_orderkey"), F.concat(F.lit("q"), "o_orderkey")
    none = F.lit(None).cast("string")

    def link(depth, node, via, parent, value, module, ref):
        named = (F.lit(depth).alias("depth"), node.alias("node"), F.lit(via).alias("via"), parent.alias("parent"), F.lit(value).cast("long").alias("value"))
        return F.struct(*named, F.lit(module).alias("module"), ref.alias("ref"))

    links = F.array(link(0, w, "root", none, 7, "W", F.concat(F.lit("w.scala:"), "o_custkey")), link(1, q, "data", w, None, "Q", none))
    below = o.select(root, mem, F.inline(links), F.col("o_orderkey").alias("last_change"))
    return blame.cross_memory(customer_chains(spark, folder), reads, hop, below)


@query("D10_chain_digest", SQL + CUSTOMERS + DIGEST + "SELECT * FROM full_digest")
def d10(spark, folder):
    return blame.chain_digest(customer_chains(spark, folder))


TRACED = SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + runlogs.SQL.strip()[4:] + ",", 1) + """
, ln AS (SELECT s_suppkey AS run_id, 0 AS lane, s_suppkey % 2 AS valid, s_nationkey % 7 + 1 AS dest FROM supplier UNION ALL SELECT s_suppkey, 1, 1, s_suppkey % 7 + 1 FROM supplier),
pick AS (SELECT d.run_id, d.kind, coalesce(min(ln.lane), 0) AS lane FROM div d LEFT JOIN ln ON ln.run_id = d.run_id AND ln.valid = 1 AND ln.dest = d.reg GROUP BY ALL)
""" + WHY.format(
    roots="SELECT CAST(run_id AS VARCHAR) AS root, CASE kind WHEN 'pc' THEN 's0_vpc' ELSE 'wdata_' || lane END AS node FROM pick WHERE kind IN ('pc', 'wdata')",
    more="UNION SELECT 'wdata_0', 'c0', 'port-down' UNION SELECT 'wdata_1', 'c2', 'port-down' UNION SELECT 's0_vpc', 'c1', 'port-down'", depth=12,
) + DIGEST


@query("D11_divergence_trace", TRACED + "SELECT root, depth, node, value, last_change, ref FROM digest")
def d11(spark, folder):
    found = runlog.parse_divergence(runlogs.log_lines(spark, folder)).select("run_id", "kind", "reg")
    s = table(spark, folder, "supplier")
    state = s.select(F.col("s_suppkey").alias("run_id"), F.inline(F.array(
        F.struct(F.lit(0).alias("lane"), (F.col("s_suppkey") % 2).alias("valid"), (F.col("s_nationkey") % 7 + 1).cast("long").alias("dest")),
        F.struct(F.lit(1).alias("lane"), F.lit(1).cast("long").alias("valid"), (F.col("s_suppkey") % 7 + 1).alias("dest")),
    )))
    roots = blame.trace_roots(found, blame.committing_lane(state, found), "wdata_", "s0_vpc")
    links = spark.createDataFrame(
        [("wdata_0", "c0", "port-down"), ("wdata_1", "c2", "port-down"), ("s0_vpc", "c1", "port-down")], "node string, operand string, via string"
    )
    return blame.chain_digest(customer_chains(spark, folder, roots, links)).select("root", "depth", "node", "value", "last_change", "ref")


@query("D12_chain_files", SQL + CUSTOMERS + """
, tr AS (SELECT 'c' || c_custkey AS root, 'o' || (c_custkey % 6) || '.scala' AS file FROM customer),
nm AS (SELECT root, nullif(regexp_extract(ref, '([^/:]+\\.scala)', 1), '') AS file, split_part(node, '.', 1) AS module FROM chain)
SELECT tr.root, tr.file, count(DISTINCT nm.file) AS files, count(DISTINCT nm.module) AS modules, coalesce(bool_or(nm.file = tr.file), FALSE) AS hit FROM tr LEFT JOIN nm USING (root) GROUP BY ALL
""")
def d12(spark, folder):
    truth = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("root"), F.concat(F.lit("o"), F.col("c_custkey") % 6, F.lit(".scala")).alias("file")
    )
    return blame.chain_files(customer_chains(spark, folder, told=False), truth)


@query("D14_chain_export", SQL + CUSTOMERS + DIGEST + """
, lk AS (SELECT root, count(*) AS n_links, '[' || string_agg('{"depth":' || depth || ',"signal":"' || node || '"' || CASE WHEN value IS NULL THEN '' ELSE ',"value":' || value END
           || CASE WHEN last_change IS NULL THEN '' ELSE ',"stopped":' || last_change END || ',"block":"' || CASE WHEN node LIKE 'c%' THEN 'Customer' WHEN node LIKE 'o%' THEN 'Order' ELSE 'Core' END || '"}', ',' ORDER BY depth) || ']' AS links,
           min(last_change) AS lo0, max(last_change) AS hi0 FROM digest GROUP BY 1)
SELECT 'c' || c_custkey AS root, c_mktsegment AS kind, coalesce(n_links, 0) AS n_links, links,
       CASE WHEN c_nationkey < 5 THEN c_custkey ELSE lo0 END AS window_lo, CASE WHEN c_nationkey < 5 THEN c_custkey + 100 ELSE hi0 END AS window_hi
FROM customer LEFT JOIN lk ON root = 'c' || c_custkey
""")
def d14(spark, folder):
    from hindsight.operators.discover import block_of

    c = table(spark, folder, "customer")
    root = F.concat(F.lit("c"), "c_custkey").alias("root")
    windows = c.where("c_nationkey < 5").select(root, F.col("c_custkey").alias("lo"), (F.col("c_custkey") + 100).alias("hi"))
    heads = c.select(root, F.col("c_mktsegment").alias("kind"))
    block = block_of(F.col("node"), [("c", "Customer"), ("o", "Order")], "Core")
    return blame.chain_export(blame.chain_digest(customer_chains(spark, folder)), heads, windows, block)
