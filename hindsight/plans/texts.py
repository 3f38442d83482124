"""Text evidence over ``documents``, mutation sites over ``pages``, draws over ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.operators import evidence, sites
from hindsight.plans import ledger as led
from hindsight.plans.registry import query, table
from hindsight.session import own_folder
from hindsight.sources import ledger as jsonl

SQL = """
WITH docs AS (SELECT doc_id, lang AS run_id, source || '/' || lang || '/' || doc_id AS file, text FROM documents),
split AS (SELECT run_id, file, string_split(text, chr(10)) AS parts FROM docs),
ln AS (SELECT run_id, file, unnest(parts) AS text, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no FROM split),
sz AS (SELECT run_id, file, len(parts) AS lines FROM split)
"""


def texts(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.col("lang").alias("run_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("file"), "text")


def lines(spark, folder, base: int = 0) -> DataFrame:
    return evidence.split_lines(texts(spark, folder), base)


@query("E01_sizes", SQL + "SELECT * FROM sz")
def e01(spark, folder):
    return evidence.sizes(lines(spark, folder))


@query("E02_read_slice", SQL + "SELECT l.*, 8 < lines AS truncated FROM ln l JOIN sz USING (run_id, file) WHERE line_no BETWEEN 3 AND 7")
def e02(spark, folder):
    return evidence.read_slice(lines(spark, folder), 3, 5)


GREP = """
, m AS (SELECT run_id, file, line_no AS match FROM ln WHERE text LIKE '%the %'),
b AS (SELECT m.*, l.line_no, l.text FROM m JOIN ln l ON l.run_id = m.run_id AND l.file = m.file AND l.line_no BETWEEN match - {c} AND match + {c}),
r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o} match, line_no) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM b)
"""


@query("E03_grep", SQL + GREP.format(c=2, k="run_id, file", o="") + "SELECT run_id, file, match, line_no, text, n > 100 AS truncated FROM r WHERE rn <= 100")
def e03(spark, folder):
    return evidence.grep(lines(spark, folder), "the ", context=2, limit=100)


@query("E04_tail", SQL + "SELECT l.*, lines > 3 AS truncated FROM ln l JOIN sz USING (run_id, file) WHERE line_no >= lines - 3")
def e04(spark, folder):
    return evidence.tail(lines(spark, folder), 3)


@query("E05_list_files", SQL + "SELECT * FROM sz WHERE regexp_matches(file, '/(en|fr)/[0-9]*[13579]$')")
def e05(spark, folder):
    return evidence.list_files(lines(spark, folder), "/(en|fr)/[0-9]*[13579]$")


@query("E06_read_source", SQL + """
SELECT run_id, file, CAST(line_no + 1 AS INTEGER) AS line_no, text, 11 < lines AS truncated FROM ln JOIN sz USING (run_id, file) WHERE line_no BETWEEN 1 AND 10
""")
def e06(spark, folder):
    return evidence.read_slice(lines(spark, folder, 1), 2, 10, base=1)


@query("E07_search_source", SQL.replace("CAST(unnest(range(len(parts))) AS INTEGER)", "CAST(unnest(range(len(parts))) + 1 AS INTEGER)")
       .replace("ln AS (", "ln0 AS (").replace("\nsz AS", "\nln AS (SELECT * FROM ln0 WHERE regexp_matches(file, '[02468]$')),\nsz AS")
       + GREP.format(c=1, k="run_id", o="file,") + "SELECT run_id, file, match, line_no, text, n > 60 AS truncated FROM r WHERE rn <= 60")
def e07(spark, folder):
    return evidence.search_source(lines(spark, folder, 1), "the ", "[02468]$", context=1)


# the SQL counts edits in bytes, so letters of two bytes stand as one control character there, each as its own
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
STAND_INS = " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 25)])

PROBES = """
WITH docs AS (SELECT lang AS run_id, source || '/' || lang || '/' || doc_id AS file, text FROM documents),
ln AS (SELECT run_id, file, trim(unnest(string_split(text, chr(10)))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) + 1 AS line_no FROM docs),
d AS (SELECT run_id, file, line, min(line_no) AS line_no, count(*) AS copies FROM ln WHERE line <> '' GROUP BY ALL),
pr AS (SELECT run_id, file, trim(replace(substr(string_split(text, chr(10))[1], 1, 60), 'e', '3')) AS probe FROM docs),
s AS (SELECT pr.*, d.line, d.line_no, d.copies, 1 - levenshtein(translate(line, '{LETTERS}', {STAND_INS}), translate(probe, '{LETTERS}', {STAND_INS})) / greatest(length(line), length(probe)) AS similarity
      FROM pr JOIN d USING (run_id, file) WHERE probe <> '' AND least(length(line), length(probe)) / greatest(length(line), length(probe)) >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, file, probe ORDER BY similarity DESC, line DESC) AS rank FROM s WHERE similarity >= 0.5),
b AS (SELECT *, least(copies, 2 - coalesce(sum(copies) OVER (PARTITION BY run_id, file, probe ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS places FROM k WHERE rank <= 2)
""".replace("{LETTERS}", LETTERS).replace("{STAND_INS}", STAND_INS)


def probes(spark, folder):
    docs = texts(spark, folder)
    first = F.split("text", "\n")[0]
    asked = docs.select("run_id", "file", F.trim(F.replace(F.substring(first, 1, 60), F.lit("e"), F.lit("3"))).alias("probe"))
    return asked, evidence.split_lines(docs, 1)


@query("E08_nearest_lines", PROBES + "SELECT run_id, file, probe, line, line_no, similarity, CAST(places AS BIGINT) AS places FROM b WHERE places > 0")
def e08(spark, folder):
    return evidence.nearest_lines(*probes(spark, folder))


@query("E08_nearest_lines_close", PROBES.replace(">= 0.5", ">= 0.8") + "SELECT run_id, file, probe, line, line_no, similarity, CAST(places AS BIGINT) AS places FROM b WHERE places > 0")
def e08c(spark, folder):
    return evidence.nearest_lines(*probes(spark, folder), cutoff=0.8)


EDITS = """
WITH docs AS (SELECT doc_id, lang AS run_id, source || '/' || lang || '/' || doc_id AS file, text FROM documents),
p AS (SELECT doc_id, run_id, CASE WHEN doc_id % 13 = 5 THEN file || '.gone' ELSE file END AS file,
             CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 30) WHEN 1 THEN substr(text, 20, 2) WHEN 2 THEN substr(text, 1, 12) || '~~' ELSE substr(text, length(text) - 24, 20) END AS old,
             CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 30) ELSE 'changed' END AS new FROM docs)
"""


def edits(spark, folder) -> DataFrame:
    t, k, n = F.col("text"), F.col("doc_id"), F.length("text")
    # from place 0 on SQL counts a character that is not there
    size = F.when(n == 24, 19).otherwise(20)
    old = (
        F.when(k % 4 == 0, F.substring(t, 5, 30)).when(k % 4 == 1, F.substring(t, 20, 2))
        .when(k % 4 == 2, F.concat(F.substring(t, 1, 12), F.lit("~~"))).otherwise(F.substring(t, n - 24, size))
    )
    return texts(spark, folder).select(
        "doc_id", "run_id", F.when(k % 13 == 5, F.concat("file", F.lit(".gone"))).otherwise(F.col("file")).alias("file"),
        old.alias("old"), F.when(k % 3 == 0, F.substring(t, 5, 30)).otherwise("changed").alias("new"),
    )


@query("E09_validate_proposal", EDITS + """
, j AS (SELECT p.*, d.text, CASE WHEN length(old) > 0 THEN (length(text) - length(replace(text, old, ''))) // length(old) ELSE 0 END AS n
        FROM p LEFT JOIN docs d ON d.file = p.file),
s AS (SELECT *, CASE WHEN text IS NULL THEN 'no such file' WHEN n = 0 THEN 'no match' WHEN n > 1 THEN n || ' matches' WHEN old = new THEN 'no-op' ELSE 'registered' END AS status FROM j)
SELECT doc_id, run_id, file, old, new, status, CASE WHEN status = 'registered' THEN CAST(len(string_split(substr(text, 1, position(old IN text) - 1), chr(10))) AS INTEGER) END AS line_no FROM s
""")
def e09(spark, folder):
    return evidence.validate_proposals(edits(spark, folder), texts(spark, folder).drop("doc_id"))


@query("E10_tamper_check", """
WITH p AS (SELECT p_partkey, repeat('assert (a) ', p_size % 3) || repeat('require(b) ', p_size % 4) || repeat('printf("c") ', p_size % 2) AS old,
                  repeat('assert(a) ', p_size % 2) || repeat('require(b) ', p_size % 3) || 'xassert(z) ' || repeat('printf("c") ', p_size % 5) AS new, p_size % 3 - p_size % 2 AS a,
                  p_size % 4 - p_size % 3 AS b, p_size % 2 - p_size % 5 AS c FROM part)
SELECT p_partkey, CASE WHEN a > 0 THEN 'removes or weakens a Chisel assertion' WHEN b > 0 THEN 'removes an elaboration-time contract'
       WHEN c > 0 THEN 'edits the commit-log printf the harness reads' END AS reason FROM p
""")
def e10(spark, folder):
    p = table(spark, folder, "part")
    rep = lambda s, n: F.expr(f"repeat('{s}', p_size % {n})")
    old = F.concat(rep("assert (a) ", 3), rep("require(b) ", 4), rep('printf("c") ', 2))
    new = F.concat(rep("assert(a) ", 2), rep("require(b) ", 3), F.lit("xassert(z) "), rep('printf("c") ', 5))
    return p.select("p_partkey", old.alias("old"), new.alias("new")).select(
        "p_partkey", evidence.tamper_reason(F.col("old"), F.col("new")).alias("reason")
    )


@query("E11_patch_attribution", """
WITH d AS (SELECT doc_id, text, position('.' IN text) - 1 AS pos FROM documents WHERE position('.' IN text) > 0),
m AS (SELECT doc_id, text, pos, substr(text, 1, pos) || '!' || substr(text, pos + 2) AS mutated, 'f' || doc_id AS site_path,
             len(string_split(substr(text, 1, pos), chr(10))) AS site_line, 'f' || CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS path FROM d),
p AS (SELECT *, substr(mutated, greatest(1, pos - 4), 11) AS old FROM m),
n AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN replace(old, '!', '.') ELSE old || 'x' END AS new, (length(mutated) - length(replace(mutated, old, ''))) // length(old) = 1 AS applied FROM p),
r AS (SELECT *, CASE WHEN applied THEN CAST(len(string_split(substr(mutated, 1, position(old IN mutated) - 1), chr(10))) AS INTEGER) END AS patched_line, applied AND path = site_path AS same_file FROM n)
SELECT doc_id, applied, patched_line, same_file, same_file AND abs(patched_line - site_line) <= 2 AS same_line, same_file AND replace(mutated, old, new) = text AS exact_revert FROM r
""")
def e11(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", (F.position(F.lit("."), "text") - 1).alias("site_start")).where("site_start >= 0")
    at, k = F.col("site_start"), F.col("doc_id")
    mutated = F.concat(F.substring("text", F.lit(1), at), F.lit("!"), F.substring(F.col("text"), at + 2, F.length("text")))
    m = d.select(
        "doc_id", "site_start", mutated.alias("mutated"), F.concat(F.lit("f"), k).alias("site_path"),
        evidence.line_at(F.col("text"), at + 1).alias("site_line"), F.lit(".").alias("before"), F.lit("!").alias("after"),
        F.concat(F.lit("f"), F.when(k % 5 == 0, k + 1).otherwise(k)).alias("path"),
    ).withColumn("old", F.substring(F.col("mutated"), F.greatest(F.lit(1), at - 4), F.lit(11)))
    m = m.withColumn("new", F.when(k % 2 == 0, F.replace("old", F.lit("!"), F.lit("."))).otherwise(F.concat("old", F.lit("x"))))
    return evidence.attribute_patches(m).select("doc_id", "applied", "patched_line", "same_file", "same_line", "exact_revert")


@query("E12_last_proposal", """
WITH a AS (SELECT l_orderkey AS episode, l_linenumber * 1000000000000 + l_partkey * 10000 + CAST(l_quantity AS BIGINT) AS seq, l_returnflag = 'R' AS accepted, 'edit ' || l_partkey AS proposal
           FROM lineitem WHERE l_returnflag <> 'N'),
g AS (SELECT episode, arg_max(proposal, seq) FILTER (accepted) AS proposal, count(*) FILTER (accepted) AS acc, count(*) FILTER (NOT accepted) AS rejected FROM a GROUP BY 1),
e AS (SELECT o_orderkey AS episode, CASE WHEN o_orderstatus = 'P' THEN 'reset' END AS error, proposal, coalesce(acc, 0) AS acc, coalesce(rejected, 0) AS rejected FROM orders LEFT JOIN g ON episode = o_orderkey)
SELECT episode, CASE WHEN acc > 0 THEN 'proposed' WHEN error IS NOT NULL THEN 'lost' ELSE 'no-proposal' END AS verdict, proposal, rejected,
       CASE WHEN acc = 0 AND error IS NULL THEN CASE WHEN rejected > 0 THEN 'every anchor was rejected' ELSE 'nothing was proposed' END END AS reason FROM e
""")
def e12(spark, folder):
    seq = F.col("l_linenumber") * F.lit(1_000_000_000_000) + F.col("l_partkey") * 10000 + F.col("l_quantity").cast("long")
    attempts = table(spark, folder, "lineitem").where("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("episode"), seq.alias("seq"), (F.col("l_returnflag") == "R").alias("accepted"),
        F.concat(F.lit("edit "), "l_partkey").alias("proposal"),
    )
    episodes = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("episode"), F.when(F.col("o_orderstatus") == "P", "reset").alias("error")
    )
    return evidence.last_proposals(episodes, attempts)


# ---- mutation sites ------------------------------------------------------------

PAGES = """
WITH pg AS (SELECT 'page/' || page_id AS path, replace(html, '><', '>' || chr(10) || '<') AS text FROM pages)
"""
PLACE = """
, placed AS (
  SELECT *, substr(text, 1, CAST(start AS BIGINT)) AS pre FROM pieces),
site AS (
  SELECT path, CAST(start AS INTEGER) AS start, CAST(start + length(before) AS INTEGER) AS "end", before, "after", operator, cls,
         CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS line, CAST(length(string_split(pre, chr(10))[-1]) + 1 AS INTEGER) AS col,
         trim(string_split(text, chr(10))[1 + length(pre) - length(replace(pre, chr(10), ''))], ' ' || chr(9) || chr(13)) AS context FROM placed)
"""
RULES = (
    ("</li>", "</dd>", "li_to_dd", "constant-flip"),
    ("<a href=", "<b href=", "a_to_b", "index-arithmetic"),
    ("</p>", "</q>", "p_to_q", "constant-flip"),
)
CONSTANTS = PAGES + """
, rules AS (SELECT * FROM (VALUES ('</li>', '</dd>', 'li_to_dd', 'constant-flip'), ('<a href=', '<b href=', 'a_to_b', 'index-arithmetic'), ('</p>', '</q>', 'p_to_q', 'constant-flip')) t(before, "after", operator, cls)),
cut AS (SELECT path, text, before, "after", operator, cls, string_split(text, before) AS parts FROM pg, rules),
u AS (SELECT * EXCLUDE (parts), unnest(parts[1:len(parts) - 1]) AS piece, unnest(range(len(parts) - 1)) AS i FROM cut WHERE len(parts) > 1),
pieces AS (SELECT *, sum(length(piece)) OVER (PARTITION BY path, operator ORDER BY i) + i * length(before) AS start FROM u)
""" + PLACE


def page_texts(spark, folder) -> DataFrame:
    p = table(spark, folder, "pages")
    return p.select(F.concat(F.lit("page/"), "page_id").alias("path"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"))


def constant_sites(spark, folder) -> DataFrame:
    return sites.constant_sites(page_texts(spark, folder), RULES)


@query("F01_token_sites", PAGES + """
, ops AS (SELECT path, text, regexp_extract_all(text, '[!#%&*+\\-/:<=>?@\\\\^|~]+') AS toks, string_split_regex(text, '[!#%&*+\\-/:<=>?@\\\\^|~]+') AS parts FROM pg),
u AS (SELECT path, text, unnest(toks) AS before, unnest(parts[1:len(toks)]) AS piece, unnest(range(len(toks))) AS i FROM ops),
o AS (SELECT *, sum(length(piece)) OVER w + sum(length(before)) OVER w - length(before) AS start FROM u WINDOW w AS (PARTITION BY path ORDER BY i)),
swaps AS (SELECT * FROM (VALUES ('===', '=/=', 'eq_to_ne', 'comparison-inversion'), ('=/=', '===', 'ne_to_eq', 'comparison-inversion'), ('<', '<=', 'lt_to_le', 'boundary-off-by-one'),
  ('<=', '<', 'le_to_lt', 'boundary-off-by-one'), ('>', '>=', 'gt_to_ge', 'boundary-off-by-one'), ('>=', '>', 'ge_to_gt', 'boundary-off-by-one'),
  ('&&', '||', 'and_to_or', 'condition-logic'), ('||', '&&', 'or_to_and', 'condition-logic')) t(before, "after", operator, cls)),
pieces AS (SELECT o.*, s."after", s.operator, s.cls FROM o JOIN swaps s USING (before))
""" + PLACE + "SELECT * FROM site")
def f01(spark, folder):
    return sites.token_sites(page_texts(spark, folder))


@query("F02_constant_sites", CONSTANTS + "SELECT * FROM site")
def f02(spark, folder):
    return constant_sites(spark, folder)


@query("F03_site_exclusion", CONSTANTS + """
SELECT path, start, operator, CASE WHEN path LIKE '%page/1%' THEN 'first hundred' WHEN context LIKE '%The%' THEN 'names The' WHEN context LIKE '%<li>%' THEN 'list item' END AS reason FROM site
""")
def f03(spark, folder):
    marked = sites.split_excluded(
        constant_sites(spark, folder), [("page/1", "first hundred")], [("The", "names The"), ("<li>", "list item")]
    )
    return marked.select("path", "start", "operator", "reason")


# text that holds what the default rules look for, next to what they must leave alone
RULED = """
WITH pg AS (
  SELECT CASE WHEN p_partkey % 7 = 0 THEN 'ifu/bpd/' ELSE 'exu/' END || p_partkey || '.scala' AS path,
         '// part ' || p_partkey || chr(10) || repeat('  x := io.firex + io.un_true.Bz' || chr(10), p_size % 4) || '  when (io.a' || p_size || '.fire() && b.fire) {' || chr(10)
         || CASE p_partkey % 3 WHEN 0 THEN '    perf_count := n + 1.U' WHEN 1 THEN '    idx := n -1.U' ELSE '    idx := n +' || chr(10) || '      1.U' END || chr(10)
         || CASE WHEN p_size % 2 = 0 THEN '    ok := true.B' || chr(9) || '// core_perf_tick' ELSE chr(9) || 'ok := false.B ' END || chr(10) || '  }' AS text FROM part),
needles AS (SELECT * FROM (VALUES
  ('.fire() ', 0, '.fire()', '.valid', 'fire_to_valid', 'handshake-protocol'), ('b.fire)', 1, '.fire', '.valid', 'fire_to_valid', 'handshake-protocol'),
  ('n + 1.U', 2, '+ 1.U', '- 1.U', 'inc_to_dec', 'index-arithmetic'), ('n +' || chr(10) || '      1.U', 2, '+' || chr(10) || '      1.U', '- 1.U', 'inc_to_dec', 'index-arithmetic'),
  ('n -1.U', 2, '-1.U', '+ 1.U', 'dec_to_inc', 'index-arithmetic'), ('= true.B', 2, 'true.B', 'false.B', 'true_to_false', 'constant-flip'),
  ('= false.B', 2, 'false.B', 'true.B', 'false_to_true', 'constant-flip')) t(needle, lead, before, "after", operator, cls)),
pieces AS (SELECT *, strpos(text, needle) - 1 + lead AS start FROM pg JOIN needles ON contains(text, needle))
""" + PLACE


def ruled_texts(spark, folder) -> DataFrame:
    part, size = F.col("p_partkey"), F.col("p_size")
    lf, tab = F.lit("\n"), F.lit("\t")
    step = F.when(part % 3 == 0, "    perf_count := n + 1.U").when(part % 3 == 1, "    idx := n -1.U").otherwise("    idx := n +\n      1.U")
    flag = F.when(size % 2 == 0, F.concat(F.lit("    ok := true.B"), tab, F.lit("// core_perf_tick"))).otherwise(F.concat(tab, F.lit("ok := false.B ")))
    text = F.concat(
        F.lit("// part "), part, lf, F.repeat(F.lit("  x := io.firex + io.un_true.Bz\n"), (size % 4).cast("int")), F.lit("  when (io.a"), size,
        F.lit(".fire() && b.fire) {\n"), step, lf, flag, lf, F.lit("  }"),
    )
    path = F.concat(F.when(part % 7 == 0, "ifu/bpd/").otherwise("exu/"), part, F.lit(".scala"))
    return table(spark, folder, "part").select(path.alias("path"), text.alias("text"))


@query("F02_default_rules", RULED + "SELECT * FROM site")
def f02_default(spark, folder):
    return sites.constant_sites(ruled_texts(spark, folder))


@query("F03_default_exclusion", RULED + """
SELECT path, start, operator, CASE WHEN path LIKE 'ifu/bpd/%' THEN 'predictor' WHEN context LIKE 'perf_count %' THEN 'event counts' WHEN context LIKE '%core_perf_tick' THEN 'event wiring' END AS reason FROM site
""")
def f03_default(spark, folder):
    return sites.split_excluded(sites.constant_sites(ruled_texts(spark, folder))).select("path", "start", "operator", "reason")


@query("F04_mutant_id", CONSTANTS + """
, ids AS (SELECT *, substr(sha256(concat_ws(':', path, line, col, operator)), 1, 12) AS mutant_id FROM site),
rec AS (SELECT DISTINCT CASE WHEN operator = 'a_to_b' THEN path || '.gone' ELSE path END AS path, line, operator, before FROM ids),
f AS (SELECT path, line, operator, before, arg_min(mutant_id, start) AS mutant_id FROM ids GROUP BY ALL)
SELECT path, line, operator, before, path || '@' || line AS task, mutant_id FROM rec LEFT JOIN f USING (path, line, operator, before)
""")
def f04(spark, folder):
    found = constant_sites(spark, folder)
    recorded = found.select(
        F.when(F.col("operator") == "a_to_b", F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), "line", "operator", "before"
    ).distinct().withColumn("task", F.concat_ws("@", "path", "line"))
    return sites.rederive(recorded, found)


# ---- draws and queues ------------------------------------------------------------

DRAW = """
WITH pool AS (SELECT p_partkey AS key, p_type AS cls FROM part),
s5 AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY cls ORDER BY sha256(concat_ws(':', 7, key)), key) <= 25),
early AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 47 AND l_returnflag = 'R'),
s6 AS (SELECT * FROM pool ANTI JOIN early USING (key) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY sha256(concat_ws(':', 7, key)), key) <= 25)
"""


def pool(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("cls"))


@query("F05_class_balanced_sample", DRAW + "SELECT key, cls FROM s5")
def f05(spark, folder):
    return sites.class_balanced(pool(spark, folder), 25, 7)


def second_draw(spark, folder) -> DataFrame:
    early = table(spark, folder, "lineitem").where("l_quantity > 47 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("key"))
    return sites.class_balanced(sites.disjoint(pool(spark, folder), early), 25, 7)


@query("F06_disjoint_draw", DRAW + "SELECT key, cls FROM s6")
def f06(spark, folder):
    return second_draw(spark, folder)


@query("F07_round_robin_shard", DRAW + "SELECT key, cls, CAST((row_number() OVER (ORDER BY key) - 1) % 4 AS INTEGER) AS shard FROM s6")
def f07(spark, folder):
    return sites.shard_of(second_draw(spark, folder), ["key"], 4)


@query("F08_resume", DRAW + "SELECT key, cls FROM s5 WHERE key NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def f08(spark, folder):
    done = table(spark, folder, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("key"))
    return sites.pending(sites.class_balanced(pool(spark, folder), 25, 7), done, ["key"])


@query("F19_open_cells", led.SQL + """
, done AS (SELECT DISTINCT task, arm, seed FROM led WHERE queries = 50 AND verdict <> 'lost')
SELECT s_suppkey AS task, a.arm, s.seed FROM supplier CROSS JOIN (SELECT unnest(['O', 'F']) AS arm) a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7])::INTEGER AS seed) s
ANTI JOIN done d ON d.task = s_suppkey AND d.arm = a.arm AND d.seed = s.seed
""")
def f19(spark, folder):
    done = led.ledger(spark, folder).where("queries = 50 AND verdict <> 'lost'")
    tasks = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("task"))
    return sites.open_cells(tasks, led.ARMS, list(range(1, 8)), done)


@query("F19_pending_queue", led.SQL + """
, v AS (SELECT DISTINCT l_partkey AS task, arm, seed FROM led WHERE queries > 10 AND tax < 4)
SELECT eid, l_partkey AS task, p.arm, p.seed FROM led p ANTI JOIN v ON v.task = p.l_partkey AND v.arm = p.arm AND v.seed = p.seed
WHERE verdict IN ('fixed', 'not-fixed') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)
""")
def f19b(spark, folder):
    rows = led.ledger(spark, folder).withColumn("task", F.col("l_partkey"))
    tasks = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("task"))
    proposals = rows.where(F.col("verdict").isin("fixed", "not-fixed"))
    return sites.verify_queue(proposals, rows.where("queries > 10 AND tax < 4"), tasks, ["task", "arm", "seed"]).select("eid", "task", "arm", "seed")


@query("A26_manifest_load", """
WITH m AS (SELECT o_custkey AS task, year(o_orderdate) % 3 + 1 AS draw, o_orderkey AS seq, CASE WHEN o_totalprice > 200000 THEN 'killed' ELSE 'survived' END AS verdict,
                  CASE o_orderstatus WHEN 'F' THEN 'divergence' WHEN 'O' THEN 'assertion' ELSE 'timeout' END AS kind, '/w/' || o_orderkey || '.vcd' AS dump, o_orderpriority FROM orders),
k AS (SELECT * FROM m WHERE verdict = 'killed' AND kind <> 'timeout' QUALIFY row_number() OVER (PARTITION BY task ORDER BY draw, seq) = 1),
r AS (SELECT task, max('/r' || dump) AS rd FROM m WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT task, CAST(draw AS INTEGER) AS draw, kind, coalesce(rd, dump) AS dump FROM k LEFT JOIN r USING (task)
""")
def a26(spark, folder):
    o = table(spark, folder, "orders")
    manifest = o.select(
        F.col("o_custkey").alias("task"), (F.year("o_orderdate") % 3 + 1).alias("draw"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_totalprice") > 200000, "killed").otherwise("survived").alias("verdict"),
        F.when(F.col("o_orderstatus") == "F", "divergence").when(F.col("o_orderstatus") == "O", "assertion").otherwise("timeout").alias("kind"),
        F.concat(F.lit("/w/"), "o_orderkey", F.lit(".vcd")).alias("dump"), "o_orderpriority",
    )
    path = own_folder(spark)
    jsonl.append_ledger(manifest, path)
    manifest = jsonl.read_ledger(spark, path, manifest.schema)
    again = manifest.where(F.col("o_orderpriority").startswith("1")).select("task", F.concat(F.lit("/r"), "dump").alias("dump"))
    return jsonl.load_tasks(manifest, again)


@query("A28_ledger_sink", led.SQL + """
SELECT to_json({'task': task, 'arm': arm, 'seed': seed, 'verdict': verdict, 'tokens': tokens, 'file': file})::VARCHAR AS value FROM led
""")
def a28(spark, folder):
    rows, path = led.ledger(spark, folder).select("task", "arm", "seed", "verdict", "tokens", "file"), own_folder(spark)
    for part in (rows.where("seed % 2 = 0"), rows.where("seed % 2 <> 0 OR seed IS NULL")):
        jsonl.append_ledger(part, path)
    return spark.read.text(path)
