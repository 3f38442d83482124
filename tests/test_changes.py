"""Change logs: as-of answers, names, caps and the read-only guard."""

import pytest
from pyspark.sql import functions as F

from hindsight.functions.names import to_absolute, to_relative
from hindsight.functions.values import hex_text, hex_to_u64
from hindsight.operators import asof, discover, results, sites, stall
from hindsight.operators.ordered import ranked, running
from hindsight.sources import changes, dump, lines
from tests.conftest import bag

WAVE = "run_id string, signal_id long, time long, cycle long, value long, seq long"
SIGNAL = "run_id string, signal_id long, path string, scope string, name string"


@pytest.fixture(scope="module")
def store(frame):
    wave = frame(WAVE, *[
        ("a", i, t, c, v, n) for n, (i, t, c, v) in enumerate(
            [(1, 1000, 10, 1), (2, 1000, 10, 5), (2, 3000, 12, 6), (2, 5000, 14, 7), (3, 1000, 10, 0), (3, 7000, 16, 1)]
        )
    ])
    signal = frame(
        SIGNAL, ("a", 1, "top.core.rob.rob_state", "top.core.rob", "rob_state"),
        ("a", 2, "top.core.rob.com_idx", "top.core.rob", "com_idx"), ("a", 3, "top.core.lsu.busy", "top.core.lsu", "busy"),
    )
    return wave, signal


def test_stable_signal_is_never_absent(store):
    rows = asof.trace(*store, 12, 20).where("path like '%rob_state'")
    assert bag(rows, "value", "entering") == [(1, True)]


def test_state_looks_back_only(store):
    got = dict((p, (v, c)) for p, v, c in bag(asof.state_at(*store, 13), "path", "value", "last_change"))
    assert got["top.core.rob.rob_state"] == (1, 10)
    assert got["top.core.rob.com_idx"] == (6, 12)
    at11 = asof.state_at(*store, 11).where("path like '%com_idx'")
    assert bag(at11, "value") == [(5,)]


def test_changed_only(store):
    wave, signal = store
    rob = asof.in_scopes(signal, ["top.core.rob"])
    assert asof.changed_at(wave, rob, 12).count() == 1
    assert asof.changed_at(wave, rob, 13).count() == 0


def test_window_ends_and_order(store):
    assert asof.in_window(*store, 10, 14).count() == 5
    with pytest.raises(ValueError):
        asof.in_window(*store, 20, 10)


def test_caps_tell_the_truth(store):
    rows = asof.in_window(*store, 0, 100)
    order = [F.col("cycle"), F.col("path")]
    assert {r.truncated for r in results.capped(rows, order, 2).collect()} == {True}
    assert {r.truncated for r in results.capped(rows, order, 6).collect()} == {False}
    per_key = results.capped_per_key(rows, ["path"], [F.col("cycle")], 2)
    assert {(r.path, r.truncated) for r in per_key.collect()} == {
        ("top.core.rob.rob_state", False), ("top.core.rob.com_idx", True), ("top.core.lsu.busy", False)
    }


def test_aliases_all_report(frame):
    wave = frame(WAVE, ("a", 7, 10, 1, 0, 0), ("a", 7, 20, 2, 1, 1))
    metas = frame("run_id string, signal_id long, path string", ("a", 7, "top.a"), ("a", 7, "top.b"), ("a", 9, "top.a"))
    signal = changes.signal_catalog(metas)
    assert bag(asof.state_at(wave, signal, 5), "path", "value") == [("top.a", 1), ("top.b", 1)]
    assert changes.signal_catalog(metas, existing=signal).count() == 0


def test_snapshot_equals_single_states(store):
    snap = asof.snapshot(*store, [9, 11, 14])
    for c in (11, 14):
        assert bag(snap.where(F.col("at") == c), "path", "value", "last_change") == bag(
            asof.state_at(*store, c), "path", "value", "last_change"
        )
    assert snap.where("at = 9").count() == 0


def test_asof_join_does_not_depend_on_the_span(spark, frame):
    left = spark.range(200).select(F.lit("k").alias("run_id"), F.col("id").alias("t"))
    right = spark.range(0, 200, 7).select(F.lit("k").alias("run_id"), F.col("id").alias("t"), (F.col("id") * 10).alias("v"))
    want = [(t, (t // 7) * 70) for t in range(200)]
    for span in (1, 5, 64, 1000):
        from hindsight.operators.ordered import asof_join

        got = asof_join(left, right, ["run_id"], "t", "t", {"v": "v"}, span)
        assert sorted((r.t, r.v) for r in got.collect()) == want


def test_chunked_position_and_neighbours(spark):
    from hindsight.operators.ordered import following, position, previous

    df = spark.range(100).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("x"))
    for span in (2, 10, 1000):
        assert sorted((r.x // 3 + 1, r.n) for r in position(df, ["k"], ["x"], span, "n").collect()) == [(i, i) for i in range(1, 101)]
        assert {r.p for r in previous(df, ["k"], ["x"], span, {"p": "x"}).where("x = 30").collect()} == {27}
        assert {r.p for r in following(df, ["k"], ["x"], span, {"p": "x"}).where("x = 30").collect()} == {33}


def test_inflight(frame):
    names = ["rob_state", "rob_val_0", "rob_val_1", "rob_head"]
    wave = frame(WAVE, *[("a", i, 1000, 10, v, i) for i, v in enumerate([1, 1, 0, 7])])
    signal = frame(SIGNAL, *[("a", i, f"top.core.rob.{n}", "top.core.rob", n) for i, n in enumerate(names)])
    got = asof.inflight(wave, signal, 10, "rob_val_", ["rob_head", "rob_state"])
    assert bag(got, "name", "value") == [("rob_head", 7), ("rob_state", 1), ("rob_val_0", 1)]
    assert discover.find_signals(signal, "rob_val_[0-9]$").count() == 2


def test_unknown_names_get_suggestions(store, frame):
    asked = frame("run_id string, name string", ("a", "top.core.rob.rob_state"), ("a", "top.wrong.com_idx"), ("a", "top.none"))
    got = discover.resolve_names(asked, store[1])
    assert bag(got, "name", "found", "suggestion") == [
        ("top.core.rob.rob_state", True, None), ("top.none", False, None), ("top.wrong.com_idx", False, "top.core.rob.com_idx"),
    ]


def test_empty_scope_selection_is_an_error(store):
    assert discover.scope_select(store[1], ["top.core.rob"]).count() == 2
    assert discover.scope_select(store[1], ["top.core.*"]).count() == 0
    with pytest.raises(ValueError):
        discover.select_strict(store[1], ["top.core.rob", "top.nowhere"])


@pytest.mark.parametrize("text", [
    "DELETE FROM wave", "INSERT INTO wave VALUES (1)", "DROP TABLE wave", "UPDATE wave SET value = 0", "CREATE TABLE x (a int)",
    "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'exit', 1) FROM wave", "not a query",
    "WITH a AS (SELECT * FROM other) SELECT * FROM a", "SELECT (SELECT max(x) FROM other) FROM wave", "SELECT * FROM wave WHERE EXISTS (SELECT java_method('a', 'b') FROM wave)",
    "SHOW TABLES", "SET a = 1", "FROM wave INSERT INTO x SELECT *", "SELECT * FROM wave JOIN csv.`/etc/passwd`",
    "SELECT 1) UNION ALL SELECT x FROM other --", "SELECT * FROM IDENTIFIER('other')", "SELECT * FROM wave; DROP TABLE other; --'",
])
def test_guard_rejects(spark, frame, text):
    frame("x long", 1).createOrReplaceTempView("other")
    frame("x long", 1).write.mode("overwrite").saveAsTable("stored_other")
    try:
        for asked in (text, text.replace("other", "stored_other"), text.replace("other", "default.stored_other"), text.replace("other", "missing")):
            with pytest.raises(ValueError):
                results.read_only_sql(spark, {"wave": frame("x long", 2)}, asked)
        assert spark.table("other").count() == spark.table("stored_other").count() == 1
    finally:
        spark.catalog.dropTempView("other"), spark.sql("DROP TABLE stored_other")


@pytest.mark.parametrize("text", [
    "SELECT 'drop table x' AS insert FROM wave;", "-- comment\nWITH a AS (SELECT * FROM Wave) SELECT * FROM a WHERE x IN (SELECT x FROM a)",
    "(SELECT 1 FROM wave) UNION ALL VALUES (2)", "SELECT id FROM range(3)", "SELECT e FROM wave LATERAL VIEW explode(array(1, 2)) t AS e",
])
def test_guard_accepts(spark, frame, text):
    assert results.read_only_sql(spark, {"wave": frame("x long", 2)}, text).count() > 0


def test_question_with_limit(frame, spark):
    frame("a long", 7).createOrReplaceTempView("held")
    out = results.read_only_sql(spark, {"held": frame("b long", 3, 1, 2)}, "SELECT b FROM held", limit=2)
    assert [tuple(r) for r in out.collect()] == [(1, True), (2, True)]
    assert spark.table("held").first()["a"] == 7 and spark.catalog.dropTempView("held")
    assert results.read_only_sql(spark, {"held": frame("b long", 3)}, "SELECT b FROM held", limit=2).first()["truncated"] is False
    assert not spark.catalog.tableExists("held")


def test_guard_matches_whole_words(frame, spark):
    views = {"guarded": frame("updated_at long", 1)}
    assert results.read_only_sql(spark, views, "SELECT updated_at FROM guarded").count() == 1


def test_names_round_trip(frame):
    df = frame("n string", "rob.rob_state", "lsu.busy", "x")
    back = df.select("n", to_relative(to_absolute(F.col("n"), "top.t.core", "top.t", ["lsu"]), "top.t.core", "top.t").alias("b"))
    assert all(r.n == r.b for r in back.collect())


def test_unsigned_values(frame):
    df = frame("h string", "ffffffffffffffff", "0000000000000000000001", "1ffffffffffffffff", "", "zz")
    got = [int(r[0]) if r[0] is not None else None for r in df.select(hex_to_u64(F.col("h"))).collect()]
    assert got == [2**64 - 1, 1, None, None, None]


def test_dump_text(frame):
    text = ["#5", "1!", "b1010 s2", "#9", "bx1 s2", "0!"]
    df = frame("run_id string, line_no long, text string", *[("a", i, t) for i, t in enumerate(text)])
    got = bag(dump.parse_dump(df, 2), "seq", "symbol", "time", F.col("value").cast("int"), "value_str")
    assert got == [(1, "!", 5, 1, None), (2, "s2", 5, 10, None), (4, "s2", 9, None, "x1"), (5, "!", 9, 0, None)]


def test_change_store_round_trip(spark, store, tmp_path):
    wave, _ = store
    changes.write_changes(wave, str(tmp_path / "w"))
    again = changes.read_changes(spark, str(tmp_path / "w")).select(*wave.columns)
    assert bag(again) == bag(wave)


def test_store_reads_only_what_is_asked(spark, store, tmp_path):
    wave, signal = store
    changes.write_changes(wave, str(tmp_path / "p"))
    stored = changes.read_changes(spark, str(tmp_path / "p")).where("run_id = 'a'")
    plan = asof.last_change(stored, signal, 12)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line)
    assert "LessThanOrEqual(cycle,12)" in scan
    assert "time" not in scan.split("ReadSchema")[1] and "value" not in scan.split("ReadSchema")[1]
    assert "PartitionFilters: [isnotnull(run_id" in scan


def test_rank_filters_run_before_the_shuffle(store):
    from hindsight.operators.ordered import first_n

    plan = first_n(store[0], ["run_id"], [F.col("seq")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.line_no, r.text) for r in got) == [(i + 1, f"line {i}") for i in range(5000)]


def test_cycle_index_period(frame):
    ticks = [(t, v) for i in range(4) for t, v in ((i * 10, 0), (i * 10 + 5, 1))]
    wave = frame(WAVE, *[("a", 1, t, 0, v, n) for n, (t, v) in enumerate(ticks)])
    got = asof.cycle_index_edges(wave, 7)
    assert bag(got, "time", "cycle", "period") == [(5, 0, 10), (15, 1, 10), (25, 2, 10), (35, 3, 10)]


def test_stall_without_commits_is_reported(store, frame):
    none = frame("run_id string, cycle long", ("other", 1))
    assert bag(stall.stall_bounds(store[0], none), "run_id", "no_commits") == [("a", True)]


def test_blocked_and_starved(frame):
    state = frame(
        "run_id string, path string, scope string, name string, value long, moved boolean",
        *[("a", f"t.{n}", "t", n, v, m) for n, v, m in [
            ("x_valid", 1, False), ("x_ready", 0, False), ("y_valid", 0, False), ("y_ready", 1, False),
            ("z_valid", 1, False), ("z_ready", 0, True), ("lone_valid", 1, False),
        ]],
    )
    assert bag(stall.handshakes(state), "stem", "kind") == [("t.x", "blocked"), ("t.y", "starved")]


def test_hex_text_of_large_values(spark):
    got = spark.sql("SELECT cast('9223372036856090925' AS decimal(20,0)) a, cast('18446744073709551615' AS decimal(20,0)) b, 0L c, 4294967296L d, 255L e")
    row = got.select(*[hex_text(F.col(c)) for c in "abcde"]).first()
    assert list(row) == ["0x800000000014112d", "0xffffffffffffffff", "0x0", "0x100000000", "0xff"]


def test_ranges_are_numbered_through(frame):
    rows = [(f"b/{i % 7}/{i}", i) for i in range(500)]
    got = bag(ranked(frame("path string, i long", *rows), ["path"], "at"), "path", "at")
    assert got == [(p, k + 1) for k, (p, _) in enumerate(sorted(rows))]
    shards = sites.shard_of(frame("path string, i long", *rows), ["path"], 4)
    assert {r["shard"] for r in shards.collect()} == {0, 1, 2, 3}


def test_ranges_of_rows_split_a_dense_run(spark, frame):
    """All rows of one run at almost one time: the same running values, and no chunk holds them all."""
    rows = [("r", 5 + i // 4000, i, i % 7 if i % 3 else None) for i in range(8000)]
    df = frame("k string, t long, seq long, v long", *rows)
    ask = {"last": {"latest": F.col("v")}, "total": {"n": F.lit(1).cast("long")}}
    by_rows = running(df, ["k"], ["t", "seq"], None, **ask)
    assert bag(by_rows) == bag(running(df, ["k"], ["t", "seq"], 1 << 20, **ask))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # small tables may share a task
    spark.conf.set(setting, "false")
    try:
        assert bag(running(df, ["k"], ["t", "seq"], None, **ask)) == bag(by_rows)
        chunks = df.repartitionByRange("k", "t", "seq").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(setting)
    assert len(chunks) > 1 and max(r["count"] for r in chunks) < 6000


def plain_state(rows, cycle):
    newest = {}
    for run, sig, at, value, seq in rows:
        if at <= cycle and newest.get((run, sig), (0, 0, -1))[2] < seq:
            newest[run, sig] = at, value, seq
    return {k: v[:2] for k, v in newest.items()}


def test_keyframes_answer_like_the_log(spark, frame, tmp_path):
    import random

    from hindsight.sources.keyframes import KeyframeStore

    rng = random.Random(2)
    rows = sorted({(r, s, rng.randrange(200)) for r in (1, 2) for s in range(6) for _ in range(rng.choice([0, 1, 3, 30]))}, key=lambda x: x[2])
    rows += [(3, 9, 5)]
    rows = [(r, s, c, rng.randrange(9), i) for i, (r, s, c) in enumerate(rows)]
    schema = "run_id long, signal_id long, cycle long, value long, seq long"
    log = frame(schema, *rows)
    signal = frame("run_id long, signal_id long, path string, scope string, name string", *{(r, s, f"{r}.{s}", f"{r}", f"{s}") for r, s, *_ in rows})
    store = KeyframeStore(spark, str(tmp_path / "s"), 16)
    store.write(log.where("cycle < 48"))
    store.extend(log.where("cycle >= 48 and cycle < 64"))
    store.extend(log.where("cycle >= 64"))
    for cycle in (0, 15, 16, 47, 48, 63, 64, 130, 199, 5000):
        got = {tuple(map(int, r.path.split("."))): (r.last_change, r.value) for r in asof.state_at(store.upto(cycle), signal, cycle).collect()}
        assert got == plain_state(rows, cycle), cycle
    for lo, hi in ((10, 20), (40, 130), (300, 400)):
        assert bag(asof.trace(store.between(lo, hi).withColumn("time", F.col("cycle")), signal, lo, hi)) == bag(asof.trace(log.withColumn("time", F.col("cycle")), signal, lo, hi))
    with pytest.raises(ValueError):
        store.extend(log.where("cycle < 64"))
    store.extend(log.where("cycle > 1000"))


def test_late_questions_read_no_more(spark, frame, tmp_path, capsys):
    from hindsight.sources.keyframes import KeyframeStore

    log = spark.range(20_000).selectExpr("1L as run_id", "id % 5 as signal_id", "id as cycle", "id as value", "id as seq")
    store = KeyframeStore(spark, str(tmp_path / "s"), 1000)
    store.write(log)
    for cycle in (1999, 9999, 18_999):
        short = store.upto(cycle)
        assert short.count() <= 1000 + 5
        short.explain("formatted")
        assert capsys.readouterr().out.count("PartitionFilters: [isnotnull(epoch") == 2


def test_noted_copies_can_be_removed(spark, frame):
    import os

    from hindsight.session import cut_lineage, noted_copies, remove_copies

    with noted_copies() as outer:
        kept = cut_lineage(frame("a long", 1))
        with noted_copies() as inner:
            gone = cut_lineage(frame("a long", 2))
    later = cut_lineage(frame("a long", 3))
    assert len(outer) == 2 and len(inner) == 1 and gone.count() == 1
    remove_copies(spark, inner)
    assert not os.path.exists(inner[0].removeprefix("file:")) and kept.count() == later.count() == 1
