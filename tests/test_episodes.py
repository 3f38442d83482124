"""Episodes told apart by their identity: what is kept, and what is shuffled for it."""

from pyspark.sql import functions as F

from hindsight.operators import study

LEDGER = "task long, arm string, seed int, tokens long, queries long, seconds long, eid string, verdict string, stop string, draw int, file string, rescreen boolean"
ROWS = [
    (1, "O", None, 5, 1, 9, "b", "fixed", None, 1, "x-draw1", False),
    (1, "O", 0, 5, 1, 9, "a", "not-fixed", None, 2, "x-draw2", True),
    (1, "F", 0, 5, 1, 9, "c", "fixed", None, 3, "x-draw3", False),
    (1, "F", 0, 5, 1, 9, "d", "lost", None, 1, "x-draw1", True),
    (2, "O", 1, 5, 1, 9, "e", "fixed", "error", 1, "x-draw1", False),
    (2, "F", 1, 5, 1, 9, None, "fixed", None, 2, "x-draw2", False),
]


def plan(df) -> str:
    """The optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_columns_alone_are_grouped(spark):
    rows = spark.createDataFrame(ROWS, LEDGER)
    got = study.dedupe_episodes(study.scored(rows), ["verdict"])
    assert got.columns == [*study.EPISODE, "verdict", "copies"]
    assert sorted((r.task, r.arm, r.seed, r.verdict or "", r.copies) for r in got.collect()) == [
        (1, "F", 0, "fixed", 1), (1, "O", 0, "not-fixed", 2), (2, "F", 1, "", 1),
    ]
    whole = study.dedupe_episodes(study.scored(rows))
    assert set(whole.columns) == {*rows.columns, "copies"}
    assert {(r.task, r.arm, r.eid, r.file) for r in whole.collect()} == {(1, "O", "a", "x-draw2"), (1, "F", "c", "x-draw3"), (2, "F", None, None)}
    assert "file" not in plan(got).split("LogicalRDD")[0] and "file" in plan(whole).split("LogicalRDD")[0]


def test_stages_are_those_of_exploded_rows_from_one_shuffle(spark):
    rows = study.scored(spark.createDataFrame(ROWS, LEDGER))
    got = study.dedupe_stages(rows, 3, ["verdict"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = None
    for s in (1, 2, 3):
        one = study.dedupe_episodes(rows.where(F.col("draw") <= s), ["verdict"]).select(F.lit(s).alias("stage"), "*")
        want = one if want is None else want.unionByName(one)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert "Generate" not in plan(got).split("Aggregate")[1]  # rows are multiplied behind the shuffle


def test_superseded_rows_keep_their_columns(spark):
    rows = spark.createDataFrame(ROWS, LEDGER).where("eid IS NOT NULL")
    got = study.supersede(rows, ["task"])
    assert got.columns == rows.columns
    assert sorted((r.task, r.eid, r.rescreen) for r in got.collect()) == [(1, "d", True), (2, "e", False)]
    assert "max_by" not in plan(got)
