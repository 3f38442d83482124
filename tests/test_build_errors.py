"""Build errors: lines that no pattern can fit are left out before any is tried."""

from hindsight.sources import runlog
from tests.conftest import bag


def test_build_errors_of_odd_lines(frame):
    lines = frame(
        "run_id long, line_no long, text string",
        (1, 1, "\x1b[31m[er\x1b[0mror] /w/a.scala:1:2: no"), (1, 2, "\tat boom.v3.X(b.scala:9)"), (1, 3, "\tat boom.v3.Y(c.scala:9)"),
        (1, 4, "%Error: d.scala:4 bad"), (2, 1, "compiling"), (2, 2, None), (2, 3, "e.scala:1:2: error: at boom.x(f.scala:3)"),
        (3, 1, "\tat boo\x1b[1mm.v3.X\x1b[0m(g.scala\x1b[0m:9)"),
    )
    assert bag(runlog.build_errors(lines)) == [(1, "/w/a.scala"), (1, "b.scala"), (1, "d.scala"), (2, "e.scala"), (3, "g.scala")]


def test_lines_without_a_colon_meet_no_pattern(frame):
    plan = runlog.build_errors(frame("run_id long, line_no long, text string", (1, 1, "x")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(text") >= 2
