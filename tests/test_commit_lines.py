"""Lines of retired instructions, odd ones too, against the patterns one after the other."""

import re

from pyspark.sql import functions as F

from hindsight.functions.values import hex_to_u64
from hindsight.sources import runlog

HEAD = re.compile(runlog.COMMIT)
BACK = re.compile(r"\s([xf])\s*(\d+)\s+0x([0-9a-f]+)")
LINES = [
    "C    12: 3 0x0000000080000004 (0x00000013) auipc   a0, 0x0 x 5 0x000000000000ffff",
    "3 0x80000004 (0x13) sd      t3, -64(t5)", "C7: 0 0x1 (0x2) f12 0xa x 3 0xb", "C7: 0 0x1 (0x2) x1 x 2\t0x00",
    "0 0x0 (0x00000000000000000000ff)", "0 0x1ffffffffffffffff (0x2) x 1 0x10000000000000000", "0 0xffffffffffffffff (0x2) x  1 0xg f 9  0xfe,",
    "0 0x1 (0x2) x1 0x3\n", "0 0x1 (0x2)\n", "0 0x1 (0x2) \rx 1 0x3", "0 0x1 (0x2)x 1 0x3", "0 0x1 (0x2) y x99999999 0x3 tail", "C: 0 0x1 (0x2)", "no commit", "",
]


def u64(digits):
    value = int(digits, 16)
    return value if value < 1 << 64 else None


def plain(text):
    found = HEAD.match(text)
    if not found or re.search(r"[\r\n].", text):
        return None
    cycle, priv, pc, insn, tail = found.groups()
    back = BACK.search(tail)
    written = (back[1], int(back[2]), u64(back[3])) if back else (None, None, None)
    return (int(cycle) if cycle else None, int(priv), u64(pc), u64(insn), *written)


def test_commits_as_by_two_patterns(spark, frame):
    lines = frame("run_id long, line_no long, text string", *[(1, i, t) for i, t in enumerate(LINES)])
    got = runlog.parse_commits(lines)
    said = {r.line_no: (r.cycle, r.priv, r.pc, r.insn, r.regfile, r.rd, r.wdata) for r in got.collect()}
    said = {k: tuple(int(x) if x is not None and not isinstance(x, str) else x for x in v) for k, v in said.items()}
    assert said == {i: plain(t) for i, t in enumerate(LINES) if plain(t)}


def test_a_line_is_matched_twice_at_most(frame):
    got = runlog.parse_commits(frame("run_id long, line_no long, text string", (1, 1, LINES[0])))
    text = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert text.count("regexp_") == 1 and text.count("rlike") + text.count(" like ") <= 1


def test_hex_of_any_text(frame):
    digits = ["", "0", "000", "00000000000000000000ff", "ffffffffffffffff", "10000000000000000", "xyz", "0x1", "A0", " 1", None]
    rows = frame("d string", *[(d,) for d in digits]).select("d", hex_to_u64(F.col("d")).alias("v"))
    want = {"0": 0, "000": 0, "00000000000000000000ff": 255, "ffffffffffffffff": (1 << 64) - 1, "A0": 160}
    assert {r.d: int(r.v) for r in rows.collect() if r.v is not None} == want
