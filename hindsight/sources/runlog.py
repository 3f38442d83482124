"""Run logs: text lines to commits, findings, flags and source references.

``lines`` is (run_id, line_no, text) with dense line numbers per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.functions.values import hex_to_u64

SEP = "\u0001"

# The shapes of the log lines.
COMMIT = r"^(?:C\s*(\d+):\s*)?(\d)\s+0x([0-9a-f]+)\s+\(0x([0-9a-f]+)\)(.*)$"
#: The same with the first write-back behind it, if there is one: blanks are those that ``.`` takes too.
RETIRED = COMMIT.removesuffix("(.*)$") + r"(?:.*?[ \t\x0B\f]([xf])[ \t\x0B\f]*(\d+)[ \t\x0B\f]+0x([0-9a-f]+))?.*\R?$"
MISMATCH = r"\b(?:PC|wdata) mismatch"
PC_MISMATCH = r"Cosim: ([0-9a-fA-F]+) PC mismatch spike ([0-9a-fA-F]+) != DUT ([0-9a-fA-F]+)"
WDATA_MISMATCH = r"Cosim: ([0-9a-fA-F]+) wdata mismatch reg (\d+) ([0-9a-fA-F]+) != ([0-9a-fA-F]+)"
ASSERTION = r"^\[?\d*\]?\s*%Error:.*?Assertion failed(?: in [^:]*)?: (.*)$"
ASSERTION_AT = r"^\s*at (\S+) (.*)$"
BANNER = r"^Cosim: (?:Configuring spike cosim|isa string:)"
TIMEOUT = r"\(timeout\)"
COMPLETED = r"Completed after\s+(\d+)\s+simulation cycles"
LOCATOR = r"//\s*@\[([^\]]*)\]"
LOCATOR_ENTRY = r"(?:[A-Za-z0-9_./\-]+\.scala:)?\d+(?::(?:\{[\d,]+\}|\d+))?"
DECLARATION = r"^\s*(?:input|output|inout|wire|reg|logic)\b[^;,=]*?([A-Za-z_][\w$]*)\s*(?:\[[^\]]*\])?\s*[;,=]"


def groups(text: Column, pattern: str, n: int) -> Column:
    """All capture groups of a whole-line pattern from one regex pass."""
    return F.split(F.regexp_replace(text, pattern, SEP.join(f"${i}" for i in range(1, n + 1))), SEP)


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def parse_commits(lines: DataFrame) -> DataFrame:
    """One row per retired instruction; lines without a write-back keep NULL rd and wdata."""
    h = F.col("h")
    split = lines.where(F.col("text").rlike(COMMIT)).select("run_id", "line_no", groups(F.col("text"), RETIRED, 7).alias("h"))
    return split.select(
        "run_id", "line_no", _some(h[0]).cast("long").alias("cycle"), h[1].cast("int").alias("priv"),
        hex_to_u64(h[2], known=True).alias("pc"), hex_to_u64(h[3], known=True).alias("insn"),
        _some(h[4]).alias("regfile"), _some(h[5]).cast("int").alias("rd"), hex_to_u64(_some(h[6]), known=True).alias("wdata"),
    )


def parse_divergence(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first mismatch line of every run, with both readings of its cycle token."""
    text = F.trim(F.col("text"))
    first = (
        lines.where(F.col("text").rlike(MISMATCH))
        .groupBy(*keys).agg(F.min_by(text, "line_no").alias("line"), F.min("line_no").alias("line_no"))
    )
    line = F.col("line")
    kind = F.when(line.rlike(PC_MISMATCH), "pc").when(line.rlike(WDATA_MISMATCH), "wdata").otherwise("unknown")

    def part(pc: int, wdata: int) -> Column:
        return F.when(F.col("kind") == "pc", F.regexp_extract(line, PC_MISMATCH, pc)).when(
            F.col("kind") == "wdata", F.regexp_extract(line, WDATA_MISMATCH, wdata)
        )

    token = F.col("cycle_token")
    return (
        first.withColumn("kind", kind)
        .select(
            *keys, "line_no", "line", "kind", F.concat(F.lit("0x"), part(2, 3)).alias("spike"),
            F.concat(F.lit("0x"), part(3, 4)).alias("dut"),
            F.when(F.col("kind") == "wdata", F.regexp_extract(line, WDATA_MISMATCH, 2)).cast("int").alias("reg"),
            part(1, 1).alias("cycle_token"),
        )
        .withColumn("cycle_hex", hex_to_u64(token).cast("long"))
        .withColumn("cycle_dec", F.when(token.rlike("^[0-9]+$"), F.expr("try_cast(cycle_token AS bigint)")))
    )


def parse_assertions(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Every fired assertion: message, and source and expression when the next line has them.

    Only lines of either shape take part. A first line stands for its own number, a
    second one for the number before it, so the two meet without a window.
    """
    text = F.col("text")
    fired = lines.where(text.rlike(ASSERTION)).select(
        *keys, "line_no", F.trim(F.regexp_extract(text, ASSERTION, 1)).alias("message")
    )
    where = lines.where(text.rlike(ASSERTION_AT)).select(
        *keys, (F.col("line_no") - 1).alias("line_no"), F.regexp_extract(text, ASSERTION_AT, 1).alias("src"),
        F.regexp_extract(text, ASSERTION_AT, 2).alias("expr"),
    )
    both = fired.unionByName(where, allowMissingColumns=True)
    return both.groupBy(*keys, "line_no").agg(
        F.max("message").alias("message"), F.max("src").alias("src"), F.max("expr").alias("expr")
    ).where("message IS NOT NULL")


def first_assertion(assertions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """What a run reports: its first assertion."""
    return assertions.groupBy(*keys).agg(F.min_by(F.struct("line_no", "message", "src", "expr"), "line_no").alias("a")).select(
        *keys, "a.*"
    )


def run_flags(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """What the text of every run says, from one map-side aggregate."""
    text = F.col("text")

    def seen(pattern: str) -> Column:
        return F.max(text.rlike(pattern))

    done = F.min_by(F.when(text.rlike(COMPLETED), F.regexp_extract(text, COMPLETED, 1)), F.when(text.rlike(COMPLETED), F.col("line_no")))
    return lines.groupBy(*keys).agg(
        seen(BANNER).alias("oracle_active"), seen(MISMATCH).alias("diverged"), seen(ASSERTION).alias("asserted"),
        seen(TIMEOUT).alias("timed_out"), done.cast("long").alias("sim_cycles"), F.count_if(text.rlike(COMMIT)).alias("commits"),
    )


def passed(returncode: Column, oracle_wanted: Column) -> Column:
    """Over the columns of :func:`run_flags`."""
    return (
        (returncode == 0) & ~F.col("diverged") & ~F.col("asserted") & ~F.col("timed_out")
        & (F.col("oracle_active") | ~oracle_wanted)
    )


def outcome_of(found: Column) -> Column:
    """Ordered verdict over the columns of :func:`run_flags`; ``found`` is false without a log."""
    return (
        F.when(~found, "missing").when(~F.col("oracle_active"), "no-cosim").when(F.col("diverged"), "diverged")
        .when(F.col("asserted"), "assertion").when(F.col("timed_out"), "timeout").otherwise("passed")
    )


def locators(text: Column) -> Column:
    """Array of (file, line, col); an entry without a file belongs to the one named last."""
    entries = F.regexp_extract_all(F.regexp_extract(text, LOCATOR, 1), F.lit(LOCATOR_ENTRY), 0)
    file = lambda e: F.regexp_extract(e, r"^([A-Za-z0-9_./\-]+\.scala):", 1)
    bare = lambda e: F.regexp_replace(e, r"^[A-Za-z0-9_./\-]+\.scala:", "")

    def refs(e: Column, i: Column) -> Column:
        named = F.filter(F.transform(F.slice(entries, 1, i + 1), file), lambda f: f != "")
        cols = F.split(F.regexp_extract(bare(e), r":\{?([\d,]+)", 1), ",")
        return F.transform(cols, lambda c: F.struct(
            F.try_element_at(named, F.lit(-1)).alias("file"),
            F.regexp_extract(bare(e), r"^(\d+)", 1).cast("int").alias("line"), _some(c).cast("int").alias("col"),
        ))

    return F.filter(F.flatten(F.transform(entries, refs)), lambda r: r["file"].isNotNull())


def parse_locators(lines: DataFrame) -> DataFrame:
    """One row per reference of every line, numbered in order."""
    found = lines.where(F.col("text").contains("@["))
    cols = [c for c in lines.columns if c != "text"]
    return found.select(*cols, F.posexplode(locators(F.col("text"))).alias("ref_no", "r")).select(*cols, "ref_no", "r.*")


def declarations(lines: DataFrame) -> DataFrame:
    """(module, signal, file, line, col): references of a signal's first declaration."""
    text = F.col("text")
    declared = lines.where(text.contains("@[") & text.rlike(DECLARATION)).select(
        "module", "line_no", F.regexp_extract(text, DECLARATION, 1).alias("signal"), locators(text).alias("refs")
    )
    first = declared.where(F.size("refs") > 0).groupBy("module", "signal").agg(F.min_by("refs", "line_no").alias("refs"))
    return first.select("module", "signal", F.inline("refs"))


def findings(divergence: DataFrame, assertions: DataFrame) -> DataFrame:
    """Both oracles in one table, not yet tolerated."""
    d = divergence.select("run_id", "line_no", "kind", F.col("cycle_dec").alias("cycle"), "spike", "dut", "reg", F.col("line").alias("raw"))
    a = assertions.select("run_id", "line_no", F.lit("assertion").alias("kind"), F.col("src").alias("spike"), F.col("message").alias("raw"))
    return d.unionByName(a, allowMissingColumns=True).withColumn("tolerated", F.lit(False))


# How build tools report an error.
ANSI = r"\x1b\[[0-9;]*m"
BUILD_ERRORS = (r"\[error\]\s+(/\S+?\.scala):\d+:\d+:", r"%Error[^:]*:\s*(\S+?):\d+", r"^(\S+?\.scala):\d+:\d+: error:")
STACK_FRAME = r"^\s+at boom\.\S+\((\S+?\.scala):\d+\)"


def build_errors(lines: DataFrame) -> DataFrame:
    """(run_id, file): files a build log blames; of its stack frames only the first counts.

    Every shape has a colon and a frame a parenthesis, which is seen faster than that no pattern fits.
    """
    clean = F.regexp_replace("text", ANSI, "")
    error = F.coalesce(*[_some(F.regexp_extract("clean", p, 1)) for p in BUILD_ERRORS])
    some = lines.where(F.col("text").contains(":")).withColumn("clean", clean)
    direct = some.select("run_id", error.alias("file")).where("file IS NOT NULL")
    framed = some.where(F.col("text").contains("(")).select(
        "run_id", "line_no", _some(F.regexp_extract("clean", STACK_FRAME, 1)).alias("frame"), error.alias("error")
    ).where("frame IS NOT NULL AND error IS NULL").groupBy("run_id").agg(F.min_by("frame", "line_no").alias("file"))
    return direct.unionByName(framed).distinct()
