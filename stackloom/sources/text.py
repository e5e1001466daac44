"""Text profiles as DataFrames of lines or documents.

Line formats take a DataFrame with a `line` column (any others, such as a file
name and a line number, pass through); formats that span lines take whole
documents, one a row, in `doc` and `text`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions.addresses import hex_to_long
from stackloom.functions.names import render_stack

#: An unsigned number as the format's parser takes it: digits, a plus sign at most.
_COUNT = r"[+]?[0-9]+"
_FLOAT = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def folded(lines: DataFrame) -> DataFrame:
    """stack and count; count is null for a line that is none."""
    ok = F.col("line").rlike(rf"(?s)^.* {_COUNT}$")
    count = F.expr("try_cast(regexp_extract(line, '(?s)^.* [+]?([0-9]+)$', 1) as bigint)")
    return lines.withColumn("stack", F.when(ok, F.regexp_extract("line", rf"(?s)^(.*) {_COUNT}$", 1))).withColumn("count", F.when(ok, count))


def strict_folded(lines: DataFrame) -> DataFrame:
    """Stacks with summed counts; blank lines are skipped, any other line that is not folded is an error."""
    rows = folded(lines.filter(F.trim("line") != ""))
    bad = F.raise_error(F.concat(F.lit("malformed folded line: "), F.col("line")))
    return rows.select("stack", F.when(F.col("count").isNull(), bad.cast("bigint")).otherwise(F.col("count")).alias("count")).groupBy("stack").agg(F.sum("count").alias("count"))


def flamegraph(docs: DataFrame) -> DataFrame:
    """doc, pos, name, samples, percent of the titles of flamegraph documents, in the order of percent, name and place that lists use."""
    title = docs.select("doc", F.posexplode(F.split("text", "<title>")).alias("pos", "part")).filter("pos > 0")
    title = title.filter(F.instr("part", "</title>") > 0).withColumn("title", F.substring_index("part", "</title>", 1))
    r = lambda p: F.regexp_extract("title", p, 1)
    meta = title.select("doc", "pos", F.trim(r(r"(?s)^(.*)\([^(]*$")).alias("name"), r(r"(?s)\(([^(]*)$").alias("meta"), (F.instr("title", "(") > 0).alias("ok"))
    samples = F.when(F.instr("meta", " samples") > 0, F.expr("try_cast(regexp_extract(replace(substring_index(meta, ' samples', 1), ',', ''), '^[+]?([0-9]+)$', 1) as bigint)"))
    # between the last ', ' and the last '%'
    percent = F.expr(rf"try_cast(regexp_extract(meta, '(?is), ({_FLOAT})%[^%]*$', 1) as double)".replace("\\", "\\\\"))
    out = meta.filter("ok").select("doc", "pos", "name", samples.alias("samples"), percent.alias("percent"))
    return out.filter("name not in ('', 'all') and samples is not null and percent is not null")


def strace(lines: DataFrame) -> DataFrame:
    """syscall and seconds of the lines with a duration; syscall is null where a line has no call."""
    seconds = F.expr(rf"try_cast(regexp_extract(line, '(?is)<({_FLOAT})>[^<]*$', 1) as double)".replace("\\", "\\\\"))
    before = F.rtrim(F.substring_index("line", "(", 1))
    name = F.when((F.instr("line", "(") > 0) & (before != ""), F.element_at(F.split(before, r"\s+"), -1))
    return lines.withColumn("seconds", seconds).filter("seconds is not null").withColumn("syscall", F.nullif(name, F.lit("")))


def heaptrack(docs: DataFrame) -> DataFrame:
    """doc, total_allocations, peak_heap_bytes: the last value of each."""
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    value = lambda prefix: F.expr(f"try_cast(regexp_extract(trim(line), '^{prefix}\\\\s*[+]?([0-9]+)(\\\\s|$)', 1) as bigint)")
    lines = lines.withColumn("a", value("total allocations:")).withColumn("b", value("peak heap memory consumption:"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    return lines.groupBy("doc").agg(last("a").alias("total_allocations"), last("b").alias("peak_heap_bytes"))


def xctrace(docs: DataFrame) -> DataFrame:
    """doc, pos, symbol, weight of the rows of an exported table."""
    rows = docs.select("doc", F.posexplode(F.split("text", "<row>")).alias("pos", "row")).filter("pos > 0").withColumn("row", F.substring_index("row", "</row>", 1))
    tag = lambda t: F.regexp_extract("row", f"(?s)<{t}>(.*?)</{t}>", 1)
    has = F.col("row").rlike("(?s)<symbol>.*?</symbol>")
    weight = F.expr(f"try_cast(nullif(trim(regexp_extract(row, '(?s)<weight>(.*?)</weight>', 1)), '') as double)")  # noqa: F541
    return rows.filter(has).select("doc", "pos", F.trim(tag("symbol")).alias("symbol"), weight.alias("weight")).filter("weight is not null")


def bpftrace_frame(line):
    """A stack line without address, module and offset; null if it holds no frame."""
    body = F.trim(F.regexp_extract(F.trim(line), r"(?s)^[^ ]* (.*)$", 1))
    body = F.regexp_replace(body, r"(?s)^(.*) \(.*\)$", "$1")
    body = F.regexp_replace(body, r"(?s)^(.*)\+[0-9]*$", "$1")
    return F.when((body != "") & ~body.endswith("([unknown])"), body)


def bpftrace(docs: DataFrame) -> DataFrame:
    """doc, block, stack, count: a folded stack for each closed block with frames.

    The running number of blocks is per document, so documents spread over tasks.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    order = Window.partitionBy("doc").orderBy("pos")
    lines = lines.withColumn("block", F.sum(F.col("line").startswith("@offcpu[").cast("int")).over(order)).filter("block > 0 and not startswith(line, '@offcpu[')")
    count = F.expr("try_cast(regexp_extract(trim(line), '^\\\\]:\\\\s*[+]?([0-9]+)$', 1) as bigint)")
    lines = lines.withColumn("count", count).withColumn("closed", F.min(F.when(F.col("count").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc", "block")))
    frame = F.when(F.col("line").rlike(r"^\s") & (F.col("pos") < F.col("closed")), bpftrace_frame(F.col("line")))
    blocks = lines.filter("pos <= closed").groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.when(frame.isNotNull(), F.struct("pos", frame.alias("f")))), asc=False).alias("frames"), F.max(F.when(F.col("pos") == F.col("closed"), F.col("count"))).alias("count"))
    return blocks.filter(F.size("frames") > 0).select("doc", "block", render_stack(F.transform("frames", lambda x: x["f"])).alias("stack"), "count")


def kallsyms(lines: DataFrame) -> DataFrame:
    """addr, name of symbol lines; address 0 and malformed lines are skipped."""
    parts = F.split(F.trim("line"), r"\s+")
    ok = F.size(parts) >= 3
    addr = F.when(parts[0].rlike("^[+]?[0-9a-fA-F]{1,16}$"), hex_to_long(F.regexp_replace(parts[0], "^[+]", "")))
    return lines.filter(ok).select(addr.alias("addr"), parts[2].alias("name"), *[c for c in lines.columns if c != "line"]).filter("addr is not null and addr <> 0")
