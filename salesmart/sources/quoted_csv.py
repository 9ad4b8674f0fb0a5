"""Reading large CSV files with quoted line breaks in parallel.

A line break ends a record only outside quotes, and whether a line starts inside quotes depends on
all lines before it. Every line is a function on these two states: what it ends in when started
outside, and when started inside. Functions compose, so each byte range of a file is reduced on its
own; the ranges' functions in file order, one row each, give every range's start state. Then all
lines know theirs, and consecutive lines of one record are put together. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from salesmart.sources.staging import stage

# Fields, quoted or not, up to one that is open at the end of the line. Possessive, so that no
# text makes the match go back; a quote inside a field that does not start with one means nothing.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
OPEN_AFTER_OUTSIDE = rf'(?s)^{_FIELDS}"{_QUOTED}$'
OPEN_AFTER_INSIDE = rf'(?s)^{_QUOTED}(?:$|"[^,]*+,{_FIELDS}"{_QUOTED}$)'

RANGE = ["file", "start"]


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, byte range, order, and the end state from either start state.

    Line breaks are ``\\n``; a ``\\r`` before one stays on its line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    bare = F.regexp_replace("text", r"\r$", "")
    quoted = F.instr("text", '"') > 0
    return lines.select(
        "*", F.when(quoted, bare.rlike(OPEN_AFTER_OUTSIDE)).otherwise(False).alias("from_outside"),
        F.when(quoted, bare.rlike(OPEN_AFTER_INSIDE)).otherwise(True).alias("from_inside"))


def with_states(lines: DataFrame) -> DataFrame:
    """Add ``inside``: whether a line starts inside quotes.

    In a range, the last line before whose end is the same from either state settles the state,
    and every line that swaps both states since then turns it. Before the first such line, the
    range's start state does.
    """
    earlier = Window.partitionBy(*RANGE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    up_to = Window.partitionBy(*RANGE).orderBy("line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumn("swaps", F.sum(swaps).over(up_to))
    here = F.when(settles, F.struct(F.col("from_outside").alias("state"), "swaps"))
    known = counted.withColumn("settled", F.last(here, ignorenulls=True).over(earlier)).withColumn(
        "swapped", F.coalesce(F.lag("swaps").over(Window.partitionBy(*RANGE).orderBy("line")), F.lit(0)))
    odd = (F.col("swapped") - F.coalesce("settled.swaps", F.lit(0))) % 2 == 1
    return known.select(
        *RANGE, "line", "text", "from_outside", "from_inside",
        F.col("settled.state").alias("settled"), odd.alias("odd"))


def _state(start: Column) -> Column:
    return F.coalesce("settled", start) != F.col("odd")


def range_starts(lines: DataFrame) -> DataFrame:
    """The start state of every byte range, from the composed functions of those before it.

    The windows see one row per range.
    """
    last = lines.groupBy(*RANGE).agg(F.max_by(F.struct(
        "settled", "odd", "from_outside", "from_inside"), "line").alias("last")).select(*RANGE, "last.*")

    def ends(start: bool) -> Column:
        return F.when(_state(F.lit(start)), F.col("from_inside")).otherwise(F.col("from_outside"))

    whole = last.select(*RANGE, ends(False).alias("from_outside"), ends(True).alias("from_inside"))
    order = Window.partitionBy("file").orderBy("start")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    counted = whole.withColumn("swaps", F.sum(
        (F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(up_to))
    here = F.when(settles, F.struct(F.col("from_outside").alias("state"), "swaps"))
    known = counted.withColumn("settled", F.last(here, ignorenulls=True).over(earlier)).withColumn(
        "swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    odd = (F.col("swapped") - F.coalesce("settled.swaps", F.lit(0))) % 2 == 1
    return known.select(*RANGE, (F.coalesce("settled.state", F.lit(False)) != odd).alias("range_inside"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, record): the records of files with quoted line breaks, without empty ones.

    ``start`` and ``line`` are those of the record's first line. Only records of several lines
    are grouped.
    """
    lines = stage(with_states(line_table(spark, path)), "csv-lines")
    starts = stage(range_starts(lines), "csv-ranges")
    states = lines.join(starts, RANGE).withColumn("inside", _state(F.col("range_inside")))
    first = F.when(~F.col("inside"), F.struct("start", "line"))
    in_range = Window.partitionBy(*RANGE).orderBy("line")
    placed = stage(states.select(
        *RANGE, "line", "text", "inside",
        F.last(first, ignorenulls=True).over(in_range).alias("head"),
        F.lead("inside", default=False).over(in_range).alias("goes_on")), "csv-records")
    # What a range begins with may belong to a record of any earlier range: one row per range.
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(*RANGE).agg(
        F.max("head").alias("head"), F.min_by("inside", "line").alias("continues"))
    after = Window.partitionBy("file").orderBy("start")
    carried = stage(heads.select(
        *RANGE, F.last("head", ignorenulls=True).over(order).alias("carried"),
        F.lead("continues", default=False).over(after).alias("next_continues"),
        F.col("head").alias("last_head")), "csv-heads")
    owned = placed.join(carried, RANGE).withColumn("owner", F.coalesce("head", "carried"))
    # A record is whole on its first line unless the next line, here or in the next range, goes on.
    alone = ~F.col("inside") & ~F.col("goes_on") & ~(
        F.col("next_continues") & (F.col("last_head.line") == F.col("line")))
    single = owned.where(alone).select(*RANGE, "line", F.col("text").alias("record"))
    several = owned.where(~alone).groupBy("file", "owner").agg(F.array_sort(F.collect_list(
        F.struct("start", "line", "text"))).alias("lines")).select(
        "file", "owner.start", "owner.line", F.array_join("lines.text", "\n").alias("record"))
    return single.unionByName(several).withColumn(
        "record", F.regexp_replace("record", r"\r$", "")).where("record != ''")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as text, named by the header; files of one folder share the first one's header."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    fields = T.StructType([T.StructField(name, T.StringType()) for name in names])
    found = stage(records(spark, path), "csv-parsed")
    # The first record of each file is its header.
    header = found.groupBy("file").agg(F.min(F.struct("start", "line")).alias("header"))
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in fields.names)
    parsed = F.from_csv("record", F.lit(ddl), {"escape": '"', "multiLine": "true"})
    return found.join(header, "file").where(
        F.struct("start", "line") != F.col("header")).select(parsed.alias("row")).select("row.*")
