"""CSV sources: header-routed loading, labelled URLs, numeric baselines."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, NumericType, StringType, StructType

from netsight.session import cut_lineage, scratch_path
from netsight.sources import tables
from netsight.sources.schemas import CSV_LAYOUTS, LABELLED_URLS

NULL_TEXT = "NaN"
#: Texts that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "NaT", "None", "n/a", "nan", "null",
)
_BAD = "_bad_record"

LOADED, SKIPPED, REJECTED, UNREADABLE, REPEATED = "loaded", "skipped", "rejected", "unreadable", "repeated"

#: A whole field; one whose quote stays open to the end of the line; what closes a quote opened on an earlier line.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+\z'
_OPENS = rf"\A(?:{_FIELD},)*+{_OPEN}"
_STAYS = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,(?:{_FIELD},)*+{_OPEN})'


def _files(spark: SparkSession, folder: str, kind: str, **options: str):
    return spark.read.format(kind).options(pathGlobFilter="*.csv", **options).load(folder)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line: path, start (where its split of the file starts), line (grows inside a split, by one from
    line to line), value, end (how the line ends), and whether it leaves a quote open behind it: `opens` if
    none was open before it, `stays` if one was.
    """
    text = _files(spark, folder, "text", lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.is_valid_utf8("value").alias("sound"), F.col("value").endswith("\r").alias("pair"), "value",
    )
    # Carriage returns alone end lines too.
    body = F.split(F.when(F.col("pair"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")), "\r")
    parts = text.select("path", "start", "sound", "pair", F.size(body).alias("n"), F.posexplode(body).alias("at", "value"))
    end = F.when(F.col("at") < F.col("n") - 1, "\r").when(F.col("pair"), "\r\n").otherwise("\n")
    quoted = F.contains("value", F.lit('"'))
    return parts.select(
        "path", "start", F.monotonically_increasing_id().alias("line"), "value", end.alias("end"), "sound",
        (quoted & F.col("value").rlike(_OPENS)).alias("opens"), (~quoted | F.col("value").rlike(_STAYS)).alias("stays"),
    )


def _entered(rows: DataFrame, over: WindowSpec) -> DataFrame:
    """`clear`, `within`: whether a quote is open before a row if none, or one, was before the window's first.

    Each row maps the one state to the other. A row that gives the same for both settles it; from there on
    only the number of rows that turn it around counts.
    """
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((F.col("opens") & ~F.col("stays")).cast("bigint"))
    settles = F.col("opens") == F.col("stays")
    rows = rows.withColumns({"_turns": F.coalesce(turns.over(before), F.lit(0)), "_upto": turns.over(upto)})
    last = F.last(F.when(settles, F.struct("opens", "_upto")), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last)
    since = F.col("_turns") - F.coalesce(F.col("_last._upto"), F.lit(0))
    turned = since % 2 == 1
    state = lambda unsettled: F.coalesce(F.col("_last.opens"), F.lit(unsettled)) != turned
    return rows.withColumns({"clear": state(False), "within": state(True)}).drop("_turns", "_upto", "_last")


def _joined(lines: DataFrame) -> DataFrame:
    """Records of files in which values go over line ends: path, layout, number (of the first line), value, unclosed.

    A split of a file is worked through line by line; between splits go the state of the quote and the
    number of the record, a row per split. Of a quote that never closes only the first line is kept.
    """
    split = Window.partitionBy("path", "start").orderBy("line")
    rows = _entered(lines, split)
    leaves = lambda state: F.when(F.col(state), F.col("stays")).otherwise(F.col("opens"))
    rows = cut_lineage(rows.withColumns({"left_clear": leaves("clear"), "left_within": leaves("within")}))
    ends = rows.groupBy("path", "start").agg(
        F.max_by("left_clear", "line").alias("opens"), F.max_by("left_within", "line").alias("stays"),
        F.max(F.when(~F.col("clear"), F.col("number"))).alias("new_clear"), F.max(F.when(~F.col("within"), F.col("number"))).alias("new_within"),
    )
    file = Window.partitionBy("path").orderBy("start")
    ends = _entered(ends, file).withColumn("record", F.when(F.col("clear"), F.col("new_within")).otherwise(F.col("new_clear")))
    everything = Window.partitionBy("path")
    ends = cut_lineage(ends.select(
        "path", "start", F.col("clear").alias("entered"),
        F.max("record").over(file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.max("record").over(everything).alias("final"),
        F.max_by(F.when(F.col("clear"), F.col("stays")).otherwise(F.col("opens")), "start").over(everything).alias("never_closed"),
    ))
    rows = rows.join(ends, ["path", "start"])
    inside = F.when(F.col("entered"), F.col("within")).otherwise(F.col("clear"))
    left = F.when(F.col("entered"), F.col("left_within")).otherwise(F.col("left_clear"))
    rows = rows.withColumns({"inside": inside, "left": left})
    own = F.last(F.when(~F.col("inside"), F.col("number")), ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("record", F.coalesce(own, "carried"))
    rows = rows.withColumn("unclosed", F.col("never_closed") & (F.col("record") == F.col("final")))
    alone = rows.where((~F.col("inside") & ~F.col("left")) | (F.col("unclosed") & ~F.col("inside")))
    parts = rows.where((F.col("inside") | F.col("left")) & ~F.col("unclosed")).groupBy("path", "layout", F.col("record").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("number").alias("n"), "value", "end"))).alias("parts")
    )
    whole = F.aggregate("parts", F.lit(""), lambda text, p: F.concat(text, p["value"], p["end"]))
    last = F.length(F.element_at("parts", -1)["end"])
    text = F.expr("substr(whole, 1, length(whole) - cut)")
    parts = parts.select("path", "layout", "number", whole.alias("whole"), last.alias("cut")).select("path", "layout", "number", text.alias("value"))
    alone = alone.where(F.btrim("value") != "")
    return alone.select("path", "layout", "number", "value", "unclosed").unionByName(parts.withColumn("unclosed", F.lit(False)))


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split of a file: its first line's id, the number of lines before it, the first line of the
    file, the layout that this header belongs to, and whether any line leaves a quote open."""
    rows = lines.groupBy("path", "start").agg(
        F.min("line").alias("first"), F.count("*").alias("n"), F.max("opens").alias("opens"),
        F.min_by(F.when(F.col("sound"), F.col("value")), "line").alias("value"),
    )
    file = Window.partitionBy("path")
    rows = rows.select(
        "path", "start", "first",
        F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.max("opens").over(file).alias("broken"), F.min_by("value", "start").over(file).alias("header"),
    )
    layout = F.lit(None).cast("int")
    header = F.btrim(F.translate("header", '"﻿', ""))
    for number, (_, schema) in reversed(list(enumerate(CSV_LAYOUTS))):
        layout = F.when(header == ",".join(schema.names), F.lit(number)).otherwise(layout)
    table = F.element_at(F.array(*[F.lit(t) for t, _ in CSV_LAYOUTS]), F.col("layout") + 1)
    return rows.withColumn("layout", layout).withColumn("table", table)


def read_layout(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """CSV files of one layout; a malformed row or a wrong header fails the job."""
    return clean_nulls(
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", NULL_TEXT)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(paths)
    )


def clean_nulls(df: DataFrame) -> DataFrame:
    """NaN numbers and the text forms of a missing value become NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, DoubleType | FloatType):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, StringType):
            c = F.when(~c.isin(*MISSING), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _typed(text: Column, kind: DataType) -> Column:
    """The value of a text, NULL if it is none of that type; a whole number may be written 443.0."""
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, IntegralType):
        number = text.try_cast("decimal(38,9)")
        return F.when(number == F.floor(number), number.try_cast(kind))
    return text.try_cast(kind)


def _parsed(records: DataFrame, layouts: Collection[int]) -> DataFrame:
    """Records -> path, layout, number, reason (NULL for a good one), record (of a bad one) and, per layout,
    the typed columns as `t<layout>`. Every value of a record is looked at."""
    # In steps, so that no text is looked at twice: records, texts, values, reasons.
    raw, texts, values, typed = {}, {}, {}, {}
    reason = F.when(F.col("unclosed"), "unclosed quote")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "escape": '"', "multiLine": "true"}
    for k in layouts:
        schema, mine = CSV_LAYOUTS[k][1], F.col("layout") == k
        names = ", ".join(f"`{n}` string" for n in schema.names)
        raw[f"r{k}"] = F.when(mine, F.from_csv("value", f"{names}, `{_BAD}` string", options))
        reason = reason.when(F.col(f"r{k}")[_BAD].isNotNull(), "wrong number of values")
        for f in schema.fields:
            given, text, value = F.col(f"r{k}")[f.name], f"x{k}_{f.name}", f"v{k}_{f.name}"
            texts[text] = F.when(~F.btrim(given).isin(*MISSING), given)
            values[value] = _typed(F.col(text), f.dataType)
            if not isinstance(f.dataType, StringType):
                wrong = F.col(text).isNotNull() & F.col(value).isNull()
                reason = reason.when(wrong, f"{f.name}: not a {f.dataType.simpleString()}")
        typed[f"t{k}"] = F.when(mine, F.struct(*[F.col(f"v{k}_{n}").alias(n) for n in schema.names]))
    rows = records.withColumns(raw).withColumns(texts).withColumns(values).withColumns({"reason": reason} | typed)
    return rows.select("path", "layout", "number", "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("record"), *typed)


def load_folder(spark: SparkSession, folder: str, root: str, *, only: Collection[str] | None = None) -> DataFrame:
    """Load every CSV file of a folder into the table its header names (`only`: of these tables).

    A value in quotes may hold line ends. A file goes in whole or not at all: its records are parsed once
    into the shared folder, and only files without a malformed record are taken; the malformed records of
    the others go to the quarantine with their line and the reason. All that a load writes shows at
    once when it has finished. A file of the same path, length and time that an earlier load has taken or rejected
    is not looked at again, so that loading a folder twice adds nothing; one that has changed since is
    loaded like a new one.

    Returns file, table, status, n_rows; files of no length hold nothing and are not listed.
    """
    load = tables.new_load()
    files = _files(spark, folder, "binaryFile").where("length > 0").select(
        F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified")
    )
    seen = tables.loaded_files(spark, root).where(F.col("status").isin(LOADED, REJECTED)).select("path", "length", "modified").distinct()
    files = cut_lineage(files.join(seen.withColumn("seen", F.lit(True)), ["path", "length", "modified"], "left"))
    report = files.withColumns({"table": F.lit(None).cast("string"), "status": F.lit(REPEATED), "n_rows": F.lit(0).cast("bigint")})
    if files.where("seen is null").isEmpty():
        return _report(report)
    lines = _lines(spark, folder)
    splits = cut_lineage(_splits(lines.join(files.where("seen is null").select("path"), "path", "left_semi")))
    wanted = F.col("layout").isNotNull()
    if only is not None:
        wanted = wanted & F.col("table").isin(*only)
    known = splits.where(wanted).select("path", "start", "first", "before", "layout", "broken")
    layouts = {r[0]: r[1] for r in known.groupBy("layout").agg(F.max("broken")).collect()}
    counts = spark.createDataFrame([], "path string, n bigint, bad bigint")
    if layouts:
        # Ids of lines are the same each time: the same list of files, cut in the same way.
        lines = lines.join(known, ["path", "start"]).withColumn("number", F.col("before") + F.col("line") - F.col("first") + 1)
        lines = lines.where("number > 1")
        records = lines.where(~F.col("broken") & (F.btrim("value") != "")).select("path", "layout", "number", "value", F.lit(False).alias("unclosed"))
        if any(layouts.values()):
            records = records.unionByName(_joined(lines.where("broken")))
        at = scratch_path(spark, "records")
        parsed = _parsed(records, sorted(layouts))
        parsed.write.partitionBy("layout").parquet(at)
        stored = spark.read.schema(parsed.schema).parquet(at)
        counts = cut_lineage(stored.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("bad")))
        bad = counts.where("bad > 0").select("path")
        for table in sorted({CSV_LAYOUTS[k][0] for k in layouts}):
            parts = [
                stored.where((F.col("layout") == k) & F.col("reason").isNull()).join(bad, "path", "left_anti").select(f"t{k}.*")
                for k in sorted(layouts) if CSV_LAYOUTS[k][0] == table
            ]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            tables.stage(rows, table, root, load)
        names = F.element_at(F.array(*[F.lit(t) for t, _ in CSV_LAYOUTS]), F.col("layout") + 1)
        wrong = stored.where("reason is not null").select(
            _name("path").alias("file"), names.alias("table"), F.col("number").alias("line"), "reason", "record"
        )
        wrong.write.mode("append").parquet(f"{root}/{tables.QUARANTINE}/{tables.LOAD}={load}")
    unread = F.col("header").isNull()  # or not of valid characters
    status = F.when(F.col("seen"), REPEATED).when(wanted & (F.col("bad") > 0), REJECTED).when(wanted, LOADED)
    report = files.join(splits.where("start = 0").select("path", "header", "layout", "table"), "path", "left").join(counts, "path", "left")
    report = cut_lineage(report.select(
        "path", "length", "modified", F.when(wanted, F.col("table")).alias("table"),
        status.when(unread, UNREADABLE).otherwise(SKIPPED).alias("status"),
        F.when(wanted & (F.coalesce("bad", F.lit(0)) == 0), F.coalesce("n", F.lit(0))).otherwise(0).alias("n_rows"),
    ))
    report.where(F.col("status") != REPEATED).write.mode("append").parquet(f"{root}/{tables.FILES}/{tables.LOAD}={load}")
    tables.finish(spark, root, load)
    return _report(report)


def _name(path: str) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _report(rows: DataFrame) -> DataFrame:
    return rows.select(_name("path").alias("file"), "table", "status", "n_rows")


def labelled_urls(spark: SparkSession, path: str) -> DataFrame:
    return read_layout(spark, [path], LABELLED_URLS)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in file order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def numeric_baseline(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    df = read_layout(spark, [path], schema)
    return df.select(*numeric_columns(df))


def coerce_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns in ISO form -> timestamps; other text becomes NULL."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in columns})
