"""Readers: catalogs, exports, word lists, pages, images."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcheck.constants import EXPORT_PREFIXES
from shelfcheck.functions.text import CP1252_BYTES, CP1252_SYMBOLS, repair_mojibake
from shelfcheck.operators.catalog import standardize_columns

SEPARATORS = [",", ";", "\t"]


def _header(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """Is every line valid UTF-8?  The text source keeps raw bytes; the probe stops at the first bad line."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def _csv(spark: SparkSession, path, sep: str, encoding: str, line_breaks: bool = True) -> DataFrame:
    """Text columns of a CSV file; with ``line_breaks`` by Spark's reader for whole files, one task for each."""
    return (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", line_breaks)
        .option("inferSchema", False).option("quote", '"').option("escape", '"').csv(path)
    )


def _ends_quoted(line: Column, sep: str) -> Column:
    """Does a line that starts outside quotes end inside a quoted field?  A quote opens only where a field starts."""
    other, quoted = f"[^{re.escape(sep)}]", '"[^"]*+(?:""[^"]*+)*+'
    field = f'(?:{quoted}"{other}*+|(?!"){other}*+)'
    return line.rlike(f'\\A(?:{field}{re.escape(sep)})*+{quoted}\\z')


def _with_state(rows: DataFrame, outside: str, inside: str, window) -> DataFrame:
    """Add ``_if_out`` and ``_if_in``: the state before each row if the window starts outside or inside quotes.

    Each row maps the state: to a fixed one, to the other, or not at all. What counts is the last fixed one and
    how often the state was changed after it.
    """
    changes = F.sum((F.col(outside) & ~F.col(inside)).cast("long")).over(window)
    rows = rows.withColumn("_changes", changes)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col(outside) == F.col(inside), F.struct(F.col(outside).alias("to"), F.col("_changes").alias("at")))
    last, now = F.last(fixed, ignorenulls=True).over(before), F.coalesce(F.max("_changes").over(before), F.lit(0))
    odd = (now - F.coalesce(last["at"], F.lit(0))) % 2 == 1
    known = F.when(last.isNotNull(), last["to"] != odd)
    return rows.withColumns({"_if_out": F.coalesce(known, odd), "_if_in": F.coalesce(known, ~odd)})


def _lines(spark: SparkSession, path, sep: str) -> DataFrame:
    """Lines with file, split and place, how they change the state, and the spans opened up to them within the split."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    lines = lines.withColumns({"_out": _ends_quoted(F.col("value"), sep), "_in": _ends_quoted(F.concat(F.lit('"'), "value"), sep)})
    split = Window.partitionBy("_path", "_block").orderBy("_row")
    lines = _with_state(lines, "_out", "_in", split).withColumn("_number", F.row_number().over(split))
    opened = lambda state: F.sum((~F.col(state) & F.col("_out")).cast("long")).over(split)
    return lines.withColumns({"_opened_out": opened("_if_out"), "_opened_in": opened("_if_in")})


def _splits(lines: DataFrame) -> DataFrame:
    """One row for each split: the state it starts in, the spans opened before it, and whether its file is UTF-8."""
    end = lambda state: F.max_by(F.when(F.col(state), F.col("_in")).otherwise(F.col("_out")), "_row")
    splits = lines.groupBy("_path", "_block").agg(
        end("_if_out").alias("_end_out"), end("_if_in").alias("_end_in"), F.max("_opened_out").alias("_all_out"),
        F.max("_opened_in").alias("_all_in"), F.bool_and(F.is_valid_utf8("value")).alias("_valid"))
    order = Window.partitionBy("_path").orderBy("_block")
    splits = _with_state(splits, "_end_out", "_end_in", order).withColumnRenamed("_if_out", "_quoted")
    opened = F.sum(F.when(F.col("_quoted"), F.col("_all_in")).otherwise(F.col("_all_out"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    return splits.select("_path", "_block", "_quoted", F.coalesce(opened, F.lit(0)).alias("_before"),
                         F.min("_valid").over(Window.partitionBy("_path")).alias("_utf8"))


def read_records(spark: SparkSession, path, sep: str, encoding: str | None = "UTF-8", file: int = 0) -> DataFrame:
    """CSV files whose quoted fields may hold line breaks, read in splits; every column text, ``_seq`` the file order.

    Each line maps the state "inside quotes" to a state; the maps are composed within the splits and then over the one
    row that each split leaves, so that every line knows whether it goes on with a record that began before, in another
    split maybe. Only lines of records of several lines are brought together. Encoding None: UTF-8, or code page 1252
    for files with a line that is none, found in the same pass. A quote that is never closed takes the rest of its file
    into one record, as in any reader. Blank records are left out; fields that are missing are null.
    """
    names = _csv(spark, path, sep, "UTF-8" if encoding is None else encoding).columns
    lines = _lines(spark, path, sep)
    lines = lines.join(_splits(lines), ["_path", "_block"])
    quoted = F.when(F.col("_quoted"), F.col("_if_in")).otherwise(F.col("_if_out"))
    span = F.col("_before") + F.when(F.col("_quoted"), F.col("_opened_in")).otherwise(F.col("_opened_out"))
    spans = quoted | F.col("_out")
    part = F.struct("_block", "_row", "_number", "value")
    lines = lines.select("_path", "_name", "_utf8", spans.alias("_spans"), span.alias("_span"), part.alias("_part"))
    one = lines.where("NOT _spans").select("_name", "_utf8", "_part", F.col("_part.value").alias("_text"))
    many = lines.where("_spans").groupBy("_path", "_name", "_utf8", "_span").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    many = many.select("_name", "_utf8", F.col("_parts")[0].alias("_part"), F.concat_ws("\n", "_parts.value").alias("_text"))
    rows = one.unionByName(many).where("NOT (_part._block = 0 AND _part._number = 1)")
    text = F.col("_text")
    if encoding != "UTF-8":
        single = F.decode(text.cast("binary"), "ISO-8859-1")
        text = single if encoding else F.when(F.col("_utf8"), text).otherwise(F.translate(single, CP1252_BYTES, CP1252_SYMBOLS))
    text = F.regexp_replace(text, "\r\\z", "")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv(text, schema, {"sep": sep, "quote": '"', "escape": '"'})
    seq = F.struct(F.lit(file).alias("file"), F.col("_name").alias("name"), F.col("_part._block").alias("block"), F.col("_part._row").alias("row"))
    rows = rows.where(F.trim("_text") != "").select(fields.alias("_f"), seq.alias("_seq"))
    return rows.select(*[F.col(f"_f.c{i}").alias(n) for i, n in enumerate(names)], "_seq")


def with_order(df: DataFrame, file: int = 0) -> DataFrame:
    """Add ``_seq`` = (file, block, row): file order without a global sort.

    Inside one task rows come in file order and the generated id grows; the
    block start orders the tasks of one file.
    """
    return df.withColumn("_seq", F.struct(
        F.lit(file).alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    ))


def _as_cp1252(df: DataFrame) -> DataFrame:
    """Text read as latin-1 that was written as code page 1252."""
    names = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.translate(F.col(f"`{c}`"), CP1252_BYTES, CP1252_SYMBOLS) for c in names})


def _read(spark: SparkSession, path, sep: str, encoding: str, file: int, line_breaks: bool) -> DataFrame:
    """A CSV file with its order. Pass ``line_breaks`` False for files whose fields are known to have none."""
    return read_records(spark, path, sep, encoding, file) if line_breaks else with_order(_csv(spark, path, sep, encoding, False), file)


def read_catalog_csv(spark: SparkSession, path: str, file: int = 0, line_breaks: bool = True) -> DataFrame:
    """Catalog CSV: separator and encoding found from the file, every column text."""
    header = _header(spark, path)
    sep = next((s for s in SEPARATORS if s in header), ",")
    if line_breaks:
        raw, utf8 = read_records(spark, path, sep, None, file), True
    else:
        utf8 = _is_utf8(spark, path)
        raw = with_order(_csv(spark, path, sep, "UTF-8" if utf8 else "ISO-8859-1", False), file)
    names = {c: c.lstrip("\ufeff").strip('"') for c in raw.columns}
    out = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return out if utf8 else _as_cp1252(out)


def read_pipe_csv(spark: SparkSession, path: str, file: int = 0, line_breaks: bool = True) -> DataFrame:
    header = _header(spark, path)
    return _read(spark, path, "|" if "|" in header else ",", "UTF-8", file, line_breaks)


def read_csv_semicolon_fallback(spark: SparkSession, path: str, file: int = 0, line_breaks: bool = True) -> DataFrame:
    header = _header(spark, path)
    if "," in header and _is_utf8(spark, path):
        return _read(spark, path, ",", "UTF-8", file, line_breaks)
    return _read(spark, path, ";", "ISO-8859-1", file, line_breaks)


def read_many(spark: SparkSession, paths: list[str], reader=read_catalog_csv, repair: bool = True) -> DataFrame:
    """Several files, each standardised, united by column name; ``_file`` keeps the origin."""
    parts = []
    for i, path in enumerate(paths):
        df = reader(spark, path, i)
        if repair:
            df = df.select(*[repair_mojibake(f"`{c}`").alias(c) if c != "_seq" else F.col(c) for c in df.columns])
        parts.append(standardize_columns(df).withColumn("_file", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def export_file_columns(df: DataFrame, file_name) -> DataFrame:
    """Country, date, week day and ISO week of an export from its file name; undated files drop out."""
    prefix = F.upper(F.substring(file_name, 1, 2))
    pairs = [F.lit(x) for kv in EXPORT_PREFIXES.items() for x in kv]
    date = F.try_to_date(F.regexp_extract(file_name, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    return df.withColumns({
        "Date": date,
        "Country": F.coalesce(F.element_at(F.create_map(*pairs), prefix), F.lit("Unknown Country")),
    }).filter(F.col("Date").isNotNull()).withColumns({
        "Day": F.date_format("Date", "EEEE"), "Week": F.weekofyear("Date"),
    })


def read_export_files(spark: SparkSession, path, line_breaks: bool = True) -> DataFrame:
    """Weekly export CSVs of one or more paths (a directory or a list)."""
    raw = _read(spark, path, ",", "UTF-8", 0, line_breaks)
    return export_file_columns(raw.withColumn("_name", F.col("_seq.name")), F.col("_name")).drop("_name", "_seq")


def read_word_list(spark: SparkSession, path: str, list_name: str, lower: bool = False) -> DataFrame:
    word = F.trim("value")
    return spark.read.text(path).select(
        F.lit(list_name).alias("list_name"), (F.lower(word) if lower else word).alias("word")
    ).filter("word <> ''")


def read_code_list(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    return read_word_list(spark, path, list_name).withColumnRenamed("word", "code")


def read_master(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    encoding = "UTF-8" if _is_utf8(spark, path) else "ISO-8859-1"
    return _read(spark, path, ",", encoding, 0, line_breaks)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images: ``image.origin, height, width, nChannels, data`` (BGR bytes); a file that cannot be decoded has height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def read_pages(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Stored pages (page_id, url, html); one file per page with ``wholetext``."""
    if not wholetext:
        return spark.read.parquet(path)
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
