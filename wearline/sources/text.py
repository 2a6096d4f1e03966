"""Text sources: raw reading lines, label lines, comma or blank separated job input.

All parsing is built-in string functions (``split``, ``regexp_extract``, ``try_cast``), so it
runs inside whole-stage code generation; no Python touches a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.schema import KEY_COLUMNS, RAW_COLUMNS, RAW_SCHEMA
from wearline.session import open_writers

# Fixed value: the file names the ingest accepts, e.g. train_FD001.txt, test_FD004.txt, RUL_FD002.txt.
# A whole path component, the last or the last but one: a plain file, or a folder of that
# name with part files (as Spark writes it, also as a partition folder ``source=<name>``).
FILE_NAME_PATTERN = r"^(?:.*/)?(?:source=)?((?:train|test|RUL)_FD[0-9]+\.txt)(?:/[^/]+)?$"


def read_lines(spark: SparkSession, path: str | list[str], source: str = "file_path") -> DataFrame:
    """Lines of every text file below ``path`` (a folder, glob or list of them, searched
    recursively), with the file path.

    ``_metadata`` is a hidden column of every file source; the data set and type come from
    the file name, so folder names are never interpreted as partition columns.  Text is
    split by byte ranges, so large files are read by many tasks.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    df = reader.text(path)
    return df.select(F.col(f"_metadata.{source}").alias("source"), "value")


def file_metadata(source: Column | None = None) -> tuple[Column, Column]:
    """(dataset_id, dataset_type) from a file name or path; NULL for other files.

    One regular-expression match per row finds the ``train_/test_/RUL_<id>.txt`` name
    (a plain file, or a folder of that name as Spark writes them); the two parts are then
    cut out with plain string functions.
    """
    src = F.col("source") if source is None else source
    name = F.regexp_extract(src, FILE_NAME_PATTERN, 1)
    kind = F.substring_index(name, "_", 1)
    dsid = F.substring_index(F.substring_index(name, "_", -1), ".", 1)
    dataset_type = (F.when(name == "", F.lit(None).cast("string"))
                    .when(kind == "RUL", F.lit("rul")).otherwise(kind))
    dataset_id = F.when(name == "", F.lit(None).cast("string")).otherwise(dsid)
    return dataset_id, dataset_type


# Fixed value: the white space Python's ``str.strip`` / ``str.split`` act on (ASCII part).
WHITESPACE = " \t\n\r\x0b\x0c"


def stripped(value: Column) -> Column:
    """Line without leading and trailing white space (as Python ``strip``)."""
    return F.btrim(value, F.lit(WHITESPACE))


def split_fields(value: Column | None = None, dual: bool = True) -> Column:
    """Fields of a line: comma-separated if the line holds a comma, else split on runs of
    white space (Python ``split()``).  With ``dual=False`` only commas separate.

    Runs of white space are first turned into one comma by ``regexp_replace`` (pattern
    compiled once per task) and the line is then split on that single character, which
    avoids compiling a split pattern per row.
    """
    v = F.col("value") if value is None else value
    s = stripped(v)
    by_comma = F.split(s, ",")
    if not dual:
        return by_comma
    by_blank = F.split(F.regexp_replace(s, "[ \t\n\r\x0b\x0c]+", ","), ",")
    return F.when(v.contains(","), by_comma).otherwise(by_blank)


def field(fields: Column, i: int) -> Column:
    """Element i (0-based) or NULL when the line is shorter."""
    return F.get(fields, i)


def number(fields: Column, i: int) -> Column:
    """Element i as double, NULL when missing or not a number (Python ``float``; the cast
    itself ignores surrounding white space, as ``float`` does)."""
    return field(fields, i).try_cast("double")


def whole_number(fields: Column, i: int) -> Column:
    """Element i as ``int(float(x))``: truncation toward zero, NULL when invalid."""
    return number(fields, i).try_cast("int")


def _split_once(lines: DataFrame, dual: bool, *keep: str) -> DataFrame:
    """Non-blank lines with their ``fields`` array, computed exactly once per line.

    The split sits in a generator (``explode`` of a one-element array).  Filters on the
    fields cannot be pushed below a generator, so Catalyst does not copy the split into
    each later predicate (which pushing a filter through a projection would do).
    """
    f = split_fields(F.col("value"), dual)
    return (lines.where(F.length(stripped(F.col("value"))) > 0)
            .select(*keep, F.explode(F.array(f)).alias("fields")))


def parse_lines_dual(lines: DataFrame, min_fields: int = 1, dual: bool = True) -> DataFrame:
    """Keep non-blank lines with at least ``min_fields`` fields; adds ``fields``, ``n_fields``."""
    return (_split_once(lines, dual, "source")
            .withColumn("n_fields", F.size("fields"))
            .where(F.col("n_fields") >= min_fields))


_TOKEN = "[^ \t\n\r\x0b\x0c]+"
_GAP = "[ \t\n\r\x0b\x0c]+"


def parse_head(lines: DataFrame, n: int, dual: bool = True) -> DataFrame:
    """Like ``parse_lines_dual(lines, n)`` for jobs that read only the first ``n`` fields:
    keeps non-blank lines with at least ``n`` fields and adds ``fields`` holding exactly
    those first ``n``.

    The rest of the line is never split: comma lines use a split limited to ``n + 1``
    pieces (single-character fast path), blank-separated lines one anchored regular
    expression over the start of the line (pattern compiled once per task).
    """
    s = stripped(F.col("value"))
    by_comma = F.slice(F.split(s, ",", n + 1), 1, n)
    pattern = "^(" + _TOKEN + ")" + "".join(f"(?:{_GAP}({_TOKEN}))?" for _ in range(n - 1))
    # a missing blank-separated token extracts as "" (a token itself is never empty)
    by_blank = F.filter(F.array(*[F.regexp_extract(s, pattern, i + 1) for i in range(n)]),
                        lambda x: x != "")
    head = F.when(F.col("value").contains(","), by_comma).otherwise(by_blank) if dual \
        else by_comma
    return (lines.where(F.length(s) > 0)
            .select("source", F.explode(F.array(head)).alias("fields"))
            .where(F.size("fields") >= n))


def parse_readings(lines: DataFrame, with_metadata: bool = True) -> DataFrame:
    """Typed 26 raw columns (+ dataset_id, dataset_type from the file name).

    A missing or unparsable field is NULL, extra fields (the trailing blank of the raw
    files) are ignored.  Unit and cycle follow the one rule of all jobs, ``int(float(x))``:
    ``1.0`` is 1.  ``parse_ok`` tells whether all 26
    fields were present and valid.
    """
    parsed = _split_once(lines, True, "source")
    cols = []
    for i, fld in enumerate(RAW_SCHEMA.fields):
        whole = fld.dataType.typeName() == "integer"
        cols.append((whole_number if whole else number)(F.col("fields"), i).alias(fld.name))
    out = parsed.select("source", *cols)
    ok = F.lit(True)
    for c in RAW_COLUMNS:
        ok = ok & F.col(c).isNotNull()
    out = out.withColumn("parse_ok", ok)
    if with_metadata:
        dsid, dtype = file_metadata(F.col("source"))
        out = (out.withColumn("dataset_id", dsid).withColumn("dataset_type", dtype)
               .where(F.col("dataset_id").isNotNull()))
    return out


def parse_quality(lines: DataFrame) -> DataFrame:
    """Per file (data set, type) and raw column: lines whose field is missing or not a
    number.  The flags of all 26 columns are summed in one aggregate; only the small
    result is unpivoted to one row per column."""
    p = parse_lines_dual(lines, 1)
    dsid, dtype = file_metadata(F.col("source"))
    flags = [F.sum(number(F.col("fields"), i).isNull().cast("int")).cast("bigint").alias(c)
             for i, c in enumerate(RAW_COLUMNS)]
    wide = (p.withColumn("dataset_id", dsid).withColumn("dataset_type", dtype)
            .where(F.col("dataset_id").isNotNull())
            .groupBy("dataset_id", "dataset_type").agg(*flags))
    return wide.unpivot(["dataset_id", "dataset_type"], RAW_COLUMNS, "column_name",
                        "bad_values")


def parse_rul(lines: DataFrame) -> DataFrame:
    """Label lines -> (rul double, dataset_id, dataset_type='rul')."""
    dsid, dtype = file_metadata(F.col("source"))
    return (lines.where(F.length(stripped(F.col("value"))) > 0)
            .select(stripped(F.col("value")).try_cast("double").alias("rul"),
                    dsid.alias("dataset_id"), dtype.alias("dataset_type"))
            .where(F.col("dataset_type") == "rul"))


def csv_write(df: DataFrame, path: str) -> None:
    """Headerless CSV, one folder per data-set type, like the reference's processed files;
    parts are compressed, and a task writes its types side by side, without sorting its rows."""
    with open_writers(df.sparkSession):
        (df.write.mode("overwrite").option("header", False).option("compression", "gzip")
         .partitionBy("dataset_type").csv(path))


def csv_read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read headerless CSV with a declared schema (no inference): short rows fill NULL,
    bad fields become NULL (PERMISSIVE mode)."""
    from wearline.schema import READINGS_SCHEMA
    from pyspark.sql import types as T

    sch = schema or T.StructType([f for f in READINGS_SCHEMA.fields if f.name != "dataset_type"])
    return spark.read.schema(sch).option("header", False).option("mode", "PERMISSIVE").csv(path)


__all__ = ["read_lines", "file_metadata", "split_fields", "parse_lines_dual", "parse_readings",
           "parse_rul", "number", "whole_number", "field", "csv_write", "csv_read", "KEY_COLUMNS"]
