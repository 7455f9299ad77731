"""Sources and sinks (A1-A3, A8, A9): raw CSV with an explicit schema, the
load → validate → treat → validate composition, JSON reports and CSV exports.

Reports are one-row nested structs written with ``df.write.json`` into their
own folder (no driver-side file I/O), so they land on the shared filesystem
the cluster uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnlens import schema as S
from churnlens.functions.treat import treat
from churnlens.operators.quality import CORRUPT, SchemaError, any_text, column_problems, raw_problems, validate_raw, validate_treated

#: RFC 4180: a quote inside a quoted field is doubled, and a quoted field may hold separators and line feeds
_CSV_OPTS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
MOST_CHARS = 1 << 20  # of a field: beyond it an open quote is taken to swallow the file, and the read fails

#: fixed values: texts that many readers take for a missing value; an empty field always is one
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null"]


def _header(spark: SparkSession, path: str, multiline: bool) -> list[str]:
    row = spark.read.options(**{**_CSV_OPTS, "header": "false"}, multiLine=multiline).csv(path).first()
    return [name or "" for name in row or ()]


def column_names(header: list[str]) -> list[str]:
    """The header's names; one that comes again gets a number (``x``, ``x.1``, ``x.2``), an empty one its place."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = name or f"column {i + 1}"
        again, n = name, 0
        while again in out:
            n += 1
            again = f"{name}.{n}"
        out.append(again)
    return out


def read_text_csv(spark: SparkSession, path: str, multiline: bool = True, missing: Sequence[str] = ()) -> DataFrame:
    """A CSV with header: every column as text under its own name, and the whole record in ``CORRUPT`` where
    its number of fields isn't the header's (null otherwise).

    ``multiline``: quoted fields may hold line feeds; files are then read whole, one task each, as a stream.
    Without it large files are split, and a record with an open quote is a malformed one. Files whose
    headers differ are an error. ``missing``: texts that stand for a missing value (``MISSING`` has the usual ones).
    """
    header = _header(spark, path, multiline)
    names = column_names(header)
    if not names:
        return spark.createDataFrame([], StructType([StructField(CORRUPT, StringType())]))
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    rows = spark.read.options(**_CSV_OPTS, multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, maxCharsPerColumn=MOST_CHARS, columnPruning=False,
                              enforceSchema=names != header).schema(schema).csv(path)
    gone = ["", *missing]
    return rows.select(*[F.when(~F.col(f"`{n}`").isin(gone), F.col(f"`{n}`")).alias(n) for n in names], CORRUPT)


def whole_records(text: DataFrame) -> DataFrame:
    """The records of a text table without ``CORRUPT``; a malformed one fails the job that reads it, with its text."""
    sound = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("malformed record: "), CORRUPT)).cast("boolean")).otherwise(any_text(text))
    return text.where(sound).drop(CORRUPT)


def typed(text: DataFrame) -> DataFrame:
    """The declared columns, taken by name and cast to their kinds (null where a value is no such number)."""
    return text.select(*[F.trim(c.name).try_cast(c.spark_type).alias(c.name) if c.kind != "text" else F.col(c.name) for c in S.COLUMNS])


def csv_problems(spark: SparkSession, path: str, multiline: bool = True, missing: Sequence[str] = ()) -> DataFrame:
    """B1-B4 on a CSV: (column, check, value, n) of everything that breaks the schema, malformed records included."""
    return raw_problems(read_text_csv(spark, path, multiline, missing), text=True)


def read_raw_csv(spark: SparkSession, path: str, multiline: bool = True, missing: Sequence[str] = ()) -> DataFrame:
    """A1: the raw subscriber CSV, columns by header name, no inference. Missing and unexpected columns
    raise at once, malformed records when they are read. ``TotalCharges`` stays text so blanks survive
    to the treatment."""
    text = read_text_csv(spark, path, multiline, missing)
    broken = column_problems(text, text=True)
    if not broken.isEmpty():
        raise SchemaError(f"{path}: " + ", ".join(f"{r['column']} {r['check']}" for r in broken.collect()), broken)
    return typed(whole_records(text))


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write a raw table as header CSV, keeping whitespace-only values as they are."""
    df.write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def load_treated(spark: SparkSession, path: str, multiline: bool = True, missing: Sequence[str] = ()) -> DataFrame:
    """A2: load → validate (all problems at once, numbers by value) → treat → validate the 0/1 contract."""
    text = read_text_csv(spark, path, multiline, missing)
    validate_raw(text, text=True)
    treated = treat(typed(whole_records(text)))
    validate_treated(treated)
    return treated


def write_report(df: DataFrame, path: str) -> None:
    """Write a (usually one-row, nested) report as JSON into its own folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A3: read a saved report; None when it does not exist. A broken report raises."""
    try:
        return spark.read.json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def champion_name(spark: SparkSession, comparison_path: str, default: str = "logistic") -> str:
    """A3: champion from the comparison report, falling back to logistic when absent."""
    rep = read_report(spark, comparison_path)
    if rep is None or "champion" not in rep.columns:
        return default
    row = rep.select("champion").first()
    return row["champion"] if row and row["champion"] else default


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header, in the rows' order if they have one; the customer id is an ordinary column."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def nested(df: DataFrame):
    """A small result table as an array-of-struct scalar subquery, for nesting in a one-row report."""
    return df.agg(F.collect_list(F.struct(*df.columns))).scalar()
