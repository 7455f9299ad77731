"""Schema validation and data quality.

What is wrong with an input is a table: (column, check, value, n), one row per finding. Column and
type findings come from ``df.schema`` (metadata, no job); value findings of all columns come from
one job: columns are unpivoted to (column, value) pairs, counted, and compared with a broadcast
domain table of a few dozen fixed rows. A validator raises once, with a message made from the table,
and carries the whole table in ``problems``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.treat import NUMBER
from churnlens.operators.lookup import lookup

PROBLEM = "column string, check string, value string, n long"
CORRUPT = "_malformed"  # column of a text table: the whole record, where its fields aren't the header's
RECORD = "(record)"  # stands for the column in findings on whole records
SHOWN = 20  # values named in a message; the table has all


class SchemaError(ValueError):
    """The input is not what the pipeline expects; ``problems`` is the table of all findings."""

    def __init__(self, message: str, problems: DataFrame | None = None) -> None:
        super().__init__(message)
        self.problems = problems


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) of the non-null values, as text."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").filter(F.col("value").isNotNull())


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, v) for c, values in S.DOMAINS.items() for v in values], "column string, value string")


def _checkable(df: DataFrame) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c.name for c in S.COLUMNS if c.domain and c.name in types and c.holds(types[c.name])]


def domain_audit(df: DataFrame) -> DataFrame:
    """(column, value, n, in_domain) for every domain-checked column, nulls ignored."""
    known = F.broadcast(domain_table(df.sparkSession).withColumn("in_domain", F.lit(True)))
    counts = _values(df, _checkable(df)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, ["column", "value"], "left").select(
        "column", "value", "n", F.coalesce("in_domain", F.lit(False)).alias("in_domain"))


def out_of_domain(df: DataFrame) -> DataFrame:
    """Distinct out-of-domain values per column (left-anti join on the domain table)."""
    known = F.broadcast(domain_table(df.sparkSession))
    return _values(df, _checkable(df)).join(known, ["column", "value"], "left_anti").distinct()


def column_problems(df: DataFrame, text: bool = False) -> DataFrame:
    """B1 + B2: missing and unexpected columns, and columns of another kind (``text``: all are text yet)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = [(c.name, "missing", None, None) for c in S.COLUMNS if c.name not in types]
    rows += [(name, "unexpected", None, None) for name in types if name not in S.RAW_COLUMNS and name != CORRUPT]
    if not text:
        rows += [(c.name, f"not {c.kind}", types[c.name].simpleString(), None) for c in S.COLUMNS
                 if c.name in types and not c.holds(types[c.name])]
    return df.sparkSession.createDataFrame(rows, PROBLEM)


def kind_problems(text: DataFrame) -> DataFrame:
    """B2 on a text table (a CSV): the values of int and decimal columns that are no such number, with counts."""
    cols = [c for c in S.COLUMNS if c.kind != "text" and c.name in text.columns]
    if not cols:
        return text.sparkSession.createDataFrame([], PROBLEM)
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c.name, c.kind)])[F.col("column")]
    good = F.when(kind == "int", F.col("value").rlike(r"^\s*[+-]?[0-9]{1,9}\s*$")).otherwise(F.trim("value").rlike(NUMBER))
    bad = _values(text, [c.name for c in cols]).filter(~good)
    return bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select(
        "column", F.concat(F.lit("not "), kind).alias("check"), "value", "n")


def any_text(text: DataFrame):
    """True of every row, but reads a column: Spark's CSV source refuses to give the malformed records alone."""
    first = next((c for c in text.columns if c != CORRUPT), None)
    return F.coalesce(F.length(F.col(f"`{first}`")), F.lit(0)) >= 0 if first else F.lit(True)


def record_problems(text: DataFrame) -> DataFrame:
    """Malformed records of a text table, with counts: too many fields, too few, or a quote left open."""
    width = len(text.columns) - 1
    # what is left without the quoted parts has the separators, and a quote only if one isn't closed
    bare = F.regexp_replace(F.col(CORRUPT), r'"(?:[^"]|"")*"', "")
    n_fields = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    check = F.when(F.contains(bare, F.lit('"')), "open quote").when(n_fields > width, "long record").when(n_fields < width, "short record").otherwise("malformed record")
    return text.where(F.col(CORRUPT).isNotNull() & any_text(text)).groupBy(F.col(CORRUPT).alias("value"), check.alias("check")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(RECORD).alias("column"), "check", "value", "n")


def raw_problems(df: DataFrame, text: bool = False) -> DataFrame:
    """Every finding on a raw table; ``text``: a table read as text, whose numbers are checked by value.
    The values of malformed records aren't judged: the record itself is the finding."""
    if CORRUPT in df.columns:
        records, df = record_problems(df), df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        return records.unionByName(raw_problems(df, text))
    domain = domain_audit(df).filter(~F.col("in_domain")).select("column", F.lit("outside domain").alias("check"), "value", "n")
    found = column_problems(df, text).unionByName(domain)
    return found.unionByName(kind_problems(df)) if text else found


def smallest_values(df: DataFrame, group: str, value: str, k: int, salts: int = 64) -> DataFrame:
    """(group, values): the k smallest distinct values per group, in order — bounded work even when
    one group holds millions of values: rank inside (group, hash-salt) sub-groups first, keep k per
    salt, then rank the ≤ k·salts survivors per group (never a per-group list of every value)."""
    d = df.select(group, value).distinct().withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    w1 = Window.partitionBy(group, "_salt").orderBy(value)
    local = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(group).orderBy(value)
    top = local.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
    return top.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"))  # ≤ k per group


def _raise_for(problems: DataFrame, headline: str) -> None:
    """One SchemaError for all findings: per column and check, the first values and how many there are."""
    keyed = problems.withColumn("_k", F.concat_ws("\x1f", "column", "check"))
    # one row per column and check
    found = keyed.groupBy("_k", "column", "check").agg(F.count("value").alias("distinct")).collect()
    if not found:
        return
    shown = {r["_k"]: r["values"] for r in smallest_values(keyed.filter(F.col("value").isNotNull()), "_k", "value", SHOWN).collect()}
    place = {c: i for i, c in enumerate(S.RAW_COLUMNS)}
    lines = []
    for r in sorted(found, key=lambda r: (r["check"] != "missing", r["check"] != "unexpected", place.get(r["column"], 99), r["column"])):
        values, more = shown.get(r["_k"], []), r["distinct"] - len(shown.get(r["_k"], []))
        lines.append(f"{r['column']}: {r['check']}" + (f": {', '.join(map(repr, values))}" if values else "") + (f" and {more} more" if more else ""))
    raise SchemaError(f"{headline}\n  - " + "\n  - ".join(lines), problems)


def validate_raw(df: DataFrame, text: bool = False) -> None:
    """Raises once for all findings of columns, kinds and domains."""
    _raise_for(raw_problems(df, text), "the raw table breaks its schema:")


def binary_contract(df: DataFrame, cols: list[str] | None = None, sample: int = 5) -> DataFrame:
    """Per model-binary column, distinct values, offending (non-0/1) distinct count and
    a sample of up to ``sample`` offending values ordered as text."""
    cols = [c for c in (cols or S.MODEL_BINARIES) if c in df.columns]
    d = _values(df, cols).distinct()
    bad = ~F.col("value").isin("0", "1")
    counts = d.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.count(F.when(bad, 1)).alias("n_bad"))
    first = smallest_values(d.filter(bad), "column", "value", sample)  # bounded: `sample` mins per column
    return counts.join(first, "column", "left").select(
        "column", "n_distinct", "n_bad",
        F.when(F.col("n_bad") > 0, F.array_join("values", ", ")).alias("bad_sample"))


def treated_problems(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Model binaries that are missing, or hold values other than 0 and 1."""
    cols = cols or S.MODEL_BINARIES
    missing = df.sparkSession.createDataFrame([(c, "missing", None, None) for c in cols if c not in df.columns], PROBLEM)
    bad = _values(df, [c for c in cols if c in df.columns]).filter(~F.col("value").isin("0", "1"))
    return missing.unionByName(bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select(
        "column", F.lit("not 0/1").alias("check"), "value", "n"))


def validate_treated(df: DataFrame, cols: list[str] | None = None) -> None:
    """B5 guard: raises once for all columns that are missing or not 0/1 after treatment."""
    _raise_for(treated_problems(df, cols), "the treated table breaks the feature contract:")


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each exact duplicate group, in two phases: 128-bit digests of all rows
    are counted, then whole rows are compared only where a digest comes again. What is shuffled of the
    other rows is their digest."""
    cols = cols or df.columns
    rows = df.select(*cols).withColumn("_d", F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *reversed(cols)).alias("b")))
    again = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d")
    whole = lookup(rows, again, ["_d"], "left_semi").drop("_d")
    return whole.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))).alias("n_duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column in one pass, only the columns with nulls."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "n_null").filter(F.col("n_null") > 0)


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values per column."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").distinct()


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def dtypes(df: DataFrame) -> DataFrame:
    """Column name, position and Spark type (metadata as a table)."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def head(df: DataFrame, n: int = 10, key: str = S.ID) -> DataFrame:
    """The first ``n`` rows by key (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(key).limit(n)
