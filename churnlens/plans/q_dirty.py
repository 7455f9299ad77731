"""Registered queries: quality checks on D, the subscriber table with planted faults.

On the clean table these checks have nothing to find; here each has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions import treat as TR
from churnlens.functions.treat import treat
from churnlens.models.evaluation import scratch_path
from churnlens.operators import explore as X
from churnlens.operators import quality as Q
from churnlens.oracle import with_d, with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_raw
from churnlens.sources import raw as RAW
from churnlens.sources.fixtures import dirty_subscribers

_DOM_VALUES = ", ".join(f"('{c}', '{v}')" for c, values in S.DOMAINS.items() for v in values)
_DOM = f"""(SELECT "column", value, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{c}' AS {chr(34)}column{chr(34)}, {c}::varchar AS value FROM d" for c in S.DOMAINS)}) u
  WHERE value IS NOT NULL AND ("column", value) NOT IN (VALUES {_DOM_VALUES}) GROUP BY "column", value)"""


def _dirty(spark, sf):
    return dirty_subscribers(s_raw(spark, sf))


@register("dirty_out_of_domain", with_d(f'SELECT "column", value FROM {_DOM}'))
def dirty_out_of_domain(spark, sf):
    """B3 / E9 with planted values."""
    return Q.out_of_domain(_dirty(spark, sf))


@register("csv_problems", with_d(f"""SELECT "column", 'outside domain' AS "check", value, n FROM {_DOM}
UNION ALL SELECT 'tenure', 'not int', 'abc', count(*) FROM d WHERE cast(customerID AS bigint) % 43 = 0 HAVING count(*) > 0
UNION ALL SELECT 'MonthlyCharges', 'not decimal', '12D', count(*) FROM d WHERE cast(customerID AS bigint) % 47 = 0 HAVING count(*) > 0
UNION ALL SELECT 'extra', 'unexpected', NULL, NULL UNION ALL SELECT 'Dependents', 'missing', NULL, NULL"""
    .replace("('Dependents', 'Yes'), ('Dependents', 'No'), ", "").replace("""SELECT 'Dependents' AS "column", Dependents::varchar AS value FROM d UNION ALL """, "")))
def csv_problems(spark, sf):
    """B1-B4 on a CSV whose columns stand in another order, with one missing, one too many, and text for numbers."""
    k = F.col(S.ID).cast("bigint")
    d = _dirty(spark, sf).withColumns({
        "tenure": F.when(k % 43 == 0, "abc").otherwise(F.col("tenure").cast("string")),
        "MonthlyCharges": F.when(k % 47 == 0, "12D").otherwise(F.col("MonthlyCharges").cast("string")), "extra": F.lit("x")})
    path = scratch_path(spark, "dirty-csv")
    RAW.write_raw_csv(d.select("extra", *[c for c in reversed(S.RAW_COLUMNS) if c != "Dependents"]), path)
    return RAW.csv_problems(spark, path)


def _line(names, values=None) -> Column:
    """One CSV record of the columns, null as nothing."""
    values = values or {}
    return F.concat_ws(",", *[F.coalesce(values.get(c, F.col(c)).cast("string"), F.lit("")) for c in names])


def _write_records(df, path, names):
    """Text files of ready records, each file with the header in front."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.concat(F.when(first, F.lit(",".join(names) + "\n")).otherwise(""), "line").alias("value")).write.text(path)


_KEY = "cast(customerID AS bigint)"


@register("csv_malformed", with_s(f"""SELECT '(record)' AS "column", 'long record' AS "check", NULL AS value, count(*) AS n FROM s WHERE {_KEY} % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT '(record)', 'short record', NULL, count(*) FROM s WHERE {_KEY} % 7 = 1 HAVING count(*) > 0
UNION ALL SELECT 'PaymentMethod', 'outside domain', 'Electronic "check", by hand', count(*) FROM s WHERE {_KEY} % 7 = 2 HAVING count(*) > 0
UNION ALL SELECT 'PaymentMethod', 'outside domain', 'Mailed' || chr(10) || 'check', count(*) FROM s WHERE {_KEY} % 7 = 3 HAVING count(*) > 0
UNION ALL SELECT 'gender.1', 'unexpected', NULL, NULL""", treated=False))
def csv_malformed(spark, sf):
    """A1, B1-B4 on a CSV with a field too many, two too few, doubled quotes, a quoted line feed and a column named twice."""
    names = [*S.RAW_COLUMNS, "gender"]
    k = F.col(S.ID).cast("bigint") % 7
    quoted = {"PaymentMethod": F.when(k == 2, F.lit('"Electronic ""check"", by hand"')).when(k == 3, F.lit('"Mailed\ncheck"')).otherwise(F.col("PaymentMethod"))}
    line = F.when(k == 0, F.concat(_line(names), F.lit(",more"))).when(k == 1, _line(names[:-2])).otherwise(_line(names, quoted))
    path = scratch_path(spark, "malformed-csv")
    _write_records(s_raw(spark, sf).select(line.alias("line")), path, names)
    found = RAW.csv_problems(spark, path)
    value = F.when(F.col("column") != Q.RECORD, F.col("value"))
    return found.groupBy("column", "check", value.alias("value")).agg(F.sum("n").alias("n"))


@register("csv_quoted", with_s("""SELECT * EXCLUDE (p_score) REPLACE (
  customerID || ' "a", b' || chr(10) || 'c\\' AS customerID, nullif(TotalCharges, '') AS TotalCharges) FROM s""", treated=False))
def csv_quoted(spark, sf):
    """A1: ids with quotes, separators, line feeds and a backslash come back as they were."""
    path = scratch_path(spark, "quoted-csv")
    raw = s_raw(spark, sf).select(*S.RAW_COLUMNS).withColumn(S.ID, F.concat(S.ID, F.lit(' "a", b\nc\\')))
    RAW.write_raw_csv(raw, path)
    return RAW.read_raw_csv(spark, path)


@register("raw_csv_reordered", with_d("SELECT * EXCLUDE (p_score) FROM s"))
def raw_csv_reordered(spark, sf):
    """A1: columns are taken by header name, whatever their order in the file."""
    path = scratch_path(spark, "reordered-csv")
    RAW.write_raw_csv(s_raw(spark, sf).select(*reversed(S.RAW_COLUMNS)), path)
    return RAW.read_raw_csv(spark, path)


_BIN = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value FROM td" for c in S.MODEL_BINARIES)


@register("dirty_binary_contract", with_d(f"""
SELECT "column", count(*) AS n_distinct, count(CASE WHEN value NOT IN ('0','1') THEN 1 END) AS n_bad,
  array_to_string(list_sort(list(value) FILTER (WHERE value NOT IN ('0','1')))[1:5], ', ') AS bad_sample
FROM (SELECT DISTINCT * FROM ({_BIN}) x WHERE value IS NOT NULL) GROUP BY "column\""""))
def dirty_binary_contract(spark, sf):
    """B5 with a flag that is 2."""
    return Q.binary_contract(treat(_dirty(spark, sf)))


@register("dirty_binary_check", with_d(f"""
SELECT "column", coalesce(bool_and(value IN ('0','1')) FILTER (WHERE value IS NOT NULL), true) AS is_binary FROM ({_BIN}) x GROUP BY "column\""""))
def dirty_binary_check(spark, sf):
    """D6 with a flag that is 2."""
    return X.all_binary(treat(_dirty(spark, sf)), S.MODEL_BINARIES)


@register("dirty_duplicate_rows", with_d("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_duplicates FROM d"))
def dirty_duplicate_rows(spark, sf):
    """B6 with rows that come twice."""
    return Q.duplicate_rows(_dirty(spark, sf))


@register("dirty_null_counts", with_d(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM td HAVING count(*) > count({c})" for c in S.RAW_COLUMNS)))
def dirty_null_counts(spark, sf):
    """B7 after treatment: nulls of the file and values that map to nothing."""
    return Q.null_counts(treat(_dirty(spark, sf)))


@register("dirty_implications", with_d(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", InternetService, {c} AS value, count(*) AS n, (InternetService = 'No' AND {c} = 'Yes') AS violation FROM d GROUP BY ALL"
    for c in S.ADDONS)))
def dirty_implications(spark, sf):
    """B10 with add-ons that have no internet service."""
    return X.implication_check(_dirty(spark, sf), "InternetService", "No", S.ADDONS)


@register("dirty_feasibility", with_d(" UNION ALL ".join(
    ["SELECT 'MultipleLines' AS \"column\", count(*) FILTER (WHERE PhoneService = 0 AND MultipleLines <> 0) AS n_violations FROM td"]
    + [f"SELECT '{c}', count(*) FILTER (WHERE InternetService = 'No' AND {c} <> 0) FROM td" for c in S.ADDONS])))
def dirty_feasibility(spark, sf):
    """C10 with lines and add-ons that have no service."""
    return TR.feasibility_violations(treat(_dirty(spark, sf)))


@register("enforced_feasible", with_d(f"""
SELECT customerID, CASE WHEN PhoneService = 0 THEN 0 ELSE MultipleLines END AS MultipleLines,
  {', '.join(f"CASE WHEN InternetService = 'No' THEN 0 ELSE {c} END AS {c}" for c in S.ADDONS)} FROM td"""))
def enforced_feasible(spark, sf):
    """Options without their service set to 0."""
    return TR.enforce_feasible(treat(_dirty(spark, sf))).select("customerID", "MultipleLines", *S.ADDONS)


_CATS = ["Contract", "PaymentMethod", "InternetService"]


@register("dirty_rare_categories", with_d(f"""
SELECT "column", value, n, round(n / total, 6) AS share FROM (
  SELECT "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "column") AS total
  FROM ({' UNION ALL '.join(f"SELECT '{c}' AS {chr(34)}column{chr(34)}, {c} AS value FROM td" for c in _CATS)}) GROUP BY "column", value)
WHERE n / total < 0.05"""))
def dirty_rare_categories(spark, sf):
    """D5 at the EDA's 5 % with a category that rare."""
    df = X.rare_categories(treat(_dirty(spark, sf)), _CATS, threshold=0.05)
    return df.select("column", "value", "n", F.round("share", 6).alias("share"))
