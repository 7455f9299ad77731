"""Registered queries: schema validation and data quality (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.treat import coerce_number
from churnlens.operators import explore as X
from churnlens.operators import quality as Q
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_raw, s_treated

_DOM_COLS = list(S.DOMAINS)
_DOM_VALUES = ", ".join(f"('{c}', '{v}')" for c, values in S.DOMAINS.items() for v in values)
_UNPIVOT_RAW = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value FROM s" for c in _DOM_COLS)


def _raw(spark, sf):
    return s_raw(spark, sf).select(*S.RAW_COLUMNS)


@register("domain_audit", with_s(f"""
, dom(\"column\", value) AS (VALUES {_DOM_VALUES}),
st AS ({_UNPIVOT_RAW})
SELECT st."column", st.value, count(*) AS n, bool_or(dom.value IS NOT NULL) AS in_domain
FROM st LEFT JOIN dom ON st."column" = dom."column" AND st.value = dom.value
WHERE st.value IS NOT NULL GROUP BY st."column", st.value""", treated=False))
def domain_audit(spark, sf):
    """Per domain-checked column and value: count and in-domain flag."""
    return Q.domain_audit(_raw(spark, sf))


@register("out_of_domain", with_s(f"""
, dom(\"column\", value) AS (VALUES {_DOM_VALUES}),
st AS ({_UNPIVOT_RAW})
SELECT DISTINCT "column", value FROM st WHERE value IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM dom WHERE dom."column" = st."column" AND dom.value = st.value)""", treated=False))
def out_of_domain(spark, sf):
    """Distinct out-of-domain values (left-anti join on the domain table)."""
    return Q.out_of_domain(_raw(spark, sf))


_UNPIVOT_BIN = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value FROM t" for c in S.MODEL_BINARIES)


@register("binary_contract", with_s(f"""
, d AS (SELECT DISTINCT * FROM ({_UNPIVOT_BIN}) x WHERE value IS NOT NULL)
SELECT "column", count(*) AS n_distinct, count(CASE WHEN value NOT IN ('0','1') THEN 1 END) AS n_bad,
  array_to_string(list_sort(list(value) FILTER (WHERE value NOT IN ('0','1')))[1:5], ', ') AS bad_sample
FROM d GROUP BY "column\""""))
def binary_contract(spark, sf):
    """The post-treatment 0/1 contract of the 13 model binaries."""
    return Q.binary_contract(s_treated(spark, sf))


@register("duplicate_rows", with_s(
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (customerID, p_score) FROM t)) AS n_duplicates FROM t"))
def duplicate_rows(spark, sf):
    """Exact duplicates of the treated rows without the id."""
    t = s_treated(spark, sf).drop("customerID", "p_score")
    return Q.duplicate_rows(t)


_COERCED_COLS = [c for c in S.RAW_COLUMNS]


@register("null_counts_after_parse", with_s("""
, c AS (SELECT * REPLACE (try_cast(trim(TotalCharges) AS double) AS TotalCharges) FROM s)
SELECT "column", n_null FROM (
  UNPIVOT (SELECT """ + ", ".join(f"count(*) - count({c}) AS {c}" for c in S.RAW_COLUMNS + ["p_score"]) + """ FROM c)
  ON COLUMNS(*) INTO NAME "column" VALUE n_null) WHERE n_null > 0""", treated=False))
def null_counts_after_parse(spark, sf):
    """Null count per column after a coercing parse of TotalCharges (only > 0)."""
    df = s_raw(spark, sf).withColumn("TotalCharges", F.trim("TotalCharges").try_cast("double"))
    return Q.null_counts(df).select("column", F.col("n_null").cast("bigint").alias("n_null"))


@register("unparsed_profile", with_s("""
SELECT 'tenure' AS "column", count(tenure) AS count, avg(tenure) AS mean, stddev_samp(tenure) AS std,
  min(tenure)::double AS min, quantile_cont(tenure, 0.25) AS p25, quantile_cont(tenure, 0.5) AS p50,
  quantile_cont(tenure, 0.75) AS p75, max(tenure)::double AS max
FROM s WHERE try_cast(trim(TotalCharges) AS double) IS NULL""", treated=False))
def unparsed_profile(spark, sf):
    """Describe tenure on the rows whose TotalCharges failed to parse."""
    df = s_raw(spark, sf).filter(F.trim("TotalCharges").try_cast("double").isNull())
    return X.describe(df, ["tenure"])


_CAT = ["gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
        *S.ADDONS, "Contract", "PaperlessBilling", "PaymentMethod", "Churn"]
_UNPIVOT_CAT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::varchar AS value FROM s" for c in _CAT)


@register("distinct_values", with_s(f"SELECT DISTINCT * FROM ({_UNPIVOT_CAT}) x", treated=False))
def distinct_values(spark, sf):
    """Distinct values per categorical column of the raw table."""
    return Q.distinct_values(_raw(spark, sf), _CAT)


_UNPIVOT_ADDON = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", InternetService, {c} AS value FROM s" for c in S.ADDONS)


@register("implication_internet_addons", with_s(f"""
SELECT "column", InternetService, value, count(*) AS n, (InternetService = 'No' AND value = 'Yes') AS violation
FROM ({_UNPIVOT_ADDON}) x GROUP BY ALL""", treated=False))
def implication_internet_addons(spark, sf):
    """Crosstab InternetService × each add-on; no internet ⇒ add-on never Yes."""
    return X.implication_check(_raw(spark, sf), "InternetService", "No", S.ADDONS)


@register("implication_phone_lines", with_s("""
SELECT PhoneService, MultipleLines, count(*) AS n,
  ((PhoneService = 'No') <> (MultipleLines = 'No phone service')) AS violation
FROM s GROUP BY ALL""", treated=False))
def implication_phone_lines(spark, sf):
    """No phone ⇔ 'No phone service' (crosstab + violation flag)."""
    df = _raw(spark, sf)
    return df.groupBy("PhoneService", "MultipleLines").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "violation", (F.col("PhoneService") == "No") != (F.col("MultipleLines") == S.NO_PHONE))


@register("shape", with_s("SELECT count(*) AS n_rows, 21 AS n_cols FROM s", treated=False))
def shape(spark, sf):
    """Shape of the raw table."""
    return Q.shape(_raw(spark, sf)).select("n_rows", F.col("n_cols").cast("int"))


@register("head10", with_s("SELECT * EXCLUDE (p_score) FROM s ORDER BY customerID LIMIT 10", treated=False))
def head10(spark, sf):
    """First 10 rows by id (TakeOrderedAndProject)."""
    return Q.head(_raw(spark, sf), 10)


@register("binary_check", with_s(f"""
SELECT "column", coalesce(bool_and(value IN ('0','1')) FILTER (WHERE value IS NOT NULL), true) AS is_binary
FROM ({_UNPIVOT_BIN}) x GROUP BY "column\""""))
def binary_check(spark, sf):
    """All non-null values in {0,1}, per model binary."""
    return X.all_binary(s_treated(spark, sf), S.MODEL_BINARIES)


@register("coerced_total", with_s("""
SELECT customerID, TotalCharges AS raw_total, coalesce(try_cast(trim(TotalCharges) AS double), 0.0) AS total
FROM s""", treated=False))
def coerced_total(spark, sf):
    """C4: coercing numeric parse, unparsable -> 0."""
    return _raw(spark, sf).select("customerID", F.col("TotalCharges").alias("raw_total"),
                                  coerce_number("TotalCharges").alias("total"))
