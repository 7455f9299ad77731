"""Subscriber tables derived from the driver's TPC-H-like parquet tables.

* ``planted_subscribers`` (S): the 21 raw columns plus a fixed scorecard
  ``p_score``, generated row-locally from a key column with md5-derived
  uniforms. It has planted churn signal, blank ``TotalCharges`` exactly when
  tenure is 0, and both service implications. Row-local, so it is a narrow
  projection over the key scan: no shuffle, scales with the key table.
* ``real_subscribers`` (R): tenure / spend / churn from ``orders`` joined to
  ``customer`` and ``nation``; for joins and aggregates (its label has no signal).

The same definitions are written as DuckDB SQL in ``churnlens.oracle`` so that
every query has an independent oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import schema as S

# key column per base table
BASE_KEYS = {"customer": "c_custkey", "orders": "o_orderkey"}

# --- fixed values of the planted generator (FIXTURES.md §2) -----------------
U_TAGS = ["gen", "sen", "par", "dep", "pho", "pap", "ten", "net", "con", "pay", "ml",
          "sec", "bak", "dev", "sup", "stv", "smo", "mc", "res", "ch"]
ADDON_TAGS = {"OnlineSecurity": ("sec", 0.37), "OnlineBackup": ("bak", 0.44),
              "DeviceProtection": ("dev", 0.44), "TechSupport": ("sup", 0.37),
              "StreamingTV": ("stv", 0.49), "StreamingMovies": ("smo", 0.50)}
# ---------------------------------------------------------------------------


def uniform(tag: str, key: Column) -> Column:
    """u(tag) = first 8 hex digits of md5(tag|key) as an integer / 2^32."""
    h = F.substring(F.md5(F.concat(F.lit(tag), F.lit("|"), key.cast("string"))), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def _yes(u: Column, cut: float) -> Column:
    return F.when(u < cut, "Yes").otherwise("No")


def planted_subscribers(spark: SparkSession, sf_dir: str, base: str = "customer") -> DataFrame:
    key = BASE_KEYS[base]
    k = spark.read.parquet(f"{sf_dir}/{base}.parquet").select(F.col(key).alias("k"))
    # Generation is CPU-heavy (20 md5 per row) and row-local. A small key file is one
    # scan split; spread it over the cores by hashing the key (deterministic on retry).
    # On a large input the scan already has many splits and no exchange is added.
    try:
        cores = spark.sparkContext.defaultParallelism
        if k.rdd.getNumPartitions() < cores:
            k = k.repartition(cores, "k")
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): keep the scan split
        pass
    u = k.select("k", *[uniform(t, F.col("k")).alias(f"u_{t}") for t in U_TAGS])
    c = F.col
    internet = (F.when(c("u_net") < 0.34, "DSL").when(c("u_net") < 0.78, "Fiber optic").otherwise("No"))
    contract = (F.when(c("u_con") < 0.55, "Month-to-month").when(c("u_con") < 0.76, "One year")
                .otherwise("Two year"))
    step1 = u.select(
        "*",
        F.floor(c("u_ten") * 73).cast("int").alias("tenure"),
        internet.alias("InternetService"),
        contract.alias("Contract"),
        _yes(c("u_pho"), 0.90).alias("PhoneService"),
    )
    monthly = F.round(
        F.when(c("InternetService") == "No", F.lit(18.25) + F.lit(8.0) * c("u_mc"))
        .when(c("InternetService") == "DSL", F.lit(45.0) + F.lit(30.0) * c("u_mc"))
        .otherwise(F.lit(70.0) + F.lit(48.0) * c("u_mc")), 2)
    step2 = step1.withColumn("MonthlyCharges", monthly)
    total = F.when(c("tenure") == 0, F.lit(" ")).otherwise(
        F.round(c("tenure") * c("MonthlyCharges") + (c("u_res") - 0.5) * 57.0, 2)
        .cast("decimal(12,2)").cast("string"))
    contract_churn = F.when(c("Contract") == "Month-to-month", 0.40).when(c("Contract") == "One year", 0.12).otherwise(0.04)
    internet_churn = F.when(c("InternetService") == "Fiber optic", 0.15).when(c("InternetService") == "No", -0.03).otherwise(0.0)
    tenure_churn = F.when(c("tenure") <= 12, 0.15).otherwise(-0.05)
    contract_logit = F.when(c("Contract") == "Month-to-month", 1.6).when(c("Contract") == "One year", 0.2).otherwise(-0.9)
    internet_logit = F.when(c("InternetService") == "Fiber optic", 0.7).when(c("InternetService") == "No", -0.2).otherwise(0.0)
    tenure_logit = F.when(c("tenure") <= 12, 0.4).otherwise(0.0)
    logit = F.lit(-2.2) + contract_logit + internet_logit - F.lit(0.02) * c("tenure") + tenure_logit
    addons = {
        col: F.when(c("InternetService") == "No", F.lit(S.NO_INTERNET)).otherwise(_yes(c(f"u_{tag}"), cut))
        for col, (tag, cut) in ADDON_TAGS.items()
    }
    payment = (F.when(c("u_pay") < 0.34, S.PAYMENT[0]).when(c("u_pay") < 0.57, S.PAYMENT[1])
               .when(c("u_pay") < 0.79, S.PAYMENT[2]).otherwise(S.PAYMENT[3]))
    cols = {
        "customerID": c("k").cast("string"),
        "gender": F.when(c("u_gen") < 0.505, "Male").otherwise("Female"),
        "SeniorCitizen": F.when(c("u_sen") < 0.16, 1).otherwise(0),
        "Partner": _yes(c("u_par"), 0.48),
        "Dependents": _yes(c("u_dep"), 0.30),
        "tenure": c("tenure"),
        "PhoneService": c("PhoneService"),
        "MultipleLines": F.when(c("PhoneService") == "No", F.lit(S.NO_PHONE)).otherwise(_yes(c("u_ml"), 0.47)),
        "InternetService": c("InternetService"),
        **addons,
        "Contract": c("Contract"),
        "PaperlessBilling": _yes(c("u_pap"), 0.59),
        "PaymentMethod": payment,
        "MonthlyCharges": c("MonthlyCharges"),
        "TotalCharges": total,
        "Churn": F.when(c("u_ch") < contract_churn + internet_churn + tenure_churn, "Yes").otherwise("No"),
        "p_score": F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 6),
    }
    return step2.select(*[expr.alias(name) for name, expr in cols.items()])


def _div_half_up(num, den):
    """round(num / den) half-up for non-negative integers, exactly: (2·num + den) div (2·den)."""
    a, b = num * 2 + den, den * 2
    return ((a - F.pmod(a, b)) / b).cast("long")


def raw_subscribers(spark: SparkSession, sf_dir: str, base: str = "customer") -> DataFrame:
    """The 21 raw columns of S (what a CSV export of the subscriber table would hold)."""
    return planted_subscribers(spark, sf_dir, base).select(*S.RAW_COLUMNS)


def real_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: subscribers from orders ⋈ customer ⋈ nation (FIXTURES.md §3)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderdate")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    om = orders.withColumn("m", month)
    ref_m = om.agg(F.max("m")).scalar()  # reference month as a scalar subquery
    aged = om.withColumn("age", ref_m - F.col("m"))
    pre = F.col("age") >= 12
    # money in exact integer cents so the sum does not depend on summation order
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    per_cust = aged.groupBy("o_custkey").agg(
        F.count(F.when(pre, 1)).alias("n_pre"),
        F.sum(F.when(pre, cents)).alias("cents_pre"),
        F.max("age").alias("max_age"),
        F.count(F.when(~pre, 1)).alias("n_post"),
    ).filter(F.col("n_pre") >= 1)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    return (
        per_cust.join(customer, per_cust.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_custkey").cast("string").alias("customerID"),
            (F.col("max_age") - 12).cast("int").alias("tenure"),
            # round(x / 2000, 2) and round(x / n / 2000, 2), half-up, in integer cents
            (_div_half_up(F.col("cents_pre"), F.lit(2000)) / 100.0).alias("TotalCharges"),
            (_div_half_up(F.col("cents_pre"), F.col("n_pre") * 2000) / 100.0).alias("MonthlyCharges"),
            F.when(F.col("n_pre") <= 6, "Month-to-month").when(F.col("n_pre") <= 10, "One year")
            .otherwise("Two year").alias("Contract"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_regionkey").cast("int").alias("region"),
            F.when(F.col("n_post") == 0, 1).otherwise(0).alias("Churn"),
        )
    )


def dirty_subscribers(raw: DataFrame) -> DataFrame:
    """D: the raw table with planted faults, row-locally by the id's remainders, for the quality checks:
    values out of domain, nulls, a flag that is 2, options without their service, a rare category, and
    rows that come twice. ``churnlens.oracle.D_CTE`` is the DuckDB twin."""
    def planted(column: str, modulus: int, value) -> Column:
        return F.when(F.pmod(F.col(S.ID).cast("bigint"), F.lit(modulus)) == 0, F.lit(value)).otherwise(F.col(column)).alias(column)

    d = raw.select(*[planted(c, *DIRT[c]) if c in DIRT else F.col(c) for c in S.RAW_COLUMNS])
    twice = F.pmod(F.col(S.ID).cast("bigint"), F.lit(37)) == 0
    return d.select("*", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


#: column -> (remainder 0 of the id modulo this, planted value)
DIRT = {
    "Contract": (17, "Three year"), "Partner": (19, "Maybe"), "gender": (23, None), "PaymentMethod": (41, "Crypto"),
    "OnlineBackup": (13, "Yes"), "MultipleLines": (11, "Yes"), "SeniorCitizen": (29, 2),
}
