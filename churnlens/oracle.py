"""DuckDB SQL twins of the fixtures, used by ``oracle_sql()`` and the tests.

Every oracle query is ``WITH <fixture CTEs> <query>``; the CTE text below must
compute exactly what ``churnlens.sources.fixtures`` computes in Spark.
"""

from __future__ import annotations

from churnlens.sources.fixtures import ADDON_TAGS, BASE_KEYS, DIRT, U_TAGS


def _u(tag: str) -> str:
    return (f"cast(concat('0x', substr(md5(concat('{tag}', '|', k)), 1, 8)) as bigint)"
            f" / 4294967296.0::double AS u_{tag}")


def s_ctes(base: str = "customer") -> str:
    """CTEs ``s_u``, ``s1``, ``s`` (22 columns: 21 raw + p_score)."""
    key = BASE_KEYS[base]
    us = ",\n    ".join(_u(t) for t in U_TAGS)
    addons = ",\n    ".join(
        f"CASE WHEN InternetService = 'No' THEN 'No internet service' "
        f"WHEN u_{tag} < {cut} THEN 'Yes' ELSE 'No' END AS {col}"
        for col, (tag, cut) in ADDON_TAGS.items()
    )
    return f"""s_u AS (
  SELECT {key} AS k,
    {us}
  FROM {base}
),
s1 AS (
  SELECT *,
    cast(floor(u_ten * 73) as integer) AS tenure,
    CASE WHEN u_net < 0.34 THEN 'DSL' WHEN u_net < 0.78 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
    CASE WHEN u_con < 0.55 THEN 'Month-to-month' WHEN u_con < 0.76 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN u_pho < 0.90 THEN 'Yes' ELSE 'No' END AS PhoneService
  FROM s_u
),
s2 AS (
  SELECT *,
    round(CASE WHEN InternetService = 'No' THEN 18.25::double + 8.0::double * u_mc
               WHEN InternetService = 'DSL' THEN 45.0::double + 30.0::double * u_mc
               ELSE 70.0::double + 48.0::double * u_mc END, 2) AS MonthlyCharges
  FROM s1
),
s AS (
  SELECT
    cast(k as varchar) AS customerID,
    CASE WHEN u_gen < 0.505 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN u_sen < 0.16 THEN 1 ELSE 0 END AS SeniorCitizen,
    CASE WHEN u_par < 0.48 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN u_dep < 0.30 THEN 'Yes' ELSE 'No' END AS Dependents,
    tenure,
    PhoneService,
    CASE WHEN PhoneService = 'No' THEN 'No phone service' WHEN u_ml < 0.47 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    InternetService,
    {addons},
    Contract,
    CASE WHEN u_pap < 0.59 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE WHEN u_pay < 0.34 THEN 'Electronic check' WHEN u_pay < 0.57 THEN 'Mailed check'
         WHEN u_pay < 0.79 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
    MonthlyCharges,
    CASE WHEN tenure = 0 THEN ' '
         ELSE cast(cast(round(tenure * MonthlyCharges + (u_res - 0.5::double) * 57.0::double, 2) as decimal(12,2)) as varchar)
    END AS TotalCharges,
    CASE WHEN u_ch < (CASE WHEN Contract = 'Month-to-month' THEN 0.40::double WHEN Contract = 'One year' THEN 0.12::double ELSE 0.04::double END)
                   + (CASE WHEN InternetService = 'Fiber optic' THEN 0.15::double WHEN InternetService = 'No' THEN -0.03::double ELSE 0.0::double END)
                   + (CASE WHEN tenure <= 12 THEN 0.15::double ELSE -0.05::double END)
         THEN 'Yes' ELSE 'No' END AS Churn,
    round(1.0::double / (1.0::double + exp(-(
        -2.2::double
        + (CASE WHEN Contract = 'Month-to-month' THEN 1.6::double WHEN Contract = 'One year' THEN 0.2::double ELSE -0.9::double END)
        + (CASE WHEN InternetService = 'Fiber optic' THEN 0.7::double WHEN InternetService = 'No' THEN -0.2::double ELSE 0.0::double END)
        - 0.02::double * tenure
        + (CASE WHEN tenure <= 12 THEN 0.4::double ELSE 0.0::double END)))), 6) AS p_score
  FROM s2
)"""


# treated S (C5): id kept as key, 0/1 ints, TotalCharges coerced
T_CTE = """t AS (
  SELECT customerID,
    CASE gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS gender,
    SeniorCitizen,
    CASE Partner WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS Partner,
    CASE Dependents WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS Dependents,
    tenure,
    CASE PhoneService WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS PhoneService,
    CASE WHEN MultipleLines = 'Yes' THEN 1 WHEN MultipleLines IN ('No', 'No phone service') THEN 0 END AS MultipleLines,
    InternetService,
    CASE WHEN OnlineSecurity = 'Yes' THEN 1 WHEN OnlineSecurity IN ('No', 'No internet service') THEN 0 END AS OnlineSecurity,
    CASE WHEN OnlineBackup = 'Yes' THEN 1 WHEN OnlineBackup IN ('No', 'No internet service') THEN 0 END AS OnlineBackup,
    CASE WHEN DeviceProtection = 'Yes' THEN 1 WHEN DeviceProtection IN ('No', 'No internet service') THEN 0 END AS DeviceProtection,
    CASE WHEN TechSupport = 'Yes' THEN 1 WHEN TechSupport IN ('No', 'No internet service') THEN 0 END AS TechSupport,
    CASE WHEN StreamingTV = 'Yes' THEN 1 WHEN StreamingTV IN ('No', 'No internet service') THEN 0 END AS StreamingTV,
    CASE WHEN StreamingMovies = 'Yes' THEN 1 WHEN StreamingMovies IN ('No', 'No internet service') THEN 0 END AS StreamingMovies,
    Contract,
    CASE PaperlessBilling WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS PaperlessBilling,
    PaymentMethod,
    MonthlyCharges,
    coalesce(try_cast(trim(TotalCharges) as double), 0.0) AS TotalCharges,
    CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS Churn,
    p_score
  FROM s
)"""


R_CTE = """r_o AS (
  SELECT o_custkey, o_totalprice, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders
),
r_a AS (
  SELECT o_custkey, o_totalprice, (SELECT max(m) FROM r_o) - m AS age FROM r_o
),
r_c AS (
  SELECT o_custkey,
    count(CASE WHEN age >= 12 THEN 1 END) AS n_pre,
    sum(CASE WHEN age >= 12 THEN cast(round(o_totalprice * 100) AS bigint) END) AS cents_pre,
    max(age) AS max_age,
    count(CASE WHEN age < 12 THEN 1 END) AS n_post
  FROM r_a GROUP BY o_custkey HAVING count(CASE WHEN age >= 12 THEN 1 END) >= 1
),
r AS (
  SELECT cast(o_custkey as varchar) AS customerID,
    cast(max_age - 12 as integer) AS tenure,
    ((2 * cents_pre + 2000) // 4000) / 100.0::double AS TotalCharges,
    ((2 * cents_pre + n_pre * 2000) // (2 * n_pre * 2000)) / 100.0::double AS MonthlyCharges,
    CASE WHEN n_pre <= 6 THEN 'Month-to-month' WHEN n_pre <= 10 THEN 'One year' ELSE 'Two year' END AS Contract,
    c_mktsegment AS segment,
    cast(n_regionkey as integer) AS region,
    CASE WHEN n_post = 0 THEN 1 ELSE 0 END AS Churn
  FROM r_c JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def with_s(body: str, treated: bool = True, base: str = "customer") -> str:
    ctes = s_ctes(base)
    if treated:
        ctes += ",\n" + T_CTE
    return f"WITH {ctes}\n{body}"


def with_r(body: str) -> str:
    return f"WITH {R_CTE}\n{body}"


def _planted(column: str, modulus: int, value) -> str:
    text = "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)
    return f"CASE WHEN cast(customerID AS bigint) % {modulus} = 0 THEN {text} ELSE {column} END AS {column}"


# D: S with planted faults, and its treatment
D_CTE = ("d0 AS (SELECT * EXCLUDE (p_score) REPLACE (" + ", ".join(_planted(c, *x) for c, x in DIRT.items()) + ") FROM s),\n"
         "d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE cast(customerID AS bigint) % 37 = 0)")
TD_CTE = T_CTE.replace("t AS (", "td AS (", 1).replace("FROM s", "FROM d").replace("AS Churn,\n    p_score", "AS Churn")


def with_d(sql: str) -> str:
    """A query over D (``d``) and treated D (``td``)."""
    return with_s(f", {D_CTE}, {TD_CTE}\n{sql}", treated=False)
