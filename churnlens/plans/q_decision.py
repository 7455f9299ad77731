"""Registered queries: expected-value decision layer (K, E4-E7, F15-F16, F20, G5-G10, C6, C10-C12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions import treat as TR
from churnlens.operators import decision as K
from churnlens.operators import explore as X
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_scored, s_treated
from churnlens.plans.q_metrics import SC

VE_SQL = "((0.4::double * mc) * 12.0::double) * ((p * 0.3::double) - 0.1::double) - 15.0::double"
THR_SQL = ("0.1::double / 0.3::double + 15.0::double / "
           "(((0.4::double * 0.3::double) * mc) * 12.0::double)")
D = SC + f"""
, d AS (SELECT sc.*, {VE_SQL} AS ve, {THR_SQL} AS threshold FROM sc)"""


def r(c, k=6):
    return F.round(c, k).alias(c)


@register("decision_per_customer", with_s(D + """
SELECT customerID, p, mc, round(threshold, 6) AS threshold, round(ve, 6) AS ve, ve > 0 AS selected,
       round(p - threshold, 6) AS slack, round(0.1::double / 0.3::double, 6) AS floor FROM d"""))
def decision_per_customer(spark, sf):
    """VE, per-customer threshold, contact flag, slack, floor."""
    d = K.decision_per_customer(s_scored(spark, sf))
    from churnlens.functions.decision import threshold_floor
    return d.select("customerID", "p", "mc", r("threshold"), r("ve"), "selected", r("slack"),
                    F.round(threshold_floor(), 6).alias("floor"))


@register("optimal_campaign", with_s(D + """
SELECT count(*) FILTER (WHERE ve > 0) AS n_contacted,
       round(count(*) FILTER (WHERE ve > 0) / count(*), 6) AS share,
       round(coalesce(sum(ve) FILTER (WHERE ve > 0), 0.0), 4) AS profit,
       round(CASE WHEN count(*) FILTER (WHERE ve > 0) > 0
                  THEN sum(ve) FILTER (WHERE ve > 0) / count(*) FILTER (WHERE ve > 0) ELSE 0.0 END, 4) AS profit_per_contact,
       round(0.1::double / 0.3::double, 6) AS floor,
       round(quantile_cont(threshold, 0.5), 6) AS median_threshold
FROM d"""))
def optimal_campaign(spark, sf):
    """K4 (K2): optimal campaign — everyone with VE > 0."""
    o = K.optimal_campaign(s_scored(spark, sf))
    return o.select("n_contacted", r("share"), r("profit", 4), r("profit_per_contact", 4), r("floor"),
                    r("median_threshold"))


@register("threshold_summary", with_s(D + """
SELECT round(min(threshold), 6) AS threshold_min, round(max(threshold), 6) AS threshold_max,
       round(quantile_cont(threshold, 0.5), 6) AS threshold_median FROM d"""))
def threshold_summary(spark, sf):
    """F16: median / min / max of the per-customer threshold."""
    t = K.threshold_summary(s_scored(spark, sf))
    return t.select(r("threshold_min"), r("threshold_max"), r("threshold_median"))


Q = D + """
, q AS (
  SELECT 'expected_value' AS queue, customerID, ve, -ve AS k FROM d
  UNION ALL SELECT 'churn_probability', customerID, ve, -p FROM d
  UNION ALL SELECT 'contract_rule', customerID, ve, -(m2m::double) FROM d
  UNION ALL SELECT 'random', customerID, ve,
    cast(concat('0x', substr(md5(concat('42', '|', customerID)), 1, 8)) AS bigint) / 4294967296.0::double FROM d),
cv AS (SELECT queue, customerID, row_number() OVER w AS contacted,
              sum(ve) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_profit, ve AS marginal_ve
       FROM q WINDOW w AS (PARTITION BY queue ORDER BY k, customerID)),
opt AS (SELECT count(*) FILTER (WHERE ve > 0) AS n FROM d)"""


@register("queue_curves", with_s(Q + """
SELECT queue, customerID, contacted, round(cum_profit, 4) AS cum_profit, round(marginal_ve, 6) AS marginal_ve FROM cv"""))
def queue_curves(spark, sf):
    """Campaign curves of the four contact queues."""
    c = K.queue_curves(s_scored(spark, sf))
    return c.select("queue", "customerID", "contacted", r("cum_profit", 4), r("marginal_ve"))


@register("profit_at_optimal_budget", with_s(Q + """
SELECT queue, round(cum_profit, 4) AS profit_at_n FROM cv, opt WHERE contacted = n"""))
def profit_at_optimal_budget(spark, sf):
    """Profit of each queue at the optimal budget n."""
    sc = s_scored(spark, sf)
    n = K.optimal_campaign(sc).first()["n_contacted"]
    return K.queue_profits(sc, n).select("queue", r("profit_at_n", 4))


@register("optimum_check", with_s(Q + """
SELECT arg_max(contacted, (cum_profit, -contacted)) AS argmax_contacted,
       count(*) FILTER (WHERE marginal_ve > 0) AS n_positive FROM cv WHERE queue = 'expected_value'"""))
def optimum_check(spark, sf):
    """The VE queue's running profit peaks at the last positive VE."""
    return K.optimum_check(K.queue_curves(s_scored(spark, sf)))


def _grid_values_sql() -> str:
    rows = K.grid_rows()
    return ",\n  ".join(
        f"('{p}', {v!r}::double, {m!r}::double, {d!r}::double, {a!r}::double, {h!r}::double, {c!r}::double, {str(df).lower()})"
        for p, v, m, d, a, h, c, df in rows)


SENS = SC + f"""
, gr(parameter, value, margin, discount, acceptance, horizon, contact_cost, is_default) AS (VALUES
  {_grid_values_sql()}),
gv AS (SELECT gr.*, ((acceptance * mc) * horizon) * ((p * margin) - discount) - contact_cost AS ve FROM sc, gr),
sens AS (SELECT parameter, value, count(*) FILTER (WHERE ve > 0) AS n_contacted,
                coalesce(sum(ve) FILTER (WHERE ve > 0), 0.0) AS profit, discount / margin AS floor, is_default
         FROM gv GROUP BY parameter, value, margin, discount, acceptance, horizon, contact_cost, is_default)"""


def _sens(spark, sf):
    return K.sensitivity(s_scored(spark, sf))


@register("sensitivity", with_s(SENS + """
SELECT parameter, value, n_contacted, round(profit, 4) AS profit, round(floor, 6) AS floor, is_default FROM sens"""))
def sensitivity(spark, sf):
    """One-at-a-time sensitivity over the 31-point grid."""
    return _sens(spark, sf).select("parameter", "value", "n_contacted", r("profit", 4), r("floor"), "is_default")


@register("sensitivity_summary", with_s(SENS + """
SELECT parameter, round(min(profit), 4) AS profit_min, round(max(profit), 4) AS profit_max,
       min(n_contacted) AS n_min, max(n_contacted) AS n_max, round(max(profit) - min(profit), 4) AS amplitude
FROM sens GROUP BY parameter"""))
def sensitivity_summary(spark, sf):
    """amplitude of profit per parameter."""
    s = K.sensitivity_summary(_sens(spark, sf))
    return s.select("parameter", r("profit_min", 4), r("profit_max", 4), "n_min", "n_max", r("amplitude", 4))


@register("campaign_death", with_s(SENS + """
SELECT min(value) FILTER (WHERE n_contacted = 0) AS first_dead_discount, 0.3::double AS theoretical_limit
FROM sens WHERE parameter = 'discount'"""))
def campaign_death(spark, sf):
    """First discount at which the campaign dies; theoretical limit."""
    return K.campaign_death(_sens(spark, sf))


@register("offer_status", with_s(SENS + """
SELECT parameter, value, round(floor, 6) AS floor,
       CASE WHEN floor >= 1.0 THEN 'dead' WHEN floor > 0.6 THEN 'high' ELSE 'ok' END AS status FROM sens"""))
def offer_status(spark, sf):
    """Offer status per grid point."""
    s = K.offer_status(_sens(spark, sf))
    return s.select("parameter", "value", r("floor"), "status")


@register("top_overlap", with_s(D + """
, opt AS (SELECT greatest(count(*) FILTER (WHERE ve > 0), 1) AS cut FROM d),
a AS (SELECT customerID FROM (SELECT customerID, row_number() OVER (ORDER BY ve DESC, customerID) AS rk FROM d), opt
      WHERE rk <= cut),
b AS (SELECT customerID FROM (SELECT customerID, row_number() OVER (ORDER BY p DESC, customerID) AS rk FROM d), opt
      WHERE rk <= cut),
c AS (SELECT count(*) AS common FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
SELECT cut::bigint AS cut, common, cut - common AS swapped, round(common / cut, 6) AS share_common FROM c, opt"""))
def top_overlap(spark, sf):
    """Top-n by VE vs top-n by p — common, swapped, share (INTERSECT)."""
    o = K.top_overlap(s_scored(spark, sf))
    return o.select("cut", "common", F.col("swapped").cast("bigint").alias("swapped"), r("share_common"))


@register("business_sentence", with_s(D + """
, opt AS (SELECT count(*) FILTER (WHERE ve > 0) AS n, coalesce(sum(ve) FILTER (WHERE ve > 0), 0.0) AS profit,
                 count(*) AS nb FROM d),
cr AS (SELECT row_number() OVER w AS rk, sum(ve) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM d
       WINDOW w AS (ORDER BY -(m2m::double), customerID))
SELECT CASE WHEN n = 0 THEN printf('Com estes parâmetros a campanha não se paga para nenhum cliente: o desconto ofertado exige probabilidade de churn acima de %s%%, e o desenho da oferta precisa mudar antes do modelo.', format('{:,.0f}', 0.1::double / 0.3::double * 100))
  ELSE printf('Contatando os %d clientes de maior valor esperado (%s%% da base), a campanha rende R$ %s de lucro esperado — contra R$ %s da regra de contrato no mesmo orçamento.',
              n, format('{:,.0f}', n * 100.0 / nb), translate(format('{:,.0f}', profit), ',.', '.,'),
              translate(format('{:,.0f}', cum), ',.', '.,')) END AS sentence
FROM opt LEFT JOIN cr ON cr.rk = opt.n"""))
def business_sentence(spark, sf):
    """K8: the decision as one sentence (C11 money format)."""
    sc = s_scored(spark, sf)
    opt = K.optimal_campaign(sc)
    n_base = sc.count()
    return K.business_sentence(opt, K.queue_profits(sc, opt.first()["n_contacted"]), n_base)


@register("contact_list", with_s(D + """
SELECT row_number() OVER (ORDER BY ve DESC, customerID) AS "position", customerID,
  CASE Contract WHEN 'Month-to-month' THEN 'Mês a mês' WHEN 'One year' THEN 'Um ano' WHEN 'Two year' THEN 'Dois anos'
       ELSE Contract END AS "Contrato",
  tenure AS "Tempo de casa", mc AS "Mensalidade", p AS "P(churn)", round(ve, 6) AS "Valor esperado"
FROM d WHERE ve > 0"""))
def contact_list(spark, sf):
    """The contact list (top-n by VE at the optimal n)."""
    c = K.contact_list(s_scored(spark, sf))
    return c.withColumn("Valor esperado", F.round("Valor esperado", 6))


@register("money_text", with_s(D + """
SELECT customerID, translate(format('{:,.2f}', ve), ',.', '.,') AS ve_text,
       'R$ ' || translate(format('{:,.0f}', mc * 1000), ',.', '.,') AS yearly_text FROM d"""))
def money_text(spark, sf):
    """C11: Brazilian money text (signed, 2 and 0 decimals)."""
    d = K.with_decision(s_scored(spark, sf))
    return d.select("customerID", TR.brl(F.col("ve"), 2).alias("ve_text"),
                    TR.brl(F.col("mc") * 1000, 0, prefix=True).alias("yearly_text"))


_FEAS = ["MultipleLines", *S.ADDONS]


@register("feasibility_violations", with_s(" UNION ALL ".join(
    ["SELECT 'MultipleLines' AS \"column\", count(*) FILTER (WHERE PhoneService = 0 AND MultipleLines <> 0) AS n_violations FROM t"]
    + [f"SELECT '{c}', count(*) FILTER (WHERE InternetService = 'No' AND {c} <> 0) FROM t" for c in S.ADDONS])))
def feasibility_violations(spark, sf):
    """Rows the feasibility rule (no phone ⇒ no lines, no internet ⇒ no add-ons) would change."""
    return TR.feasibility_violations(s_treated(spark, sf))


_SEG = ["Contract", "InternetService", "PaymentMethod", "TechSupport", "OnlineSecurity", "SeniorCitizen",
        "Dependents", "Partner", "PaperlessBilling"]
_SEG_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::varchar AS value, Churn FROM t" for c in _SEG)
_LAB_ROWS = ", ".join(f"('{c}', '{v}', '{lab}')" for c, m in S.VALUES_PT.items() for v, lab in m.items())
_CAP_ROWS = ", ".join(f"('{c}', '{lab}')" for c, lab in S.LABELS_PT.items())


@register("segments_pt", with_s(f"""
, lab(col, value, label) AS (VALUES {_LAB_ROWS}),
cap(col, caption) AS (VALUES {_CAP_ROWS}),
st AS ({_SEG_UNPIVOT}),
g AS (SELECT col, value, count(*) AS customers, avg(Churn::double) AS churn_rate FROM st GROUP BY col, value),
bin AS (SELECT col, bool_and(value IN ('0', '1')) AS is_bin FROM g GROUP BY col)
SELECT coalesce(cap.caption, g.col) AS "column",
       coalesce(lab.label, CASE WHEN bin.is_bin AND g.value = '1' THEN 'Sim' WHEN bin.is_bin AND g.value = '0' THEN 'Não' END, g.value) AS value_label,
       customers, round(churn_rate, 6) AS churn_rate
FROM g JOIN bin USING (col) LEFT JOIN lab ON lab.col = g.col AND lab.value = g.value LEFT JOIN cap ON cap.col = g.col"""))
def segments_pt(spark, sf):
    """M4 segment tab / C6 / D6: churn by category with Portuguese captions and values."""
    t = s_treated(spark, sf)
    binary = {r["column"] for r in X.all_binary(t, _SEG).collect() if r["is_binary"]}  # one row per column
    st = t.select(*[F.col(c).cast("string").alias(c) for c in _SEG], "Churn").unpivot(
        ["Churn"], _SEG, "column", "value")
    g = st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("customers"),
                                          F.avg(F.col("Churn").cast("double")).alias("churn_rate"))
    g = g.withColumn("value", F.when(F.col("column").isin(*binary) | ~F.col("value").isin("0", "1"), F.col("value"))
                     .otherwise(F.concat(F.lit("#"), F.col("value"))))
    tr = TR.translate_values(g, _SEG).withColumn(
        "value_label", F.when(F.col("value").startswith("#"), F.substring("value", 2, 1000)).otherwise(F.col("value_label")))
    return tr.select(TR.column_caption("column").alias("column"), "value_label", "customers", r("churn_rate"))
