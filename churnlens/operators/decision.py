"""Expected-value campaign layer as DataFrame queries.

Input: one scored table (customerID, p, mc, m2m[, y]). ``ve`` is ONE column
computed once; the optimum, the queue curves, the sensitivity grid and the
overlap are independent queries over it.

* The optimum needs no sort: contacting everyone with VE > 0 is optimal, so
  it is a single conditional aggregate (partial aggregation, no shuffle of rows).
* Queue curves stack the customers into 4 (queue, key) rows and run the
  distributed ``ordered_prefix`` partitioned by queue.
* Sensitivity expands each row by the 31-point grid with ``explode`` of a
  literal array (a Generate in the same stage — no join) and aggregates per
  grid point; partial aggregation keeps the shuffle at 31 rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.functions.decision import (
    DEFAULT_GRID,
    PARAM_NAMES,
    BusinessParams,
    customer_threshold,
    expected_value,
    threshold_floor,
)
from churnlens.functions.treat import brl
from churnlens.operators.cuts import Cuts, cuts_before, group_is
from churnlens.operators.ordered import ordered_prefix, stored
from churnlens.operators.ranking import random_key
from churnlens.operators.stats import exact_quantiles

# --- fixed values: queue names -----------------------------------------------
QUEUES = ["expected_value", "churn_probability", "contract_rule", "random"]
# ---------------------------------------------------------------------------


def with_decision(df: DataFrame, params: BusinessParams | None = None, p: str = "p", mc: str = "mc") -> DataFrame:
    """K1 + K3 + K5: ve, per-customer threshold and the selection flag (D4: strict ve > 0)."""
    return (df.withColumn("ve", expected_value(p, mc, params))
              .withColumn("threshold", customer_threshold(mc, params))
              .withColumn("selected", F.col("ve") > 0))


def optimal_campaign(df: DataFrame, params: BusinessParams | None = None, approx: bool = False) -> DataFrame:
    """K4: n, share of base, profit, profit per contact, floor, median threshold (zeros when empty)."""
    d = with_decision(df, params)
    agg = d.agg(
        F.count(F.lit(1)).alias("n_base"),
        F.count_if(F.col("selected")).alias("n_contacted"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("ve"))), F.lit(0.0)).alias("profit"),
    )
    med = exact_quantiles(d.select("threshold"), "threshold", [0.5], approx=approx).select("value").scalar()
    out = agg.withColumn("median_threshold", med)
    return out.select(
        "n_contacted",
        F.coalesce(F.try_divide(F.col("n_contacted"), F.col("n_base")), F.lit(0.0)).alias("share"),
        "profit",
        F.when(F.col("n_contacted") > 0, F.col("profit") / F.col("n_contacted")).otherwise(0.0).alias("profit_per_contact"),
        threshold_floor(params).alias("floor"),
        "median_threshold",
    )


def threshold_summary(df: DataFrame, params: BusinessParams | None = None, approx: bool = False) -> DataFrame:
    """F16: median, min and max of the per-customer threshold."""
    d = with_decision(df, params)
    med = exact_quantiles(d.select("threshold"), "threshold", [0.5], approx=approx).select("value").scalar()
    mm = d.agg(F.min("threshold").alias("threshold_min"), F.max("threshold").alias("threshold_max"))
    return mm.withColumn("threshold_median", med)


def queue_keys(d: DataFrame, seed: int = 42, key: str = S.ID, random: Column | None = None) -> DataFrame:
    """E5: stack each customer into 4 (queue, sort_key) rows; every queue sorts ascending
    on sort_key then id (VE desc, p desc, month-to-month first, md5(seed|id), or a column that holds it)."""
    keys = [
        F.struct(F.lit(QUEUES[0]).alias("queue"), (-F.col("ve")).alias("sort_key")),
        F.struct(F.lit(QUEUES[1]).alias("queue"), (-F.col("p")).alias("sort_key")),
        F.struct(F.lit(QUEUES[2]).alias("queue"), (-F.col("m2m").cast("double")).alias("sort_key")),
        F.struct(F.lit(QUEUES[3]).alias("queue"), (random_key(seed, key) if random is None else random).alias("sort_key")),
    ]
    return d.select(key, "ve", F.explode(F.array(*keys)).alias("_q")).select(key, "ve", "_q.queue", "_q.sort_key")


def queue_curves(df: DataFrame, params: BusinessParams | None = None, seed: int = 42,
                 n_buckets: int | None = None) -> DataFrame:
    """K6: four queues, same VE: (queue, customerID, contacted, cum_profit, marginal_ve)."""
    stacked = queue_keys(with_decision(df, params), seed)
    c = ordered_prefix(stacked, [("sort_key", False)], sums=["ve"], partition=["queue"], tiebreak=S.ID,
                       rn="contacted", n_buckets=n_buckets)
    return c.select("queue", S.ID, "contacted", F.col("cum_ve").alias("cum_profit"), F.col("ve").alias("marginal_ve"))


def profit_at_budget(curves: DataFrame, n: int) -> DataFrame:
    """Profit of each queue at budget n (0 when n = 0)."""
    if n <= 0:
        return curves.select("queue").distinct().withColumn("profit_at_n", F.lit(0.0))
    return curves.filter(F.col("contacted") == n).select("queue", F.col("cum_profit").alias("profit_at_n"))


def grid_rows(params: BusinessParams | None = None, grid: dict | None = None) -> list[tuple]:
    params = params or BusinessParams()
    grid = grid or DEFAULT_GRID
    base = params.as_dict()
    rows = []
    for name, values in grid.items():
        for v in values:
            full = dict(base, **{name: v})
            rows.append((name, float(v), *[float(full[k]) for k in PARAM_NAMES], bool(v == base[name])))
    return rows


def sensitivity(df: DataFrame, params: BusinessParams | None = None, grid: dict | None = None) -> DataFrame:
    """K7 (E4): one-at-a-time sensitivity; per grid point the optimal n, profit, floor, default flag."""
    rows = grid_rows(params, grid)
    lit_rows = [F.struct(F.lit(r[0]).alias("parameter"), F.lit(r[1]).alias("value"),
                         *[F.lit(r[2 + i]).alias(k) for i, k in enumerate(PARAM_NAMES)],
                         F.lit(r[-1]).alias("is_default")) for r in rows]
    g = df.select("p", "mc", F.explode(F.array(*lit_rows)).alias("_g")).select("p", "mc", "_g.*")
    pr = {k: F.col(k) for k in PARAM_NAMES}
    g = g.withColumn("ve", expected_value("p", "mc", pr))
    keys = ["parameter", "value", *PARAM_NAMES, "is_default"]
    agg = g.groupBy(*keys).agg(
        F.count_if(F.col("ve") > 0).alias("n_contacted"),
        F.coalesce(F.sum(F.when(F.col("ve") > 0, F.col("ve"))), F.lit(0.0)).alias("profit"))
    return agg.select("parameter", "value", "n_contacted", "profit",
                      threshold_floor(pr).alias("floor"), "is_default")


def sensitivity_summary(sens: DataFrame) -> DataFrame:
    """per parameter min / max profit and n, amplitude, sorted by amplitude."""
    return sens.groupBy("parameter").agg(
        F.min("profit").alias("profit_min"), F.max("profit").alias("profit_max"),
        F.min("n_contacted").alias("n_min"), F.max("n_contacted").alias("n_max"),
        (F.max("profit") - F.min("profit")).alias("amplitude")).orderBy(F.desc("amplitude"))


def campaign_death(sens: DataFrame, params: BusinessParams | None = None) -> DataFrame:
    """First discount at which the campaign dies, with the theoretical limit
    (discount = margin, where the floor reaches 1)."""
    params = params or BusinessParams()
    d = sens.filter(F.col("parameter") == "discount")
    return d.agg(F.min(F.when(F.col("n_contacted") == 0, F.col("value"))).alias("first_dead_discount")) \
        .withColumn("theoretical_limit", F.lit(float(params.margin)))


def offer_status(sens: DataFrame) -> DataFrame:
    """Per grid point, offer status from the floor: dead (>= 1), high (> 0.6), ok."""
    return sens.withColumn("status", F.when(F.col("floor") >= 1.0, "dead")
                           .when(F.col("floor") > 0.6, "high").otherwise("ok"))


def top_overlap(df: DataFrame, params: BusinessParams | None = None, n: int | None = None) -> DataFrame:
    """Overlap of the top-n by VE and the top-n by p (n = max(optimal n, 1))."""
    d = with_decision(df, params).select(S.ID, "ve", "p", "selected")
    base, best = d.agg(F.count(F.lit(1)), F.count_if("selected")).first()  # VE > 0: exactly the top by VE at the optimum
    n = max(best, 1) if n is None else n

    def top(value: str):
        if n >= base:
            return F.lit(True)
        cuts = Cuts(d, [(value, True), (S.ID, False)])
        return cuts_before(cuts, cuts.at({(): [n]})[()]) == 0

    by_ve = F.col("selected") if n == best else top("ve")
    common = d.agg(F.count_if(by_ve & top("p")).alias("common"))  # rows in both: what INTERSECT of the ids counts
    return common.select(
        F.lit(n).cast("long").alias("cut"), "common", (F.lit(n) - F.col("common")).alias("swapped"),
        (F.col("common") / F.lit(n)).alias("share_common"))


def queue_profits(df: DataFrame, n: int, params: BusinessParams | None = None, seed: int = 42) -> DataFrame:
    """G8 without the curves: profit of each queue's first ``n`` customers. Each queue is cut at one key, and
    customers up to it are added up where they are read. What the queues need of a customer is written once, as
    each pass over the queues would work it out again."""
    d = stored(with_decision(df, params).select(S.ID, "ve", "p", "m2m", random_key(seed).alias("_u")), "queues")
    stacked = queue_keys(d, seed, random=F.col("_u"))
    cuts = Cuts(stacked, [("sort_key", False), (S.ID, False)], ["queue"])
    last = cuts.at({g: [min(n, size)] for g, size in cuts.sizes.items()} if n > 0 else {})
    chosen = F.lit(False)
    for group, keys in last.items():
        chosen = chosen | (group_is(cuts, group) & (cuts_before(cuts, keys) == 0))
    return stacked.groupBy("queue").agg(F.coalesce(F.sum(F.when(chosen, F.col("ve"))), F.lit(0.0)).alias("profit_at_n"))


# --- fixed values: the business sentence, in the reference's wording (pt) and in English
SENTENCES = {
    "pt": ("Com estes parâmetros a campanha não se paga para nenhum cliente: o desconto ofertado exige "
           "probabilidade de churn acima de %s%%, e o desenho da oferta precisa mudar antes do modelo.",
           "Contatando os %d clientes de maior valor esperado (%s%% da base), a campanha rende R$ %s de lucro "
           "esperado — contra R$ %s da regra de contrato no mesmo orçamento."),
    "en": ("With these parameters the campaign pays off for no customer: the offer needs a churn probability "
           "above %s%%, and the offer design must change before the model.",
           "Contacting the %d customers of highest expected value (%s%% of the base), the campaign yields "
           "R$ %s of expected profit, against R$ %s for the contract rule on the same budget."),
}
# ---------------------------------------------------------------------------


def business_sentence(opt: DataFrame, curves: DataFrame, n_base: int, lang: str = "pt") -> DataFrame:
    """K8: the result in one sentence; another sentence when nobody pays off. ``curves``: the queue curves, or
    the profits at the optimal n (``queue_profits``)."""
    dead, alive = SENTENCES[lang]
    row = opt.first()
    n = int(row["n_contacted"])
    if n == 0:
        return opt.select(F.format_string(dead, F.format_number(F.col("floor") * 100, 0)).alias("sentence"))
    at_n = curves if "profit_at_n" in curves.columns else profit_at_budget(curves, n)
    contract = at_n.filter(F.col("queue") == "contract_rule")
    j = opt.select("n_contacted", "profit", contract.select("profit_at_n").scalar().alias("profit_at_n"))
    return j.select(F.format_string(
        alive, F.col("n_contacted"), F.format_number(F.col("n_contacted") * 100.0 / n_base, 0),
        brl(F.col("profit")), brl(F.col("profit_at_n"))).alias("sentence"))


def contact_list(df: DataFrame, params: BusinessParams | None = None, n: int | None = None) -> DataFrame:
    """K10 (G5, C6, C12): the ``n`` customers of highest VE (by default everyone with VE > 0, which is
    the top at the optimal n), by VE and then id, with the place in that order as ``position``, the
    contract translated and Portuguese captions."""
    d = with_decision(df, params)
    d = ordered_prefix(d if n is not None else d.filter("selected"), [("ve", True)], tiebreak=S.ID, rn="position")
    d = (d if n is None else d.filter(F.col("position") <= n)).orderBy("position")
    label = F.create_map(*[x for k, v in S.VALUES_PT["Contract"].items() for x in (F.lit(k), F.lit(v))])
    return d.select(
        "position", F.col(S.ID),
        F.coalesce(label[F.col("Contract")], F.col("Contract")).alias("Contrato"),
        F.col("tenure").alias("Tempo de casa"), F.col("mc").alias("Mensalidade"),
        F.col("p").alias("P(churn)"), F.col("ve").alias("Valor esperado"))


def decision_per_customer(df: DataFrame, params: BusinessParams | None = None) -> DataFrame:
    """P, threshold, VE, contact yes/no and slack p − threshold for every customer."""
    d = with_decision(df, params)
    return d.select(S.ID, "p", "mc", "threshold", "ve", "selected",
                    (F.col("p") - F.col("threshold")).alias("slack"))


def optimum_check(curves: DataFrame) -> DataFrame:
    """On the VE queue the running profit peaks at the last positive VE."""
    v = curves.filter(F.col("queue") == "expected_value")
    return v.agg(F.max_by("contacted", F.struct("cum_profit", -F.col("contacted"))).alias("argmax_contacted"),
                 F.count_if(F.col("marginal_ve") > 0).alias("n_positive"))
