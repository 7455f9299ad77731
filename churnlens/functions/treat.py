"""Row-local column expressions of the treatment.

All of these are pure functions of one row, so treatment may run before the
train/test split without leaking, and Catalyst fuses them into the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import schema as S


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def yes_no(c: str | Column) -> Column:
    """C2: 'Yes' -> 1, 'No' -> 0, anything else -> null (a CASE without ELSE, like a dict map)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "Yes", 1).when(col == "No", 0)


def male_female(c: str | Column) -> Column:
    """C2: 'Male' -> 1, 'Female' -> 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "Male", 1).when(col == "Female", 0)


def folded_yes_no(c: str, no_value: str) -> Column:
    """Fold a 'No <service>' category into 'No', then map to 1/0."""
    col = F.col(c)
    return F.when(col == "Yes", 1).when(col.isin("No", no_value), 0)


def coerce_number(c: str | Column, fill: float = 0.0) -> Column:
    """Coercing numeric parse: text that is no decimal number (a blank, "nan", "12D") becomes ``fill``.

    The form is checked first, as a cast also takes Java's literals; ANSI mode makes a plain cast
    throw, so use ``try_cast`` on the trimmed text.
    """
    col = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.when(col.rlike(NUMBER), col.try_cast("double")), F.lit(fill))


def treated_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> list[Column]:
    """The whole treatment as one projection. ``customerID`` stays as the key."""
    out: list[Column] = [F.col(S.ID)]
    for name in S.RAW_COLUMNS:
        if name == S.ID:
            continue
        if name in S.BINARY_YES_NO:
            out.append(yes_no(name).alias(name))
        elif name == "gender":
            out.append(male_female(name).alias(name))
        elif name in S.ADDONS:
            out.append(folded_yes_no(name, S.NO_INTERNET).alias(name))
        elif name == "MultipleLines":
            out.append(folded_yes_no(name, S.NO_PHONE).alias(name))
        elif name == "TotalCharges":
            out.append(coerce_number(name).alias(name))
        else:
            out.append(F.col(name))
    out.extend(F.col(k) for k in keep)
    return out


def treat(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply the treatment to a raw subscriber DataFrame (pure, lazy)."""
    extra = tuple(k for k in keep if k in df.columns)
    return df.select(*treated_columns(df, extra))


def derived_total(tenure: str = "tenure", monthly: str = "MonthlyCharges") -> Column:
    """Derived total = round-half-even(tenure × monthly, 2)."""
    return F.bround(F.col(tenure) * F.col(monthly), 2)


def total_residual(total: str = "TotalCharges", tenure: str = "tenure", monthly: str = "MonthlyCharges") -> Column:
    """Residual of the billed total against tenure × monthly."""
    return F.col(total) - F.col(tenure) * F.col(monthly)


def addon_count(cols: list[str] | None = None) -> Column:
    """Row-wise count of contracted add-ons (0/1 columns)."""
    cols = cols or S.ADDONS
    expr = F.lit(0)
    for c in cols:
        expr = expr + F.coalesce(F.col(c), F.lit(0))
    return expr


def brl(x: Column | str, decimals: int = 0, prefix: bool = False) -> Column:
    """C11: Brazilian money text — dot thousands, comma decimals, sign kept."""
    col = F.col(x) if isinstance(x, str) else x
    text = F.translate(F.format_number(col, decimals), ",.", ".,")
    return F.concat(F.lit("R$ "), text) if prefix else text


def enforce_feasible(df: DataFrame) -> DataFrame:
    """No phone ⇒ MultipleLines 0; no internet ⇒ the six add-ons 0 (treated 0/1 table)."""
    fixed = {"MultipleLines": F.when(F.col("PhoneService") == 0, F.lit(0)).otherwise(F.col("MultipleLines"))}
    for c in S.ADDONS:
        fixed[c] = F.when(F.col("InternetService") == "No", F.lit(0)).otherwise(F.col(c))
    return df.withColumns(fixed)


def feasibility_violations(df: DataFrame) -> DataFrame:
    """Per column, the number of rows the feasibility rule would change (one pass)."""
    conds = {"MultipleLines": (F.col("PhoneService") == 0) & (F.col("MultipleLines") != 0)}
    for c in S.ADDONS:
        conds[c] = (F.col("InternetService") == "No") & (F.col(c) != 0)
    row = df.agg(*[F.count_if(v).alias(k) for k, v in conds.items()])
    return row.unpivot([], list(conds), "column", "n_violations")


def label_table(spark) -> DataFrame:
    """(column, value, label) display captions for the dictionary-translated columns."""
    rows = [(c, v, lab) for c, m in S.VALUES_PT.items() for v, lab in m.items()]
    return spark.createDataFrame(rows, "column string, value string, label string")


def translate_values(df: DataFrame, cols: list[str], value: str = "value", column: str = "column") -> DataFrame:
    """Translate (column, value) pairs for display: dictionary captions via a broadcast
    join on a fixed lookup table; 0/1 columns become Sim/Não; else the value itself."""
    lab = F.broadcast(label_table(df.sparkSession))
    j = df.join(lab, [column, value], "left")
    yes_no = F.when(F.col(value) == "1", S.BOOL_PT[1]).when(F.col(value) == "0", S.BOOL_PT[0])
    return j.withColumn("value_label", F.coalesce(F.col("label"), yes_no, F.col(value))).drop("label")


def column_caption(column: str = "column") -> Column:
    """Portuguese caption of a column name (fixed map, falls back to the name)."""
    m = F.create_map(*[x for k, v in S.LABELS_PT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(column)], F.col(column))
