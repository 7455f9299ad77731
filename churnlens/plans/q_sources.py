"""Registered queries: sources (A1, A2) — the raw table goes through a real CSV round trip."""

from __future__ import annotations

from churnlens import schema as S
from churnlens.models.evaluation import scratch_path
from churnlens.oracle import with_s
from churnlens.plans.catalog import register
from churnlens.plans.inputs import s_raw
from churnlens.sources import raw as RAW


def _csv(spark, sf):
    path = scratch_path(spark, "raw-csv")
    RAW.write_raw_csv(s_raw(spark, sf).select(*S.RAW_COLUMNS), path)
    return path


@register("raw_csv_roundtrip", with_s("SELECT * EXCLUDE (p_score) FROM s", treated=False))
def raw_csv_roundtrip(spark, sf):
    """A1: raw subscribers written as header CSV and read back with the declared schema."""
    return RAW.read_raw_csv(spark, _csv(spark, sf))


@register("load_treated_from_csv", with_s("SELECT * EXCLUDE (p_score) FROM t"))
def load_treated_from_csv(spark, sf):
    """A2: CSV → schema/domain validation → treatment → 0/1 contract validation."""
    return RAW.load_treated(spark, _csv(spark, sf))
