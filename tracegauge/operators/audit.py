"""Agreement of a human audit with recorded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import beside, ratio


def filled(sheet: DataFrame) -> DataFrame:
    return sheet.where(F.col("auditor_label") != "")


def audit_join(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """Filled rows beside their key; a row without a key stays, with no label."""
    return filled(sheet).join(
        key.select("trace_id", "label", "fault_type", "template_family", "audit_stratum", F.col("in_sample").alias("key_in_sample")),
        "trace_id",
        "left",
    )


def corrections(joined: DataFrame) -> DataFrame:
    return joined.where(F.col("label").isNotNull() & (F.col("auditor_label") != F.col("label"))).select(
        "trace_id", "template_family", F.col("label").alias("construction_label"),
        F.col("fault_type").alias("construction_fault_type"), "auditor_label", "auditor_fault_type", "auditor_note", "auditor_id",
    )


def audit_agreement(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """One row: counts, coverage and agreement. Rows without a key stay in the denominator."""
    joined = audit_join(sheet, key)
    hit = F.col("label") == F.col("auditor_label")
    n = lambda cond: F.count(F.when(cond, 1))
    totals = joined.agg(
        F.count(F.lit(1)).alias("n_audited"),
        n(hit).alias("n_agree"),
        n(F.col("label").isNull()).alias("n_without_key"),
        n(F.col("label").isNotNull() & ~hit).alias("n_corrections"),
        F.count_distinct(F.when(F.col("auditor_id") != "", F.col("auditor_id"))).alias("n_auditors"),
    )
    ids = joined.where(F.col("key_in_sample") == "TRUE").select("trace_id").distinct().agg(
        F.count(F.lit(1)).alias("n_sample_audited")
    )
    sizes = key.agg(F.count(F.lit(1)).alias("n_records"), n(F.col("in_sample") == "TRUE").alias("n_sample"))
    row = beside(totals, sizes, ids)
    return row.withColumns(
        {
            "coverage": ratio(F.col("n_audited"), F.col("n_records")),
            "sample_coverage": ratio(F.col("n_sample_audited"), F.col("n_sample")),
            "agreement": ratio(F.col("n_agree"), F.col("n_audited")),
        }
    )


def audit_strata(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """Per sampled stratum: sampled, audited; a stratum nobody audited shows 0."""
    sampled = key.where(F.col("in_sample") == "TRUE")
    done = filled(sheet).select("trace_id", F.lit(1).alias("done")).distinct()
    return sampled.join(done, "trace_id", "left").groupBy("audit_stratum").agg(
        F.count(F.lit(1)).alias("sampled"), F.count("done").alias("audited")
    )


def audit_status(sheet: DataFrame | None, spark=None) -> DataFrame:
    """sheet_missing, not_performed, partial or performed, with the counts behind it."""
    if sheet is None:
        return spark.createDataFrame([("sheet_missing", 0, 0)], "status string, filled bigint, in_sample bigint")
    counts = sheet.agg(
        F.count(F.when(F.col("auditor_label") != "", 1)).alias("filled"),
        F.count(F.when(F.upper("in_sample").isin("TRUE", "1", "YES"), 1)).alias("in_sample"),
    )
    status = (
        F.when(F.col("filled") == 0, "not_performed").when(F.col("filled") < F.col("in_sample"), "partial").otherwise("performed")
    )
    return counts.select(status.alias("status"), "filled", "in_sample")
