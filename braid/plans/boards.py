"""Market boards: one row per trial, and one row per trial and country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.functions import scalars as S
from braid.operators.ranking import quantile_cont
from braid.plans.semantic import n_distinct, n_regions, v_geography
from braid.session import settle


def v_burden(chunks: DataFrame) -> DataFrame:
    """Criteria a patient must be checked against, per trial."""
    section = F.col("criterion_section")
    return chunks.groupBy("nct_id").agg(
        F.count(F.lit(1)).alias("n_criteria"),
        F.count_if(section == "EXCLUSION").alias("n_exclusion"),
        F.count_if(section == "INCLUSION").alias("n_inclusion"),
    )


def v_enrol(trials: DataFrame, q: float = 0.99) -> DataFrame:
    """Enrolment capped at its exact quantile, the raw value beside it."""
    # The passes of the quantile read written values, not the joins behind them.
    held = settle(trials.select("nct_id", "enrollment"), "enrol")
    limit = F.lit(quantile_cont(held, "enrollment", q)).cast("double")
    return held.select(
        "nct_id",
        F.col("enrollment").alias("enrollment_raw"),
        S.cap_at(F.col("enrollment").cast("double"), limit).alias("enrollment"),
    )


def _footprint(countries: DataFrame) -> DataFrame:
    return (
        v_geography(countries)
        .groupBy("nct_id")
        .agg(n_regions().alias("regions"), n_distinct("country").alias("countries"))
    )


def _with_measures(rows: DataFrame, chunks: DataFrame, trials: DataFrame) -> DataFrame:
    return (
        rows.drop("enrollment")
        .join(v_burden(chunks), "nct_id", "left")
        .join(v_enrol(trials).select("nct_id", "enrollment"), "nct_id", "left")
        .withColumn("screening_burden", S.screening_burden(F.col("n_criteria")))
    )


def board_global(landscape: DataFrame, chunks: DataFrame, trials: DataFrame, countries: DataFrame) -> DataFrame:
    """Exactly one row per trial."""
    rows = _with_measures(landscape, chunks, trials).join(_footprint(countries), "nct_id", "left")
    zero = F.lit(0)
    return rows.select(
        F.col("nct_id").alias("trial_id"),
        "indication",
        F.col("brief_title").alias("title"),
        "phase",
        F.when(F.col("phase_is_stated"), "Stated").otherwise("Not stated").alias("phase_stated"),
        F.col("status_group").alias("status"),
        F.col("lead_sponsor").alias("sponsor"),
        "sponsor_type",
        F.col("comparator_design").alias("design"),
        F.coalesce("primary_endpoint_category", F.lit("Not recorded")).alias("primary_endpoint"),
        "start_year",
        F.coalesce("regions", zero).alias("regions"),
        S.footprint(F.col("regions")).alias("footprint"),
        F.coalesce("countries", zero).alias("countries"),
        F.col("enrollment").alias("planned_enrolment"),
        F.col("n_criteria").alias("criteria"),
        F.col("n_exclusion").alias("exclusion_criteria"),
        "screening_burden",
        F.lit(1).alias("trials"),
    )


def board_region(landscape: DataFrame, chunks: DataFrame, trials: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per trial and country, enrolment shared equally between the trial's countries.

    Trials without a country are absent; count trials with a distinct count.
    """
    measured = _with_measures(landscape, chunks, trials).join(_footprint(countries), "nct_id", "left")
    rows = v_geography(countries).join(measured, "nct_id")
    return rows.select(
        "region",
        "country",
        F.col("nct_id").alias("trial_id"),
        "indication",
        F.col("brief_title").alias("title"),
        "phase",
        F.col("status_group").alias("status"),
        F.col("lead_sponsor").alias("sponsor"),
        "sponsor_type",
        F.col("comparator_design").alias("design"),
        "start_year",
        S.footprint(F.col("regions")).alias("footprint"),
        F.col("n_criteria").alias("criteria"),
        F.col("n_exclusion").alias("exclusion_criteria"),
        "screening_burden",
        S.per_share(F.col("enrollment"), F.col("countries")).alias("enrolment_share"),
        F.col("enrollment").alias("trial_enrolment"),
        F.lit(1).alias("site_countries"),
    )


def without_country(landscape: DataFrame, countries: DataFrame) -> DataFrame:
    """Trials that the regional board cannot show."""
    return landscape.join(countries.select("nct_id"), "nct_id", "left_anti")
