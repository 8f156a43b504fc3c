"""Semantic layer over the registry tables: typed, grouped and classified columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.functions import scalars as S
from braid.operators.rules import ordered_rules


def v_trials(trials: DataFrame) -> DataFrame:
    return (
        trials.withColumn("sponsor_type", S.sponsor_type(F.col("sponsor_class")))
        .withColumn("phase_is_stated", S.phase_is_stated(F.col("phase")))
        .withColumn("phase_is_numbered", S.phase_is_numbered(F.col("phase")))
        .withColumn("status_group", S.status_group(F.col("overall_status")))
        .withColumn("start_year", S.start_year(F.col("start_date")))
    )


def v_geography(countries: DataFrame) -> DataFrame:
    return countries.withColumn("region", S.region(F.col("country")))


def n_regions(region: str = "region"):
    """Distinct regions as bits of a number, which hash aggregation keeps in place."""
    names = [*S.REGION_COUNTRIES, S.UNMAPPED]
    bit = ordered_rules([(F.col(region) == name, 1 << i) for i, name in enumerate(names)], 0)
    return F.bit_count(F.bit_or(bit)).cast("bigint")


ENDPOINTS = sorted([label for _, label in S.ENDPOINT_RULES] + [S.UNCLASSIFIED])


def first_label(column: str, labels: list[str]):
    """Alphabetically first of a fixed set of labels, aggregated as its number, which needs no sort."""
    place = F.min(ordered_rules([(F.col(column) == label, i) for i, label in enumerate(labels)], len(labels)))
    return F.get(F.array(*[F.lit(label) for label in labels]), place)


def n_distinct(column: str):
    """Distinct count of a column with few values, such as a country: one shuffle instead of two."""
    return F.size(F.collect_set(column)).cast("bigint")


def v_endpoints(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("endpoint_category", S.endpoint_category(F.col("measure")))


def v_design(arms: DataFrame) -> DataFrame:
    """Arm counts per trial and the comparator class they imply."""

    def of_type(name):
        return F.count_if(F.col("arm_type") == name)

    counted = arms.groupBy("nct_id").agg(
        F.count(F.lit(1)).alias("arm_count"),
        of_type("PLACEBO_COMPARATOR").alias("placebo_arms"),
        of_type("ACTIVE_COMPARATOR").alias("active_arms"),
        of_type("UNSPECIFIED").alias("untyped_arms"),
    )
    return counted.withColumn(
        "comparator_design",
        F.when(F.col("placebo_arms") > 0, "Placebo-controlled")
        .when(F.col("active_arms") > 0, "Active-controlled")
        .when(F.col("arm_count") == 1, "Single-arm")
        .when(F.col("untyped_arms") == F.col("arm_count"), "No coded comparator")
        .otherwise("Multi-arm, no control coded"),
    )


LANDSCAPE = [
    "nct_id", "indication", "brief_title", "phase", "phase_is_stated", "status_group", "overall_status", "lead_sponsor",
    "sponsor_type", "enrollment", "start_year", "min_age_years", "max_age_years", "sex", "elig_chars",
]


def v_landscape(trials: DataFrame, arms: DataFrame, countries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One wide row per trial. Every child table is aggregated to the trial before its join."""
    regions = v_geography(countries).groupBy("nct_id").agg(n_regions().alias("region_count"))
    primary = (
        v_endpoints(outcomes)
        .filter(F.col("outcome_kind") == "PRIMARY")
        .groupBy("nct_id")
        .agg(first_label("endpoint_category", ENDPOINTS).alias("primary_endpoint_category"))
    )
    design = v_design(arms).select("nct_id", "comparator_design", "arm_count")
    return (
        v_trials(trials)
        .select(*LANDSCAPE)
        .join(design, "nct_id", "left")
        .join(regions, "nct_id", "left")
        .join(primary, "nct_id", "left")
        .withColumn("comparator_design", F.coalesce("comparator_design", F.lit("No arms recorded")))
        .withColumn("region_count", F.coalesce("region_count", F.lit(0)))
    )
