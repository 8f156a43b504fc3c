"""Resolution layer: drug aliases, sponsor roll-up, readings of a geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions import scalars as S
from braid.operators.matching import contains_join, has_words
from braid.plans.semantic import n_distinct

# Curated drug names: canonical name, alias, kind (fixed values).
DRUG_ALIASES = [
    ("pembrolizumab", "pembrolizumab", "generic"),
    ("pembrolizumab", "keytruda", "brand"),
    ("pembrolizumab", "mk-3475", "code"),
    ("pembrolizumab", "mk3475", "code"),
    ("pembrolizumab", "sch 900475", "code"),
    ("pembrolizumab", "sch900475", "code"),
    ("pembrolizumab", "lambrolizumab", "former"),
    ("nivolumab", "nivolumab", "generic"),
    ("nivolumab", "opdivo", "brand"),
    ("nivolumab", "bms-936558", "code"),
    ("atezolizumab", "atezolizumab", "generic"),
    ("atezolizumab", "tecentriq", "brand"),
    ("durvalumab", "durvalumab", "generic"),
    ("durvalumab", "imfinzi", "brand"),
    ("trastuzumab", "trastuzumab", "generic"),
    ("trastuzumab", "herceptin", "brand"),
    ("osimertinib", "osimertinib", "generic"),
    ("osimertinib", "tagrisso", "brand"),
    ("osimertinib", "azd9291", "code"),
]

# Readings of "in the US": rule, whether it is the default, whether the registry can answer it.
GEO_DEFINITIONS = [
    ("has_us_site", "at least one recruiting site in the United States", True, True),
    ("us_only", "every recorded site is in the United States", False, True),
    ("us_led", "the lead sponsor is a US organisation", False, False),
]
HOME = "United States"


def drug_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRUG_ALIASES, "canonical string, alias string, alias_kind string")


def geo_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        GEO_DEFINITIONS, "definition string, rule_text string, is_default boolean, is_available boolean"
    )


def v_trial_drug(interventions: DataFrame, aliases: DataFrame, whole_words: bool = False) -> DataFrame:
    """Trials per canonical drug and how the name matched.

    The alias may occur anywhere in the name; ``whole_words`` asks for word
    boundaries. Names are matched once each, then joined back to the trials.
    """
    names = interventions.select("intervention_name").distinct().withColumn("_name", F.upper("intervention_name"))
    keyed = aliases.withColumn("_alias", F.upper("alias"))
    hits = contains_join(names, "_name", keyed, "_alias")
    if whole_words:
        hits = hits.filter(has_words(F.col("_name"), F.col("_alias")))
    hits = hits.select("intervention_name", F.col("canonical").alias("drug"), "alias_kind").distinct()
    return (
        interventions.select("nct_id", "intervention_name")
        .join(hits, "intervention_name")
        .select("nct_id", "drug", "alias_kind", F.col("intervention_name").alias("matched_text"))
        .distinct()
    )


def v_regimen(interventions: DataFrame) -> DataFrame:
    """Number of drug or biological agents and whether there is only one."""
    agents = interventions.filter(F.col("intervention_type").isin("DRUG", "BIOLOGICAL"))
    n = agents.groupBy("nct_id").agg(F.count_distinct("intervention_name").alias("n_agents"))
    return n.withColumn("is_monotherapy", F.col("n_agents") == 1)


def v_sponsor(landscape: DataFrame) -> DataFrame:
    return landscape.select("nct_id", "lead_sponsor", "sponsor_type", S.sponsor_group(F.col("lead_sponsor")).alias("sponsor_group"))


def v_trial_geo(landscape: DataFrame, countries: DataFrame, home: str = HOME) -> DataFrame:
    """Countries per trial and the two answerable readings; a trial without countries has neither."""
    per_trial = countries.groupBy("nct_id").agg(
        n_distinct("country").alias("n_countries"), F.bool_or(F.col("country") == home).alias("has_us_site")
    )
    return (
        landscape.select("nct_id")
        .join(per_trial, "nct_id", "left")
        .select(
            "nct_id",
            F.coalesce("n_countries", F.lit(0)).alias("n_countries"),
            F.coalesce("has_us_site", F.lit(False)).alias("has_us_site"),
        )
        .withColumn("us_only", (F.col("n_countries") == 1) & F.col("has_us_site"))
    )


def v_resolved(landscape: DataFrame, countries: DataFrame, interventions: DataFrame) -> DataFrame:
    """The landscape row with every resolved judgement beside it."""
    return (
        landscape.withColumn("sponsor_group", S.sponsor_group(F.col("lead_sponsor")))
        .join(v_trial_geo(landscape, countries), "nct_id", "left")
        .join(v_regimen(interventions), "nct_id", "left")
    )
