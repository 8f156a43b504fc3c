"""Reading registry snapshots and shredding nested studies into flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions import scalars as S
from braid.functions.chunks import chunk_rows, criteria
from braid.operators.ranking import top_k_per_group

_PROTOCOL = """STRUCT<
  identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>,
  statusModule: STRUCT<overallStatus: STRING, startDateStruct: STRUCT<date: STRING>>,
  designModule: STRUCT<studyType: STRING, phases: ARRAY<STRING>, enrollmentInfo: STRUCT<count: BIGINT>>,
  sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING, class: STRING>>,
  eligibilityModule: STRUCT<eligibilityCriteria: STRING, minimumAge: STRING, maximumAge: STRING, sex: STRING, healthyVolunteers: STRING>,
  conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
  outcomesModule: STRUCT<primaryOutcomes: ARRAY<STRUCT<measure: STRING, timeFrame: STRING>>,
                         secondaryOutcomes: ARRAY<STRUCT<measure: STRING, timeFrame: STRING>>>,
  armsInterventionsModule: STRUCT<armGroups: ARRAY<STRUCT<type: STRING, label: STRING>>,
                                  interventions: ARRAY<STRUCT<type: STRING, name: STRING>>>,
  contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<country: STRING>>>>"""
STUDY = f"protocolSection {_PROTOCOL}, _indication STRING"

_P = "protocolSection."


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Studies landed as JSON lines: the form that splits."""
    return spark.read.schema(STUDY).json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole snapshot document ``{_meta, studies: [...]}``, compressed or not; one task per file."""
    whole = f"studies ARRAY<STRUCT<protocolSection: {_PROTOCOL}, _indication: STRING>>"
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.inline("studies"))


def parse(raw: DataFrame, column: str) -> DataFrame:
    """Studies from a string column of JSON."""
    return raw.select(F.from_json(column, STUDY).alias("s")).select("s.*")


def study_key() -> Column:
    return S.blank_to_null(F.col(_P + "identificationModule.nctId"))


def union_snapshots(sources: list[tuple[str, DataFrame]], position: str | None = None) -> DataFrame:
    """All sources as one, each study tagged with the indication it was fetched for; the first source wins.

    Within a source the smallest ``position`` wins, or the smallest content when
    the source carries no position. Rows are ranked with the fields alone that are read of the
    result, so that an unread text is not shuffled.
    """
    tagged = [
        df.withColumn("_indication", F.lit(name)).withColumn("_source", F.lit(i)) for i, (name, df) in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, tagged).withColumn("_key", study_key()).filter("_key is not null")
    rows = rows.withColumn("_at", F.col(position) if position else F.xxhash64(F.to_json("protocolSection")))
    return top_k_per_group(rows, ["_key"], [F.col("_source"), F.col("_at")], 1, "_rank").drop("_key", "_source", "_at", "_rank")


def clashes(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """How many studies a union drops because another one has the same key."""
    keys = reduce(DataFrame.unionByName, [df.select(study_key().alias("_key")) for _, df in sources]).filter("_key is not null")
    return keys.agg(
        F.count_distinct("_key").alias("trials"), (F.count(F.lit(1)) - F.count_distinct("_key")).alias("cross_listed_dropped")
    )


def _keyed(studies: DataFrame) -> DataFrame:
    return studies.withColumn("nct_id", study_key()).filter("nct_id is not null")


def trials(studies: DataFrame) -> DataFrame:
    """One row per study: nested modules flattened, phase and ages normalised."""
    m = {n: _P + n + "." for n in ("identificationModule", "statusModule", "designModule", "sponsorCollaboratorsModule", "eligibilityModule")}
    phases = F.col(m["designModule"] + "phases")
    elig = F.coalesce(F.col(m["eligibilityModule"] + "eligibilityCriteria"), F.lit(""))
    return _keyed(studies).select(
        "nct_id",
        F.col("_indication").alias("indication"),
        F.col(m["identificationModule"] + "briefTitle").alias("brief_title"),
        F.col(m["statusModule"] + "overallStatus").alias("overall_status"),
        F.col(m["designModule"] + "studyType").alias("study_type"),
        S.phase(phases).alias("phase"),
        S.phase_raw(phases).alias("phase_raw"),
        F.col(m["sponsorCollaboratorsModule"] + "leadSponsor.name").alias("lead_sponsor"),
        F.col(m["sponsorCollaboratorsModule"] + "leadSponsor.class").alias("sponsor_class"),
        F.col(m["designModule"] + "enrollmentInfo.count").alias("enrollment"),
        S.blank_to_null(F.col(m["statusModule"] + "startDateStruct.date")).alias("start_date"),
        S.age_years(F.col(m["eligibilityModule"] + "minimumAge")).alias("min_age_years"),
        S.age_years(F.col(m["eligibilityModule"] + "maximumAge")).alias("max_age_years"),
        F.col(m["eligibilityModule"] + "sex").alias("sex"),
        F.col(m["eligibilityModule"] + "healthyVolunteers").alias("healthy_volunteers"),
        F.length(elig).cast("bigint").alias("elig_chars"),
        elig.alias("eligibility_text"),
    )


def conditions(studies: DataFrame) -> DataFrame:
    return _keyed(studies).select("nct_id", F.explode(_P + "conditionsModule.conditions").alias("condition_name"))


def countries(studies: DataFrame) -> DataFrame:
    """Distinct countries of a study, taken inside its row."""
    named = F.filter(F.col(_P + "contactsLocationsModule.locations.country"), lambda c: S.blank_to_null(c).isNotNull())
    return _keyed(studies).select("nct_id", F.explode(F.array_distinct(named)).alias("country"))


def outcomes(studies: DataFrame) -> DataFrame:
    """Primary and secondary outcomes, numbered from 0 within their kind."""
    keyed = _keyed(studies)
    parts = [
        keyed.select("nct_id", F.lit(kind).alias("outcome_kind"), F.posexplode(_P + "outcomesModule." + field).alias("seq", "o"))
        for kind, field in (("PRIMARY", "primaryOutcomes"), ("SECONDARY", "secondaryOutcomes"))
    ]
    return parts[0].unionByName(parts[1]).select(
        "nct_id", "seq", "outcome_kind", F.col("o.measure").alias("measure"), F.col("o.timeFrame").alias("time_frame")
    )


def arms(studies: DataFrame) -> DataFrame:
    """Arms with their type; an absent type reads UNSPECIFIED."""
    rows = _keyed(studies).select("nct_id", F.posexplode(_P + "armsInterventionsModule.armGroups").alias("seq", "a"))
    kind = F.coalesce(S.blank_to_null(F.col("a.type")), F.lit("UNSPECIFIED"))
    return rows.select("nct_id", "seq", kind.alias("arm_type"), F.col("a.label").alias("arm_label"))


def interventions(studies: DataFrame) -> DataFrame:
    rows = _keyed(studies).select("nct_id", F.posexplode(_P + "armsInterventionsModule.interventions").alias("seq", "i"))
    return rows.select("nct_id", "seq", F.col("i.type").alias("intervention_type"), F.col("i.name").alias("intervention_name"))


def chunks(studies: DataFrame) -> DataFrame:
    return chunk_rows(_keyed(studies), "nct_id", _P + "eligibilityModule.eligibilityCriteria")


def shred(studies: DataFrame) -> dict[str, DataFrame]:
    """All tables of a snapshot. Land the studies as parquet first: then each table reads only its own fields."""
    return {
        "trials": trials(studies),
        "trial_conditions": conditions(studies),
        "trial_countries": countries(studies),
        "trial_outcomes": outcomes(studies),
        "trial_arms": arms(studies),
        "trial_interventions": interventions(studies),
        "elig_chunks": chunks(studies),
    }


def metrics(studies: DataFrame) -> DataFrame:
    """Trials, chunks, chunks per section and trials without any chunk, in one pass and without a shuffle of texts."""
    cut = _keyed(studies).select(criteria(F.col(_P + "eligibilityModule.eligibilityCriteria")).alias("c"))

    def of(test):
        return F.coalesce(F.sum(F.size(F.filter("c", lambda x: test(x["criterion_section"])))), F.lit(0))

    return cut.agg(
        F.count(F.lit(1)).alias("trials"),
        F.coalesce(F.sum(F.size("c")), F.lit(0)).alias("chunks"),
        of(lambda s: s == "INCLUSION").alias("incl"),
        of(lambda s: s == "EXCLUSION").alias("excl"),
        of(lambda s: ~s.isin("INCLUSION", "EXCLUSION")).alias("unk"),
        F.count_if(F.size("c") == 0).alias("no_elig"),
    )
