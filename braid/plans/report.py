"""Landscape report: one scope, several sections, and the judgements behind the headline number."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.operators.matching import contains_join
from braid.operators.ranking import top_k_per_group
from braid.operators.shares import distribution, linked_gap, with_share
from braid.plans.resolution import HOME, v_trial_drug
from braid.plans.semantic import v_endpoints
from braid.session import settle


@dataclass(frozen=True)
class Scope:
    indication: str | None = None
    phase: str | None = None
    country: str | None = None
    geo: str = "has_us_site"
    drug: str | None = None
    drug_resolved: bool = True
    monotherapy_only: bool = False


@dataclass(frozen=True)
class Layer:
    """The relations a report reads."""

    resolved: DataFrame
    countries: DataFrame
    interventions: DataFrame
    outcomes: DataFrame
    aliases: DataFrame
    links: DataFrame | None = None


def _named(layer: Layer, drug: str) -> DataFrame:
    hit = F.upper("intervention_name").contains(drug.upper())
    return layer.interventions.filter(hit).select("nct_id")


def _aliased(layer: Layer, drug: str) -> DataFrame:
    curated = layer.aliases.filter(F.col("canonical") == drug)
    return v_trial_drug(layer.interventions, curated).select("nct_id")


def _drug_ids(layer: Layer, scope: Scope) -> DataFrame:
    return _aliased(layer, scope.drug) if scope.drug_resolved else _named(layer, scope.drug)


def in_scope(layer: Layer, scope: Scope) -> DataFrame:
    """Resolved trials the scope selects; plain filters first, then semi joins."""
    rows = layer.resolved
    if scope.indication:
        rows = rows.filter(F.col("indication") == scope.indication)
    if scope.phase:
        rows = rows.filter(F.col("phase") == scope.phase)
    if scope.monotherapy_only:
        rows = rows.filter("is_monotherapy")
    if scope.country == HOME:
        rows = rows.filter("us_only" if scope.geo == "us_only" else "has_us_site")
    elif scope.country:
        rows = rows.join(layer.countries.filter(F.col("country") == scope.country).select("nct_id"), "nct_id", "left_semi")
    if scope.drug:
        rows = rows.join(_drug_ids(layer, scope), "nct_id", "left_semi")
    return rows


def _judgement(name: str, applied: str, this: Column, other: Column) -> Column:
    return F.struct(
        F.lit(name).alias("judgement"), F.lit(applied).alias("applied"), this.alias("this_report"), other.alias("alternative")
    )


def definitions_applied(layer: Layer, scope: Scope) -> DataFrame:
    """For each judgement the count under the reading taken and under the other one, from one pass.

    The drug and geography conditions become flags on the trials that the other
    conditions leave, so every reading is a conditional count.
    """
    base = in_scope(layer, replace(scope, drug=None, country=None if scope.country == HOME else scope.country))
    yes = F.lit(True)
    drug_ok, named, us_ok = yes, yes, yes
    if scope.drug:
        for flag, ids in (("_aliased", _aliased(layer, scope.drug)), ("_named", _named(layer, scope.drug))):
            base = base.join(ids.distinct().withColumn(flag, yes), "nct_id", "left")
        named = F.col("_named").isNotNull()
        aliased = F.col("_aliased").isNotNull()
        drug_ok = aliased if scope.drug_resolved else named
    if scope.country == HOME:
        us_ok = F.col("us_only") if scope.geo == "us_only" else F.col("has_us_site")
    rows: list[Column] = []
    if scope.drug:
        if scope.drug_resolved:
            rows.append(_judgement("drug identity", "all known aliases", F.count_if(aliased & us_ok), F.count_if(named & us_ok)))
        else:
            rows.append(_judgement("drug identity", "literal name only", F.count_if(named & us_ok), F.lit(None).cast("bigint")))
    if scope.country == HOME:
        site, only = F.count_if(drug_ok & F.col("has_us_site")), F.count_if(drug_ok & F.col("us_only"))
        if scope.geo == "us_only":
            rows.append(_judgement("what 'in the US' means", "US-only", only, site))
        else:
            rows.append(_judgement("what 'in the US' means", "has a US site", site, only))
        rows.append(_judgement("us-led", "not applied", F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    if scope.drug or scope.indication:
        kept = drug_ok & us_ok
        rows.append(
            _judgement("combination therapy", "single agent and combination", F.count_if(kept), F.count_if(kept & F.col("is_monotherapy")))
        )
    if not rows:
        rows = [_judgement("none", "no judgement applies", F.count(F.lit(1)), F.lit(None).cast("bigint"))]
    flat = base.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)])
    return flat.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rows))])))


def scope_counts(scoped: DataFrame) -> DataFrame:
    """Trials, sponsors and trials with a stated phase: one row, all 0 for an empty scope."""
    return scoped.agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_distinct("lead_sponsor").alias("sponsors"),
        F.count_if("phase_is_stated").alias("with_a_stated_phase"),
    )


def largest_trials(scoped: DataFrame, k: int = 15) -> DataFrame:
    return (
        scoped.orderBy(F.desc_nulls_last("enrollment"), "nct_id")
        .limit(k)
        .select(
            "nct_id", F.substring("brief_title", 1, 90).alias("title"), "phase", "status_group", "lead_sponsor",
            "enrollment", "start_year",
        )
    )


def top_sponsors(scoped: DataFrame, k: int = 10) -> DataFrame:
    """Largest sponsor groups with the number of raw names that collapsed into each."""
    by = scoped.groupBy("sponsor_group", "sponsor_type").agg(
        F.count(F.lit(1)).alias("trials"), F.count_distinct("lead_sponsor").alias("raw_names")
    )
    return by.orderBy(F.desc("trials"), "sponsor_group", "sponsor_type").limit(k)


def phase_share(scoped: DataFrame) -> DataFrame:
    return with_share(distribution(scoped, ["phase"], "trials"), "trials")


def status_counts(scoped: DataFrame) -> DataFrame:
    return distribution(scoped, ["status_group"], "trials")


def top_countries(scoped: DataFrame, countries: DataFrame, k: int = 10) -> DataFrame:
    rows = countries.join(scoped.select("nct_id"), "nct_id", "left_semi")
    by = rows.groupBy("country").agg(F.count_distinct("nct_id").alias("trials"))
    return by.orderBy(F.desc("trials"), "country").limit(k)


def top_endpoints(scoped: DataFrame, outcomes: DataFrame, k: int = 10) -> DataFrame:
    primary = outcomes.filter(F.col("outcome_kind") == "PRIMARY").join(scoped.select("nct_id"), "nct_id", "left_semi")
    by = v_endpoints(primary).groupBy("endpoint_category").agg(F.count_distinct("nct_id").alias("trials"))
    return by.orderBy(F.desc("trials"), "endpoint_category").limit(k)


GAP = ("completed_trials", "with_a_linked_paper", "no_linked_paper", "pct_missing")


def publication_linkage(scoped: DataFrame, links: DataFrame) -> DataFrame:
    """Completed trials in scope with and without a linked paper; one row, counts 0 and no share for an empty scope."""
    completed = scoped.filter(F.col("status_group") == "Completed").select("nct_id")
    return linked_gap(completed, links, "nct_id", [], GAP)


def publication_gap(landscape: DataFrame, links: DataFrame) -> DataFrame:
    """Completed trials with a stated phase, per phase, with and without a linked paper."""
    rows = landscape.filter((F.col("status_group") == "Completed") & F.col("phase_is_stated")).select("nct_id", "phase")
    return linked_gap(rows, links, "nct_id", ["phase"], ("completed", "published", "missing", "pct"))


def sections(layer: Layer, scope: Scope) -> dict[str, DataFrame]:
    """Every section of the report over one scope. A section without rows stays in the result."""
    scoped = in_scope(layer, scope).cache()
    out = {
        "definitions": definitions_applied(layer, scope),
        "scope": scope_counts(scoped),
        "trials": largest_trials(scoped),
        "sponsors": top_sponsors(scoped),
        "phase": phase_share(scoped),
        "status": status_counts(scoped),
        "geography": top_countries(scoped, layer.countries),
        "endpoints": top_endpoints(scoped, layer.outcomes),
    }
    if layer.links is not None:
        out["publications"] = publication_linkage(scoped, layer.links)
    return out


def in_scopes(layer: Layer, scopes: DataFrame) -> DataFrame:
    """(question, resolved columns): the trials of each scope, for a table of scopes.

    ``scopes``: question, indication, phase, country, drug, drug_resolved, as parsed from
    keywords; a null restricts nothing. A scope is offered under each pair of indication and
    phase that it allows, so that trials meet it by equality; country and drug are then
    looked up among the trial's own countries and matched drugs.
    """
    kinds = layer.resolved.select("indication", "phase").distinct()
    free = lambda c: F.col(f"s_{c}").isNull() | (F.col(f"s_{c}") == F.col(c))
    named = scopes.select(*[F.col(c).alias(c if c == "question" else f"s_{c}") for c in ("question", "indication", "phase", "country", "drug", "drug_resolved")])
    # A handful of pairs of two coded columns, so this product is small.
    offered = named.join(F.broadcast(kinds), free("indication") & free("phase")).drop("s_indication", "s_phase")
    places = scopes.select("country").distinct()
    sites = layer.countries.join(places, "country", "left_semi").groupBy("nct_id").agg(F.collect_set("country").alias("_sites"))
    words = scopes.filter("drug IS NOT NULL AND NOT drug_resolved").select(F.upper("drug").alias("_up"), F.col("drug").alias("s_drug")).distinct()
    names = layer.interventions.select("nct_id", F.upper("intervention_name").alias("_name")).distinct()
    literal = contains_join(names.select("_name").distinct(), "_name", words, "_up").join(names, "_name").select("nct_id", "s_drug")
    curated = v_trial_drug(layer.interventions, layer.aliases).select("nct_id", F.col("drug").alias("s_drug"))
    drugs = curated.withColumn("s_drug_resolved", F.lit(True)).union(literal.withColumn("s_drug_resolved", F.lit(False)))
    asked = named.select("s_drug", "s_drug_resolved").distinct()
    given = drugs.join(asked, ["s_drug", "s_drug_resolved"], "left_semi").groupBy("nct_id").agg(F.collect_set(F.struct("s_drug", "s_drug_resolved")).alias("_drugs"))
    # A trial meets its own countries and drugs before it is offered to scopes, once for all of them.
    rows = layer.resolved.join(sites, "nct_id", "left").join(given, "nct_id", "left").join(offered, ["indication", "phase"])
    there = F.exists("_sites", lambda c: c == F.col("s_country"))
    takes = F.exists("_drugs", lambda d: (d["s_drug"] == F.col("s_drug")) & (d["s_drug_resolved"] == F.col("s_drug_resolved")))
    rows = rows.filter((F.col("s_country").isNull() | there) & (F.col("s_drug").isNull() | takes))
    return rows.select("question", *layer.resolved.columns)


#: Columns of the resolved trials that the sections read.
_READ = (
    "nct_id", "indication", "phase", "status_group", "lead_sponsor", "sponsor_group", "enrollment", "phase_is_stated", "is_monotherapy", "us_only",
)
BUNDLE = ("definitions", "scope", "trials", "sponsors", "phase", "status", "geography", "endpoints", "publications")


def _definitions(layer: Layer, scopes: DataFrame, rows: DataFrame) -> DataFrame:
    """For every scope each judgement's count as read, and under the other reading.

    A US site includes trials in the US only, and all trials those of a single agent, so these are
    counted among the scope's own rows; the other reading of a drug that has aliases is its
    literal name, for which the scopes are resolved once more.
    """
    other = in_scopes(layer, scopes.filter("drug IS NOT NULL AND drug_resolved").withColumn("drug_resolved", F.lit(False)))
    named = other.groupBy("question").agg(F.count("*").alias("named"))
    counts = rows.groupBy("question").agg(F.count("*").alias("all"), F.count_if("is_monotherapy").alias("single"), F.count_if("us_only").alias("home"))
    flat = scopes.join(counts, "question", "left").join(named, "question", "left")

    def pair(judgement: str, when: Column, this: str, alternative: str | None) -> Column:
        shown = [F.struct(F.lit(f"{judgement}: {side}").alias("item"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for side, c in (("this report", this), ("alternative", alternative)) if c]
        return F.when(when, F.array(*shown)).otherwise(F.array().cast("array<struct<item:string,n:bigint>>"))

    drug, home = F.col("drug").isNotNull(), F.coalesce(F.col("country") == HOME, F.lit(False))
    either = drug | F.col("indication").isNotNull()
    judged = F.concat(
        pair("drug identity", drug & F.col("drug_resolved"), "all", "named"),
        pair("drug identity", drug & ~F.col("drug_resolved"), "all", None),
        pair("what 'in the US' means", home, "all", "home"),
        pair("combination therapy", either, "all", "single"),
        pair("none", ~(either | home), "all", None),
    )
    return flat.select("question", F.lit("definitions").alias("section"), F.inline(judged))


def bundle(layer: Layer, scopes: DataFrame, k: int = 10, largest: int = 15) -> DataFrame:
    """(question, section, item, n): every section of every scope's report in long form.

    Sponsors, countries and endpoints are cut to the ``k`` largest, trials to the ``largest``, with
    their enrolment (0 where it is unknown). Definitions count each reading and its alternative. A section without rows
    stays, as one row without an item.
    """
    scopes = settle(scopes, "scopes")
    # Scopes and their other readings meet these relations, so they are written once.
    layer = replace(layer, resolved=settle(layer.resolved.select(*_READ), "resolved"), countries=settle(layer.countries, "countries"))
    # Every section reads these rows, so they are written once.
    rows = settle(in_scopes(layer, scopes), "scoped")
    ids = rows.select("question", "nct_id").distinct()

    def counted(section: str, df: DataFrame, item: str, top: int | None = None) -> DataFrame:
        by = df.groupBy("question", F.col(item).alias("item")).agg(F.count_distinct("nct_id").alias("n"))
        if top:
            by = top_k_per_group(by, ["question"], [F.desc("n"), F.col("item")], top).drop("rank")
        return by.select("question", F.lit(section).alias("section"), "item", "n")

    def listed(section: str, df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        sums = df.groupBy("question").agg(*[c.alias(n) for n, c in counts.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in counts])
        return sums.select("question", F.lit(section).alias("section"), F.inline(pairs))

    done = rows.filter("status_group = 'Completed'").select("question", "nct_id")
    linked = done.join(layer.links.select("nct_id", F.lit(1).alias("_paper")).distinct(), "nct_id", "left")
    primary = v_endpoints(layer.outcomes.filter("outcome_kind = 'PRIMARY'")).select("nct_id", "endpoint_category")
    biggest = rows.select("question", F.col("nct_id").cast("string").alias("item"), "enrollment", "nct_id")
    biggest = top_k_per_group(biggest, ["question"], [F.desc_nulls_last("enrollment"), F.col("nct_id")], largest)
    parts = [
        _definitions(layer, scopes, rows),
        biggest.select("question", F.lit("trials").alias("section"), "item", F.col("enrollment").cast("long").alias("n")),
        listed("scope", rows, {"trials": F.count(F.lit(1)), "sponsors": F.count_distinct("lead_sponsor"), "with_a_stated_phase": F.count_if("phase_is_stated")}),
        counted("sponsors", rows, "sponsor_group", k),
        counted("phase", rows, "phase"),
        counted("status", rows, "status_group"),
        counted("geography", ids.join(layer.countries, "nct_id"), "country", k),
        counted("endpoints", ids.join(primary, "nct_id"), "endpoint_category", k),
        listed("publications", linked, {"completed": F.count(F.lit(1)), "with_a_linked_paper": F.count("_paper")}),
    ]
    found = reduce(DataFrame.unionByName, parts)
    every = scopes.select("question", F.explode(F.array(*[F.lit(b) for b in BUNDLE])).alias("section"))
    return every.join(found, ["question", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def section_sizes(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per section, empty sections included."""
    sized = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, sized)


def phase_by_status(landscape: DataFrame) -> DataFrame:
    """Structured slice: trials and sponsors by phase and status."""
    return landscape.groupBy("phase", "status_group").agg(
        F.count(F.lit(1)).alias("trials"), F.count_distinct("lead_sponsor").alias("sponsors")
    )


def most_common_match(interventions: DataFrame, words: DataFrame) -> DataFrame:
    """For each word the intervention name containing it that most trials use."""
    per_name = interventions.groupBy("intervention_name").agg(F.count_distinct("nct_id").alias("trials"))
    hits = contains_join(
        per_name.withColumn("_name", F.upper("intervention_name")), "_name", words.withColumn("_word", F.upper("word")), "_word"
    )
    best = top_k_per_group(hits, ["word"], [F.desc("trials"), F.col("intervention_name")], 1)
    return best.select("word", "intervention_name", "trials")
