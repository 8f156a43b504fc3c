"""Semantic layer, resolution, boards, report and linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog import trial_frames as T
from braid.catalog.base import query, with_ctes
from braid.functions.scalars import screening_burden
from braid.functions.vectors import l2_norm
from braid.operators import shares
from braid.operators.rules import apply_filter
from braid.plans import boards, report, resolution, semantic
from braid.session import read_table

SCOPE = report.Scope(indication="NSCLC", country="United States", drug="pembrolizumab")
FILTERABLE = {"indication", "phase", "status_group", "sponsor_type", "start_year", "enrollment", "region_count", "comparator_design"}


@query(
    "trial_view",
    with_ctes(T.TRIALS, T.V_TRIALS)
    + "SELECT nct_id, sponsor_type, phase, phase_is_stated, phase_is_numbered, status_group, start_year, min_age_years, lead_sponsor FROM v_trials",
)
def trial_view(spark, sf):
    return semantic.v_trials(T.trials(spark, sf)).select(
        "nct_id", "sponsor_type", "phase", "phase_is_stated", "phase_is_numbered", "status_group", "start_year", "min_age_years",
        "lead_sponsor",
    )


@query("geo_rollup", with_ctes(T.GEO) + "SELECT nct_id, country, region FROM geography")
def geo_rollup(spark, sf):
    return semantic.v_geography(T.countries(spark, sf))


@query(
    "endpoint_class",
    with_ctes(T.OUTCOMES) + "SELECT nct_id, outcome_kind, measure, endpoint_category FROM endpoints",
)
def endpoint_class(spark, sf):
    return semantic.v_endpoints(T.outcomes(spark, sf))


@query("design_class", with_ctes(T.ARMS, T.DESIGN) + "SELECT * FROM design")
def design_class(spark, sf):
    return semantic.v_design(T.arms(spark, sf))


@query("landscape_wide", with_ctes(*T.LANDSCAPE_CTES) + "SELECT * FROM landscape")
def landscape_wide(spark, sf):
    return T.landscape(spark, sf)


@query(
    "typed_filter",
    with_ctes(*T.LANDSCAPE_CTES)
    + "SELECT nct_id, phase, status_group, enrollment FROM landscape WHERE indication = 'NSCLC' AND status_group <> 'Other' AND enrollment >= 1000 AND region_count > 1",
)
def typed_filter(spark, sf):
    clauses = [("indication", "=", "NSCLC"), ("status_group", "<>", "Other"), ("enrollment", ">=", 1000), ("region_count", ">", 1)]
    return apply_filter(T.landscape(spark, sf), clauses, FILTERABLE).select("nct_id", "phase", "status_group", "enrollment")


_BURDEN = """burden AS (
  SELECT nct_id, CAST(count(*) AS BIGINT) AS n_criteria, CAST(count(*) FILTER (criterion_section = 'EXCLUSION') AS BIGINT) AS n_exclusion,
         CAST(count(*) FILTER (criterion_section = 'INCLUSION') AS BIGINT) AS n_inclusion FROM chunks GROUP BY nct_id)"""
_BAND = """CASE WHEN n_criteria >= 40 THEN '4 · Very high' WHEN n_criteria >= 25 THEN '3 · High'
                WHEN n_criteria >= 14 THEN '2 · Moderate' ELSE '1 · Light' END"""


@query("burden_bands", with_ctes(T.CHUNKS, _BURDEN) + f"SELECT *, {_BAND} AS screening_burden FROM burden")
def burden_bands(spark, sf):
    rows = boards.v_burden(T.chunks(spark, sf))
    return rows.withColumn("screening_burden", screening_burden(F.col("n_criteria")))


_ENROL = """enrol AS (
  SELECT nct_id, enrollment AS enrollment_raw, CASE WHEN enrollment IS NOT NULL
         THEN least(CAST(enrollment AS DOUBLE), (SELECT quantile_cont(CAST(enrollment AS DOUBLE), 0.99) FROM trials)) END AS enrollment FROM trials)"""


@query("winsorise_p99", with_ctes(T.TRIALS, _ENROL) + "SELECT * FROM enrol")
def winsorise_p99(spark, sf):
    return boards.v_enrol(T.trials(spark, sf))


@query(
    "enrolment_over_p99",
    with_ctes(T.TRIALS, _ENROL) + "SELECT nct_id, enrollment_raw, enrollment AS p99 FROM enrol WHERE enrollment_raw > enrollment",
)
def enrolment_over_p99(spark, sf):
    """Trials whose stated enrolment lies above the cap."""
    rows = boards.v_enrol(T.trials(spark, sf)).filter(F.col("enrollment_raw") > F.col("enrollment"))
    return rows.select("nct_id", "enrollment_raw", F.col("enrollment").alias("p99"))


_FACTS = f"""cap AS (SELECT quantile_cont(CAST(enrollment AS DOUBLE), 0.99) AS p99 FROM trials),
asked AS (
  SELECT nct_id, CAST(count(*) AS BIGINT) AS criteria, CAST(count_if(criterion_section = 'EXCLUSION') AS BIGINT) AS exclusion_criteria
  FROM chunks GROUP BY nct_id),
reached AS (SELECT nct_id, CAST(count(DISTINCT country) AS BIGINT) AS countries FROM countries GROUP BY nct_id),
facts AS (
  SELECT nct_id AS trial_id, indication, brief_title AS title, phase, phase_is_stated, status_group AS status, lead_sponsor AS sponsor, sponsor_type,
         comparator_design AS design, ifnull(primary_endpoint_category, 'Not recorded') AS primary_endpoint, start_year, region_count AS regions,
         CASE WHEN region_count > 1 THEN 'Multi-region' ELSE 'Single region' END AS footprint, ifnull(countries, 0) AS countries,
         CASE WHEN enrollment >= p99 THEN p99 ELSE CAST(enrollment AS DOUBLE) END AS capped, criteria, exclusion_criteria,
         {_BAND.replace("n_criteria", "criteria")} AS screening_burden
  FROM landscape CROSS JOIN cap LEFT JOIN asked USING (nct_id) LEFT JOIN reached USING (nct_id))"""
_BOARD_CTES = (*T.LANDSCAPE_CTES, T.CHUNKS, _FACTS)


@query(
    "board_global",
    with_ctes(*_BOARD_CTES)
    + """SELECT * EXCLUDE (phase_is_stated, capped), CASE phase_is_stated WHEN true THEN 'Stated' ELSE 'Not stated' END AS phase_stated,
                capped AS planned_enrolment, 1 AS trials FROM facts""",
)
def board_global(spark, sf):
    return boards.board_global(T.landscape(spark, sf), T.chunks(spark, sf), T.trials(spark, sf), T.countries(spark, sf))


@query(
    "board_region_alloc",
    with_ctes(*_BOARD_CTES)
    + """SELECT region, country, facts.* EXCLUDE (phase_is_stated, primary_endpoint, regions, countries, capped),
                round(capped / countries, 1) AS enrolment_share, capped AS trial_enrolment, 1 AS site_countries
         FROM facts JOIN geography ON geography.nct_id = facts.trial_id""",
)
def board_region_alloc(spark, sf):
    return boards.board_region(T.landscape(spark, sf), T.chunks(spark, sf), T.trials(spark, sf), T.countries(spark, sf))


@query(
    "board_region_residual",
    with_ctes(*T.LANDSCAPE_CTES)
    + "SELECT v.nct_id, v.phase FROM landscape v WHERE NOT EXISTS (SELECT 1 FROM countries c WHERE c.nct_id = v.nct_id)",
)
def board_region_residual(spark, sf):
    return boards.without_country(T.landscape(spark, sf), T.countries(spark, sf)).select("nct_id", "phase")


@query("alias_match", with_ctes(T.INTERVENTIONS, T.TRIAL_DRUG) + "SELECT * FROM trial_drug")
def alias_match(spark, sf):
    return resolution.v_trial_drug(T.interventions(spark, sf), resolution.drug_aliases(spark))


@query(
    "regimen",
    with_ctes(T.INTERVENTIONS)
    + """SELECT nct_id, CAST(count(DISTINCT intervention_name) AS BIGINT) AS n_agents, count(DISTINCT intervention_name) = 1 AS is_monotherapy
         FROM interventions WHERE intervention_type IN ('DRUG', 'BIOLOGICAL') GROUP BY nct_id""",
)
def regimen(spark, sf):
    return resolution.v_regimen(T.interventions(spark, sf))


@query(
    "sponsor_rollup",
    with_ctes(*T.RESOLVED_CTES) + "SELECT nct_id, lead_sponsor, sponsor_type, sponsor_group FROM resolved",
)
def sponsor_rollup(spark, sf):
    return resolution.v_sponsor(T.landscape(spark, sf))


@query("geo_readings", with_ctes(*T.RESOLVED_CTES) + "SELECT nct_id, n_countries, has_us_site, us_only FROM resolved")
def geo_readings(spark, sf):
    return resolution.v_trial_geo(T.landscape(spark, sf), T.countries(spark, sf))


@query("trial_resolved", with_ctes(*T.RESOLVED_CTES) + "SELECT * FROM resolved")
def trial_resolved(spark, sf):
    return T.layer(spark, sf).resolved


# -------------------------------------------------------------------- report

_SCOPED = """scoped AS (SELECT * FROM resolved WHERE indication = 'NSCLC' AND has_us_site
  AND nct_id IN (SELECT nct_id FROM trial_drug WHERE drug = 'pembrolizumab'))"""
_REPORT = (*T.RESOLVED_CTES, T.TRIAL_DRUG, _SCOPED)


def _section(name):
    def run(spark, sf):
        layer = T.layer(spark, sf)
        scoped = report.in_scope(layer, SCOPE)
        return {
            "scope": lambda: report.scope_counts(scoped),
            "trials": lambda: report.largest_trials(scoped),
            "sponsors": lambda: report.top_sponsors(scoped),
            "phase": lambda: report.phase_share(scoped),
            "status": lambda: report.status_counts(scoped),
            "geography": lambda: report.top_countries(scoped, layer.countries),
            "endpoints": lambda: report.top_endpoints(scoped, layer.outcomes),
            "publications": lambda: report.publication_linkage(scoped, layer.links),
        }[name]()

    return run


_SECTION_SQL = {
    "scope": """FROM scoped SELECT CAST(count(nct_id) AS BIGINT) AS trials, CAST(count(DISTINCT lead_sponsor) AS BIGINT) AS sponsors,
                count(*) FILTER (WHERE phase_is_stated) AS with_a_stated_phase""",
    "trials": """FROM scoped SELECT nct_id, left(brief_title, 90) AS title, phase, status_group, lead_sponsor, enrollment, start_year
                 QUALIFY row_number() OVER (ORDER BY enrollment DESC NULLS LAST, nct_id) <= 15""",
    "sponsors": """WITH names AS (SELECT sponsor_group, sponsor_type, lead_sponsor, count(*) AS n FROM scoped GROUP BY ALL),
                   groups AS (SELECT sponsor_group, sponsor_type, CAST(sum(n) AS BIGINT) AS trials, CAST(count(*) AS BIGINT) AS raw_names FROM names GROUP BY ALL)
                   FROM groups SELECT * QUALIFY row_number() OVER (ORDER BY trials DESC, sponsor_group, sponsor_type) <= 10""",
    "phase": """WITH n AS (SELECT phase, CAST(count(*) AS BIGINT) AS trials FROM scoped GROUP BY ALL)
                SELECT phase, trials, round(100.0 * trials / sum(trials) OVER (), 1) AS pct FROM n""",
    "status": "FROM scoped SELECT status_group, CAST(count(nct_id) AS BIGINT) AS trials GROUP BY ALL",
    "geography": """WITH n AS (SELECT country, CAST(count(*) AS BIGINT) AS trials FROM scoped JOIN countries USING (nct_id) GROUP BY ALL)
                    FROM n SELECT * QUALIFY row_number() OVER (ORDER BY trials DESC, country) <= 10""",
    "endpoints": """WITH own AS (SELECT DISTINCT nct_id, endpoint_category FROM endpoints SEMI JOIN scoped USING (nct_id) WHERE outcome_kind = 'PRIMARY'),
                    n AS (SELECT endpoint_category, CAST(count(*) AS BIGINT) AS trials FROM own GROUP BY ALL)
                    FROM n SELECT * QUALIFY row_number() OVER (ORDER BY trials DESC, endpoint_category) <= 10""",
    "publications": """WITH done AS (SELECT nct_id, nct_id IN (SELECT nct_id FROM links) AS linked FROM scoped WHERE status_group = 'Completed'),
                       n AS (SELECT CAST(count(*) AS BIGINT) AS completed_trials, count(*) FILTER (WHERE linked) AS with_a_linked_paper FROM done)
                       SELECT *, completed_trials - with_a_linked_paper AS no_linked_paper,
                              round(100.0 * (completed_trials - with_a_linked_paper) / completed_trials, 1) AS pct_missing FROM n""",
}
for _name, _sql in _SECTION_SQL.items():
    query(f"report_{_name}", with_ctes(*_REPORT, T.LINKS) + f"SELECT * FROM ({_sql})")(_section(_name))

_NAMED = "nct_id IN (SELECT nct_id FROM interventions WHERE upper(intervention_name) LIKE '%PEMBROLIZUMAB%')"
_ALIASED = "nct_id IN (SELECT nct_id FROM trial_drug WHERE drug = 'pembrolizumab')"


@query(
    "definitions_applied",
    with_ctes(*_REPORT, "base AS (SELECT * FROM resolved WHERE indication = 'NSCLC')")
    + f"""SELECT 'drug identity' AS judgement, 'all known aliases' AS applied,
                 CAST((SELECT count(*) FROM base WHERE has_us_site AND {_ALIASED}) AS BIGINT) AS this_report,
                 CAST((SELECT count(*) FROM base WHERE has_us_site AND {_NAMED}) AS BIGINT) AS alternative
          UNION ALL SELECT 'what ''in the US'' means', 'has a US site',
                 CAST((SELECT count(*) FROM base WHERE has_us_site AND {_ALIASED}) AS BIGINT),
                 CAST((SELECT count(*) FROM base WHERE us_only AND {_ALIASED}) AS BIGINT)
          UNION ALL SELECT 'us-led', 'not applied', NULL, NULL
          UNION ALL SELECT 'combination therapy', 'single agent and combination',
                 CAST((SELECT count(*) FROM scoped) AS BIGINT), CAST((SELECT count(*) FROM scoped WHERE is_monotherapy) AS BIGINT)""",
)
def definitions_applied(spark, sf):
    return report.definitions_applied(T.layer(spark, sf), SCOPE)


_GAP_SQL = """SELECT phase, CAST(count(*) AS BIGINT) AS completed, CAST(count(p) AS BIGINT) AS published,
                     CAST(count(*) - count(p) AS BIGINT) AS missing, round(100.0 * (count(*) - count(p)) / count(*), 1) AS pct
              FROM landscape t LEFT JOIN (SELECT DISTINCT nct_id, 1 AS p FROM links) l ON l.nct_id = t.nct_id
              WHERE status_group = 'Completed' AND phase_is_stated GROUP BY phase"""


@query("publication_gap", with_ctes(*T.LANDSCAPE_CTES, T.LINKS) + _GAP_SQL)
def publication_gap(spark, sf):
    return report.publication_gap(T.landscape(spark, sf), T.links(spark, sf))


@query(
    "publication_gap_per_link",
    with_ctes(*T.LANDSCAPE_CTES, T.LINKS)
    + """SELECT phase, CAST(count(*) AS BIGINT) AS completed, CAST(count(DISTINCT l.nct_id) AS BIGINT) AS published,
                CAST(count(*) - count(DISTINCT l.nct_id) AS BIGINT) AS missing,
                round(100.0 * (count(*) - count(DISTINCT l.nct_id)) / count(*), 1) AS pct
         FROM landscape t LEFT JOIN links l ON l.nct_id = t.nct_id WHERE status_group = 'Completed' AND phase_is_stated GROUP BY phase""",
)
def publication_gap_per_link(spark, sf):
    """The same figures counted per link row, as first published; kept beside the per-trial reading."""
    rows = T.landscape(spark, sf).filter("status_group = 'Completed' AND phase_is_stated").select("nct_id", "phase")
    return shares.linked_gap_per_link(rows, T.links(spark, sf), "nct_id", ["phase"], ("completed", "published", "missing", "pct"))


@query(
    "lake_facts",
    with_ctes(*T.LANDSCAPE_CTES, T.LINKS)
    + """SELECT 'trials in corpus' AS fact, CAST(count(*) AS BIGINT) AS n FROM landscape
         UNION ALL SELECT 'with a linked paper', CAST(count(*) AS BIGINT) FROM landscape WHERE nct_id IN (SELECT nct_id FROM links)
         UNION ALL SELECT 'papers in the lake', CAST(count(*) AS BIGINT) FROM part
         UNION ALL SELECT 'link rows', CAST(count(*) AS BIGINT) FROM links
         UNION ALL SELECT 'papers with a link', CAST(count(DISTINCT pmid) AS BIGINT) FROM links""",
)
def lake_facts(spark, sf):
    land, links = T.landscape(spark, sf), T.links(spark, sf)
    return shares.labelled_counts(
        {
            "trials in corpus": land,
            "with a linked paper": land.join(links, "nct_id", "left_semi"),
            "papers in the lake": read_table(spark, sf, "part"),
            "link rows": links,
            "papers with a link": links.select("pmid").distinct(),
        }
    )


@query(
    "mix_share",
    with_ctes(*T.LANDSCAPE_CTES)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS label, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM landscape), 1) AS pct FROM landscape GROUP BY {c}"
        for c in ("phase", "status_group", "sponsor_type", "indication", "comparator_design")
    ),
)
def mix_share(spark, sf):
    """Five distributions in one pass: each row offers one label per dimension before the count."""
    dims = ["phase", "status_group", "sponsor_type", "indication", "comparator_design"]
    land = T.landscape(spark, sf)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dims])
    counts = land.select(F.inline(pairs)).groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))
    total = land.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 1))


@query(
    "mix_endpoint_section_region",
    with_ctes(T.GEO, T.OUTCOMES, T.CHUNKS)
    + """SELECT 'endpoint' AS dimension, endpoint_category AS label, CAST(count(*) AS BIGINT) AS n,
                round(100.0 * count(*) / (SELECT count(*) FROM endpoints WHERE outcome_kind = 'PRIMARY'), 1) AS pct
         FROM endpoints WHERE outcome_kind = 'PRIMARY' GROUP BY 2
         UNION ALL SELECT 'section', criterion_section, CAST(count(*) AS BIGINT), round(100.0 * count(*) / (SELECT count(*) FROM chunks), 1) FROM chunks GROUP BY 2
         UNION ALL SELECT 'region', region, CAST(count(DISTINCT nct_id) AS BIGINT),
                round(100.0 * count(DISTINCT nct_id) / (SELECT sum(n) FROM (SELECT count(DISTINCT nct_id) AS n FROM geography GROUP BY region)), 1) FROM geography GROUP BY 2""",
)
def mix_endpoint_section_region(spark, sf):
    primary = semantic.v_endpoints(T.outcomes(spark, sf).filter("outcome_kind = 'PRIMARY'"))
    parts = [
        ("endpoint", shares.with_share(shares.distribution(primary, ["endpoint_category"])), "endpoint_category"),
        ("section", shares.with_share(shares.distribution(T.chunks(spark, sf), ["criterion_section"])), "criterion_section"),
        ("region", shares.with_share(shares.distribution_distinct(semantic.v_geography(T.countries(spark, sf)), ["region"], "nct_id")), "region"),
    ]
    out = [df.select(F.lit(name).alias("dimension"), F.col(col).alias("label"), "n", "pct") for name, df, col in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "phase_by_status",
    with_ctes(*T.LANDSCAPE_CTES)
    + """SELECT phase, status_group, CAST(count(*) AS BIGINT) AS trials, CAST(count(DISTINCT lead_sponsor) AS BIGINT) AS sponsors
         FROM landscape GROUP BY 1, 2""",
)
def phase_by_status(spark, sf):
    return report.phase_by_status(T.landscape(spark, sf))


@query(
    "mix_top_countries",
    with_ctes(T.GEO)
    + """SELECT country AS label, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM countries), 1) AS pct
         FROM countries GROUP BY country ORDER BY n DESC, label LIMIT 12""",
)
def mix_top_countries(spark, sf):
    """The countries with most trials, over the whole corpus."""
    rows = shares.with_share(shares.distribution_distinct(T.countries(spark, sf), ["country"], "nct_id"))
    return rows.withColumnRenamed("country", "label").orderBy(F.desc("n"), "label").limit(12)


@query(
    "load_audit",
    with_ctes(T.CHUNKS)
    + """SELECT 'eligibility chunks' AS fact, CAST(count(*) AS BIGINT) AS n FROM chunks
         UNION ALL SELECT 'EXCLUSION', CAST(count(*) AS BIGINT) FROM chunks WHERE criterion_section = 'EXCLUSION'
         UNION ALL SELECT 'INCLUSION', CAST(count(*) AS BIGINT) FROM chunks WHERE criterion_section = 'INCLUSION'
         UNION ALL SELECT 'section unrecovered', CAST(count(*) AS BIGINT) FROM chunks WHERE criterion_section = 'UNKNOWN'""",
)
def load_audit(spark, sf):
    section = F.col("criterion_section")
    parts = {
        "eligibility chunks": F.lit(True),
        "EXCLUSION": section == "EXCLUSION",
        "INCLUSION": section == "INCLUSION",
        "section unrecovered": section == "UNKNOWN",
    }
    return shares.conditional_counts(T.chunks(spark, sf), parts)


@query(
    "corpus_consistency",
    with_ctes(*T.LANDSCAPE_CTES)
    + """SELECT 'trials in the search corpus' AS fact, CAST(count(*) AS BIGINT) AS n FROM trials
         UNION ALL SELECT 'trials on the global board', CAST(count(*) AS BIGINT) FROM landscape""",
)
def corpus_consistency(spark, sf):
    board = boards.board_global(T.landscape(spark, sf), T.chunks(spark, sf), T.trials(spark, sf), T.countries(spark, sf))
    return shares.labelled_counts({"trials in the search corpus": T.trials(spark, sf), "trials on the global board": board})


@query(
    "most_common_match",
    with_ctes(T.INTERVENTIONS)
    + """SELECT word, intervention_name, CAST(n AS BIGINT) AS trials FROM (
           SELECT word, intervention_name, count(DISTINCT nct_id) AS n,
                  row_number() OVER (PARTITION BY word ORDER BY count(DISTINCT nct_id) DESC, intervention_name) AS rn
           FROM interventions JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part) w
             ON upper(intervention_name) LIKE '%' || upper(word) || '%' GROUP BY 1, 2) WHERE rn = 1""",
)
def most_common_match(spark, sf):
    words = read_table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return report.most_common_match(T.interventions(spark, sf), words)


@query(
    "data_checks",
    with_ctes(T.TRIALS)
    + """SELECT 'trials loaded' AS "check", count(*) > 0 AS passed, CAST(count(*) AS DOUBLE) AS observed FROM trials
         UNION ALL SELECT 'vectors have 64 dimensions', count(*) FILTER (len(embedding) <> 64) = 0, CAST(count(*) FILTER (len(embedding) <> 64) AS DOUBLE) FROM embeddings
         UNION ALL SELECT 'vector norms are 1', count(*) = 0, CAST(count(*) AS DOUBLE)
           FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l2 FROM embeddings) WHERE abs(l2 - 1) > 0.0001
         UNION ALL SELECT 'links join trials', count(*) > 0, CAST(count(*) AS DOUBLE) FROM trials WHERE nct_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def data_checks(spark, sf):
    seen = F.col("observed")
    emb = read_table(spark, sf, "embeddings")
    trials = T.trials(spark, sf)
    return shares.checks(
        spark,
        [
            ("trials loaded", trials, F.count(F.lit(1)), seen > 0),
            ("vectors have 64 dimensions", emb, F.count_if(F.size("embedding") != 64), seen == 0),
            ("vector norms are 1", emb, F.count_if(F.abs(l2_norm(F.col("embedding")) - 1) > 0.0001), seen == 0),
            ("links join trials", trials.join(T.links(spark, sf), "nct_id", "left_semi"), F.count(F.lit(1)), seen > 0),
        ],
    )
