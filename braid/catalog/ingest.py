"""Ingestion queries: studies shredded from JSON, articles from XML, file round trips, the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog.base import query, with_ctes
from braid.functions.chunks import BULLET, HEADING, INLINE, chunk_rows
from braid.plans import runlog
from braid.session import read_table, run_dir, spread, table_version
from braid.sources import articles, files, registry

_PHASES = ["", "NA", "PHASE1", "PHASE2", "PHASE3|PHASE2", "EARLY_PHASE1"]
_TYPES = ["EXPERIMENTAL", "ACTIVE_COMPARATOR", "", "PLACEBO_COMPARATOR"]
_AGES = ["18 Years", "6 Months", "N/A", "2 weeks"]


def _choose(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def eligibility(text):
    """Prose with headings, bullets and wrapped lines made from a whole document text."""
    return F.concat(
        F.lit("Inclusion criteria:\n- "),
        F.replace(text, F.lit(". "), F.lit(".\n- ")),
        F.lit("\nNotes. Key Exclusion Criteria: "),
        F.replace(text, F.lit(", "), F.lit("\n")),
    )


def raw_studies(spark, sf):
    """One JSON study per document, built inside the document's row."""
    doc = spread(read_table(spark, sf, "documents"))
    n, text = F.col("n_chars"), F.col("text")
    lines = F.split(text, "\n", -1)
    phase = _choose(_PHASES, n)
    study = F.struct(
        F.struct(
            F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("nctId"), F.col("source").alias("briefTitle")).alias("identificationModule"),
            F.struct(F.lit("COMPLETED").alias("overallStatus"), F.struct(F.lit("2021-05").alias("date")).alias("startDateStruct")).alias("statusModule"),
            F.struct(
                F.lit("INTERVENTIONAL").alias("studyType"),
                F.when(phase != "", F.split(phase, r"\|")).alias("phases"),
                F.struct(F.when(n % 7 != 0, n).alias("count")).alias("enrollmentInfo"),
            ).alias("designModule"),
            F.struct(F.struct(F.col("source").alias("name"), F.lit("INDUSTRY").alias("class")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
            F.struct(eligibility(text).alias("eligibilityCriteria"), _choose(_AGES, n).alias("minimumAge")).alias("eligibilityModule"),
            F.struct(F.array("lang", "source").alias("conditions")).alias("conditionsModule"),
            F.struct(
                F.transform(lines, lambda x: F.struct(x.alias("measure"), F.lit("1 year").alias("timeFrame"))).alias("primaryOutcomes"),
                F.transform(F.split(text, "[.] ", -1), lambda x: F.struct(x.alias("measure"))).alias("secondaryOutcomes"),
            ).alias("outcomesModule"),
            F.struct(
                F.transform(lines, lambda x: F.struct(_choose(_TYPES, F.length(x)).alias("type"), x.alias("label"))).alias("armGroups"),
                F.transform(lines, lambda x: F.struct(F.lit("DRUG").alias("type"), F.split_part(x, F.lit(" "), F.lit(1)).alias("name"))).alias("interventions"),
            ).alias("armsInterventionsModule"),
            F.struct(
                F.transform(F.array("lang", "source", "lang"), lambda x: F.struct(x.alias("country"))).alias("locations")
            ).alias("contactsLocationsModule"),
        ).alias("protocolSection"),
        F.upper("lang").alias("_indication"),
    )
    return doc.select(F.to_json(study).alias("json"))


_LANDED: dict[tuple[str, str], str] = {}
LANDED_RECORDS = 10_000


def studies(spark, sf):
    """The snapshot written as JSON lines, read back and landed as parquet, anew when the documents have changed."""
    name = (spark.sparkContext.applicationId, table_version(spark, sf, "documents"))
    if name not in _LANDED:
        root = run_dir(spark, "snapshot")
        # A study repeats its document's text five times. A compressed file is read by one task, so files are kept small.
        raw_studies(spark, sf).write.option("maxRecordsPerFile", LANDED_RECORDS).text(f"{root}/lines", compression="gzip")
        files.write_parquet(registry.read_lines(spark, f"{root}/lines"), f"{root}/studies")
        _LANDED[name] = f"{root}/studies"
    return spark.read.parquet(_LANDED[name])


_ID = "'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"
_LINES = f"lines AS (SELECT {_ID} AS nct_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"


@query(
    "shred_trials",
    f"""SELECT {_ID} AS nct_id, upper(lang) AS indication, source AS brief_title,
               CASE n_chars % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'PHASE1' WHEN 3 THEN 'PHASE2'
                    WHEN 4 THEN 'PHASE2/3' ELSE 'EARLY_PHASE1' END AS phase,
               CASE n_chars % 6 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'PHASE1' WHEN 3 THEN 'PHASE2' WHEN 4 THEN 'PHASE3|PHASE2'
                    ELSE 'EARLY_PHASE1' END AS phase_raw,
               CASE WHEN n_chars % 7 <> 0 THEN n_chars END AS enrollment,
               CASE n_chars % 4 WHEN 0 THEN 18.0 WHEN 1 THEN 0.5 WHEN 3 THEN 0.038 END AS min_age_years,
               CAST(length('Inclusion criteria:' || chr(10) || '- ' || replace(text, '. ', '.' || chr(10) || '- ') || chr(10) || 'Notes. Key Exclusion Criteria: '
                 || replace(text, ', ', chr(10))) AS BIGINT) AS elig_chars
        FROM documents""",
)
def shred_trials(spark, sf):
    return registry.trials(studies(spark, sf)).select(
        "nct_id", "indication", "brief_title", "phase", "phase_raw", "enrollment", "min_age_years", "elig_chars"
    )


@query(
    "shred_conditions_countries",
    f"""SELECT {_ID} AS nct_id, 'condition' AS kind, unnest([lang, source]) AS value FROM documents
        UNION ALL SELECT {_ID}, 'country', unnest([lang, source]) FROM documents""",
)
def shred_conditions_countries(spark, sf):
    s = studies(spark, sf)
    a = registry.conditions(s).select("nct_id", F.lit("condition").alias("kind"), F.col("condition_name").alias("value"))
    return a.unionByName(registry.countries(s).select("nct_id", F.lit("country").alias("kind"), F.col("country").alias("value")))


@query(
    "shred_outcomes",
    f"""SELECT {_ID} AS nct_id, 'PRIMARY' AS outcome_kind, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq,
               unnest(string_split(text, chr(10))) AS measure, '1 year' AS time_frame FROM documents
        UNION ALL SELECT {_ID}, 'SECONDARY', CAST(generate_subscripts(string_split(text, '. '), 1) - 1 AS INTEGER), unnest(string_split(text, '. ')), NULL FROM documents""",
)
def shred_outcomes(spark, sf):
    return registry.outcomes(studies(spark, sf))


@query(
    "shred_arms_interventions",
    with_ctes(_LINES)
    + """SELECT nct_id, CAST(seq AS INTEGER) AS seq,
                CASE length(line) % 4 WHEN 0 THEN 'EXPERIMENTAL' WHEN 1 THEN 'ACTIVE_COMPARATOR' WHEN 2 THEN 'UNSPECIFIED' ELSE 'PLACEBO_COMPARATOR' END AS arm_type,
                line AS arm_label, split_part(line, ' ', 1) AS intervention_name FROM lines""",
)
def shred_arms_interventions(spark, sf):
    s = studies(spark, sf)
    return registry.arms(s).join(registry.interventions(s).drop("intervention_type"), ["nct_id", "seq"])


# The chunker once more as windows over lines: a second way to the same chunks.
_RE_HEAD, _RE_INLINE, _RE_BULLET = (p.replace("(?iuU)", "(?i)") for p in (HEADING, INLINE, BULLET))
CHUNK_CTES = (
    f"""elig AS (SELECT doc_id, regexp_replace('Inclusion criteria:' || chr(10) || '- ' || replace(text, '. ', '.' || chr(10) || '- ')
        || chr(10) || 'Notes. Key Exclusion Criteria: ' || replace(text, ', ', chr(10)), '{_RE_INLINE}', chr(10) || '\\1 Criteria:' || chr(10), 'g') AS t FROM documents)""",
    "elines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM elig)",
    f"""emarked AS (SELECT *, regexp_matches(line, '{_RE_HEAD}') AS is_head,
        CASE WHEN regexp_matches(line, '{_RE_HEAD}') THEN upper(regexp_extract(line, '{_RE_HEAD}', 1)) END AS head,
        regexp_matches(line, '{_RE_BULLET}') AS is_bullet FROM elines WHERE regexp_matches(line, '\\S'))""",
    """egrouped AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, 'UNKNOWN') AS criterion_section,
        sum(CASE WHEN is_head OR is_bullet THEN 1 ELSE 0 END) OVER w AS g FROM emarked WINDOW w AS (PARTITION BY doc_id ORDER BY pos))""",
    f"""ejoined AS (SELECT doc_id, g, any_value(criterion_section) AS criterion_section,
        trim(regexp_replace(string_agg(regexp_replace(line, '{_RE_BULLET}', ''), ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS chunk_text
        FROM egrouped WHERE NOT is_head GROUP BY doc_id, g)""",
    """echunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS chunk_id, criterion_section, chunk_text
        FROM ejoined WHERE length(chunk_text) >= 15)""",
)


def document_chunks(spark, sf):
    docs = spread(read_table(spark, sf, "documents")).select("doc_id", eligibility(F.col("text")).alias("elig"))
    return chunk_rows(docs, "doc_id", "elig")


@query("chunk_sections", with_ctes(*CHUNK_CTES) + "SELECT * FROM echunks")
def chunk_sections(spark, sf):
    return document_chunks(spark, sf)


@query(
    "shred_metrics",
    with_ctes(*CHUNK_CTES)
    + """SELECT (SELECT count(*) FROM documents) AS trials, CAST(count(*) AS BIGINT) AS chunks,
                CAST(count(*) FILTER (criterion_section = 'INCLUSION') AS BIGINT) AS incl, CAST(count(*) FILTER (criterion_section = 'EXCLUSION') AS BIGINT) AS excl,
                CAST(count(*) FILTER (criterion_section = 'UNKNOWN') AS BIGINT) AS unk,
                (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM echunks)) AS no_elig FROM echunks""",
)
def shred_metrics(spark, sf):
    return registry.metrics(studies(spark, sf))


# Keys up to which studies meet them without a shuffle of their texts.
BROADCAST_KEYS = 1_000_000


def _labelled(spark, sf, whole):
    ids = read_table(spark, sf, "labels").select(F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id")).distinct()
    few = ids.count() <= BROADCAST_KEYS
    return whole.join(F.broadcast(ids) if few else ids, registry.study_key() == ids["id"], "left_semi")


@query(
    "snapshot_union_first_wins",
    f"""SELECT nct_id, indication FROM (
          SELECT {_ID} AS nct_id, 'LABELLED' AS indication FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
          UNION ALL SELECT {_ID}, 'ALL' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""",
)
def snapshot_union_first_wins(spark, sf):
    whole = studies(spark, sf)
    labelled = _labelled(spark, sf, whole)
    union = registry.union_snapshots([("LABELLED", labelled), ("ALL", whole)])
    return union.select(registry.study_key().alias("nct_id"), F.col("_indication").alias("indication"))


@query(
    "snapshot_clashes",
    """SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS trials,
              (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS cross_listed_dropped""",
)
def snapshot_clashes(spark, sf):
    whole = studies(spark, sf)
    ids = read_table(spark, sf, "labels").select(F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"))
    labelled = whole.join(ids, registry.study_key() == ids["id"], "left_semi")
    return registry.clashes([("LABELLED", labelled), ("ALL", whole)])


@query("parse_json_column", f"SELECT {_ID} AS nct_id, upper(lang) AS indication FROM documents")
def parse_json_column(spark, sf):
    """Studies parsed straight from a string column."""
    parsed = registry.parse(raw_studies(spark, sf), "json")
    return parsed.select(registry.study_key().alias("nct_id"), F.col("_indication").alias("indication"))


# ------------------------------------------------------------------ articles


def raw_articles(spark, sf):
    """One article element per part; its sold lines name the trials it reports."""
    safe = F.regexp_replace(F.regexp_replace("p_name", "&", "&amp;"), "<", "&lt;")
    odd = F.col("p_size") % 2 == 1
    year = (F.col("p_size") + 1970).cast("string")

    def tag(name, *body):
        return F.concat(F.lit(f"<{name}>"), *body, F.lit(f"</{name}>"))

    date = F.when(odd, tag("Year", year)).otherwise(tag("MedlineDate", year, F.lit(" Jan-Feb")))
    bank = F.when(
        F.col("p_size") % 3 != 0,
        F.concat(
            F.lit("<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList>"),
            tag("AccessionNumber", F.lit("nct"), F.col("p_partkey").cast("string")),
            tag("AccessionNumber", F.lit("NCT"), F.col("p_size").cast("string")),
            tag("AccessionNumber", F.lit("ISRCTN"), F.col("p_size").cast("string")),
            F.lit("</AccessionNumberList></DataBank></DataBankList>"),
        ),
    ).otherwise(F.lit(""))
    article = F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"),
        tag("PMID", F.col("p_partkey").cast("string")),
        F.lit("<Article><Journal>"),
        F.when(odd, tag("ISOAbbreviation", "p_brand")).otherwise(F.lit("")),
        F.lit("<JournalIssue>"), tag("PubDate", date), F.lit("</JournalIssue>"),
        tag("Title", F.lit("Journal of "), "p_type"),
        F.lit("</Journal>"),
        tag("ArticleTitle", F.lit("On <i>"), safe, F.lit("</i> trials")),
        F.lit("<Abstract>"), tag("AbstractText", safe), tag("AbstractText", "p_brand"), F.lit("</Abstract>"),
        F.lit("<PublicationTypeList>"), tag("PublicationType", "p_type"), tag("PublicationType", F.lit("Article")),
        tag("PublicationType", F.lit("Article")), F.lit("</PublicationTypeList>"),
        bank,
        F.lit("</Article></MedlineCitation><PubmedData><ArticleIdList>"),
        F.lit('<ArticleId IdType="pubmed">'), F.col("p_partkey").cast("string"), F.lit('</ArticleId><ArticleId IdType="doi">10.1/'),
        F.col("p_partkey").cast("string"),
        F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    return read_table(spark, sf, "part").select(article.alias("xml"))


def flat_articles(spark, sf):
    return articles.flatten(articles.parse(raw_articles(spark, sf), "xml"))


_FLAT = """flat AS (
  SELECT CAST(p_partkey AS VARCHAR) AS pmid, '10.1/' || CAST(p_partkey AS VARCHAR) AS doi, 'On ' || p_name || ' trials' AS title,
         CASE WHEN p_size % 2 = 1 THEN p_brand ELSE 'Journal of ' || p_type END AS journal, CAST(p_size + 1970 AS INTEGER) AS pub_year,
         CASE WHEN p_type < 'Article' THEN p_type || '|Article' ELSE 'Article|' || p_type END AS pub_types, p_name || ' ' || p_brand AS abstract,
         CASE WHEN p_size % 3 <> 0 THEN list_sort(list_distinct(['NCT' || CAST(p_partkey AS VARCHAR), 'NCT' || CAST(p_size AS VARCHAR)])) ELSE [] END AS nct_ids
  FROM part)"""


@query("articles_flatten", with_ctes(_FLAT) + "SELECT * EXCLUDE (nct_ids), array_to_string(nct_ids, ' ') AS cited FROM flat")
def articles_flatten(spark, sf):
    flat = flat_articles(spark, sf)
    cited = flat.select("pmid", F.array_join("nct_ids", " ").alias("cited"))
    return articles.publications(flat).join(cited, "pmid")


@query("article_links", with_ctes(_FLAT) + "SELECT unnest(nct_ids) AS nct_id, pmid FROM flat")
def article_links(spark, sf):
    return articles.links(articles.citing(flat_articles(spark, sf)))


@query(
    "linkage_rate",
    with_ctes(_FLAT, "cited AS (SELECT DISTINCT unnest(nct_ids) AS nct_id FROM flat)", "scope AS (SELECT DISTINCT 'NCT' || CAST(o_custkey AS VARCHAR) AS nct_id FROM orders)")
    + """SELECT CAST(count(*) AS BIGINT) AS trials, CAST(count(c.nct_id) AS BIGINT) AS linked, round(100.0 * count(c.nct_id) / count(*), 1) AS pct
         FROM scope s LEFT JOIN cited c ON c.nct_id = s.nct_id""",
)
def linkage_rate(spark, sf):
    trials = read_table(spark, sf, "orders").select(F.concat(F.lit("NCT"), F.col("o_custkey").cast("string")).alias("nct_id"))
    return articles.linkage_rate(articles.citing(flat_articles(spark, sf)), trials)


# --------------------------------------------------------------- round trips


@query("csv_roundtrip", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, sf):
    """Whole texts with line breaks through delimited text and back."""
    docs = spread(read_table(spark, sf, "documents"))
    path = run_dir(spark, "csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema, multi_line=True)


@query("refresh_current", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def refresh_current(spark, sf):
    """Two full refreshes; readers see the newer one."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root = run_dir(spark, "refresh")
    files.refresh(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), root, 1)
    files.refresh(orders, root, 2)
    return files.current(spark, root)


@query(
    "lake_join",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT l_partkey) AS BIGINT) AS papers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def lake_join(spark, sf):
    """A table written to the second tier, joined in place with a table of the first."""
    path = run_dir(spark, "lake")
    files.write_parquet(read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), path)
    lake = spark.read.parquet(path)
    orders = read_table(spark, sf, "orders")
    joined = orders.join(lake, orders["o_orderkey"] == lake["l_orderkey"])
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_partkey").alias("papers"))


def run_log(spark, sf):
    """Events written as run records, those of type error cut short, read back."""
    ev = read_table(spark, sf, "events")
    ms = F.round(F.col("value") * 10, 1)
    record = F.to_json(
        F.struct(
            F.lit("event").alias("kind"),
            F.col("event_type").alias("label"),
            F.col("event_id").cast("string").alias("txn_id"),
            ms.alias("total_ms"),
            F.round(F.col("value"), 1).alias("analytics_ms"),
            F.create_map(F.lit("kafka"), F.round(F.col("value"), 1), F.lit("score"), ms).alias("hops"),
        )
    )
    line = F.when(F.col("event_type") == "error", F.substring(record, 1, 25)).otherwise(record)
    path = run_dir(spark, "runs")
    ev.select(line.alias("value")).write.mode("append").text(path)
    return files.read_runs(spark, path)


_RUNS = """runs AS (SELECT event_type, nullif(round(value * 10, 1), 0) AS total_ms, nullif(round(value, 1), 0) AS analytics_ms,
  round(value, 1) AS kafka, round(value * 10, 1) AS score FROM events WHERE event_type <> 'error')"""


@query(
    "run_log_summary",
    with_ctes(_RUNS, "ranked AS (SELECT total_ms, row_number() OVER (ORDER BY total_ms) - 1 AS rn FROM runs WHERE total_ms IS NOT NULL)")
    + """SELECT CAST(count(*) AS BIGINT) AS runs, min(total_ms) AS min_ms, max(total_ms) AS max_ms, round(avg(total_ms), 6) AS mean_ms,
                round(avg(analytics_ms), 6) AS mean_analytics_ms,
                (SELECT total_ms FROM ranked WHERE rn = (SELECT count(total_ms) // 2 FROM runs)) AS median_ms FROM runs""",
)
def run_log_summary(spark, sf):
    out = runlog.latency_summary(run_log(spark, sf))
    return out.withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("mean_analytics_ms", F.round("mean_analytics_ms", 6))


@query(
    "run_log_hops",
    with_ctes(_RUNS)
    + """SELECT 'kafka' AS hop, CAST(count(*) AS BIGINT) AS runs, round(avg(kafka), 6) AS mean_ms FROM runs
         UNION ALL SELECT 'score', CAST(count(*) AS BIGINT), round(avg(score), 6) FROM runs""",
)
def run_log_hops(spark, sf):
    return runlog.hop_means(run_log(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))
