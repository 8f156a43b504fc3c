import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from braid.functions import scalars as S
from braid.functions.chunks import chunk_rows
from braid.plans import boards, report, resolution, semantic
from braid.session import read_table
from braid.sources import articles, files, registry


def one(spark, fn, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "codes, want",
    [
        (None, "UNKNOWN"), ([], "UNKNOWN"), (["NA"], "NOT_APPLICABLE"), (["PHASE3", "PHASE2"], "PHASE2/3"), (["EARLY_PHASE1"], "EARLY_PHASE1"),
        (["PHASE1", "PHASE1"], "PHASE1"), (["NA", "PHASE2"], "PHASE2"), (["A", "B"], "A|B"),
    ],
)
def test_phase(spark, codes, want):
    assert one(spark, S.phase, codes, kinds=["array<string>"]) == want


@pytest.mark.parametrize("text, want", [("18 Years", 18.0), ("6 Months", 0.5), ("2 weeks", 0.038), ("1.5 year", 1.5), ("N/A", None), (None, None), ("", None)])
def test_age(spark, text, want):
    assert one(spark, S.age_years, text) == want


MEASURES = {
    "Overall Survival": "Overall survival",
    "median OS": "Overall survival",
    "PFS by RECIST": "Progression-free survival",
    "Invasive disease-free survival": "Disease/event-free survival",
    "pathological complete response": "Pathological complete response",
    "Duration of response": "Duration of response",
    "DCR at week 12": "Disease control rate",
    "local control at 2 years": "Relapse / local control",
    "Dose limiting toxicity": "Dose finding (DLT/MTD)",
    "Incidence of adverse events": "Safety / tolerability",
    "Cmax of drug": "Pharmacokinetics",
    "EORTC QLQ-C30": "Quality of life",
    "Fatigue score": "Patient-reported / behavioural",
    "Change on MRI": "Imaging / detection",
    "Positive margin": "Surgical / procedural",
    "Circulating DNA": "Biomarker / laboratory",
    "Accrual": "Feasibility / uptake",
    "Clinical response": "Objective response rate",
    "Number of visits": "Other / unclassified",
    "posture": "Other / unclassified",
}


def test_every_endpoint_class_and_the_order_of_rules(spark):
    df = spark.createDataFrame(list(MEASURES.items()), "measure string, want string")
    got = df.withColumn("got", S.endpoint_category(F.col("measure"))).collect()
    assert [(r["measure"], r["got"]) for r in got if r["got"] != r["want"]] == []
    assert len(set(MEASURES.values())) == 18


def test_sponsors_regions_and_bands(spark):
    for name, want in [
        ("Merck KGaA, Darmstadt", "Merck KGaA (Darmstadt)"), ("Merck Sharp & Dohme LLC", "Merck & Co."), ("Merck & Co., Inc.", "Merck & Co."),
        ("X, a wholly owned subsidiary of Pfizer", "Pfizer"), ("Genentech, a Subsidiary of Roche ", "Roche"), ("Plain Co", "Plain Co"),
    ]:
        assert one(spark, S.sponsor_group, name) == want
    for country, want in [("South Korea", "Asia-Pacific"), ("Turkey (Türkiye)", "Middle East / North Africa"), ("Viet Nam", "Other / unmapped")]:
        assert one(spark, S.region, country) == want
    for n, want in [(None, "1 · Light"), (13, "1 · Light"), (14, "2 · Moderate"), (25, "3 · High"), (40, "4 · Very high")]:
        assert one(spark, S.screening_burden, n, kinds=["int"]) == want
    for d, want in [("2021", 2021), ("2021-05", 2021), ("2021-05-03", 2021), ("", None), (None, None), ("soon", None)]:
        assert one(spark, S.start_year, d) == want
    assert one(spark, S.phase_is_stated, "NOT_APPLICABLE") is True and one(spark, S.phase_is_numbered, "NOT_APPLICABLE") is False


# Texts with the criteria written out by hand: (section, criterion) in order.
CHUNKED = [
    ("Inclusion Criteria:\n- Age at least 18 years old\n- Signed informed consent\nExclusion Criteria:\n- No prior systemic therapy", [
        ("INCLUSION", "Age at least 18 years old"), ("INCLUSION", "Signed informed consent"), ("EXCLUSION", "No prior systemic therapy"),
    ]),
    ("EXCLUSION CRITERIA\n* pregnant or breastfeeding women", [("EXCLUSION", "pregnant or breastfeeding women")]),
    ("Key Inclusion Criteria -\n1. Measurable disease present\n(2) Adequate organ function", [
        ("INCLUSION", "Measurable disease present"), ("INCLUSION", "Adequate organ function"),
    ]),
    ("  Patient exclusion:\na. Known brain metastases", [("EXCLUSION", "Known brain metastases")]),
    ("- a criterion before any heading\nInclusion:\n• Élan vital reasonable here\n– a dash of another kind", [
        ("UNKNOWN", "a criterion before any heading"), ("INCLUSION", "Élan vital reasonable here"), ("INCLUSION", "a dash of another kind"),
    ]),
    ("Inclusion Criteria:\n- a criterion that is\ncontinued on the next line\n\n  and on a third", [
        ("INCLUSION", "a criterion that is continued on the next line and on a third"),
    ]),
    ("Adults only, see below. Main Exclusion Criteria: pregnant women or infants", [
        ("UNKNOWN", "Adults only, see below."), ("EXCLUSION", "pregnant women or infants"),
    ]),
    ("- too short\n- N/A\n- this one is long enough", [("UNKNOWN", "this one is long enough")]),
    ("\tTabbed  text   with gaps\n", [("UNKNOWN", "Tabbed text with gaps")]),
    ("plain prose without any bullet at all", [("UNKNOWN", "plain prose without any bullet at all")]),
    ("exactly fifteen", [("UNKNOWN", "exactly fifteen")]),
    ("fourteen signs", []),
    ("", []),
    (None, []),
    ("Inclusion Criteria:\nExclusion Criteria:\n", []),
]


def test_chunks_written_out_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHUNKED)], "id int, text string")
    got = {i: [] for i in range(len(CHUNKED))}
    for r in chunk_rows(df, "id", "text").orderBy("id", "chunk_id").collect():
        assert r["chunk_id"] == len(got[r["id"]])
        got[r["id"]].append((r["criterion_section"], r["chunk_text"]))
    assert {i: (CHUNKED[i][0], c) for i, c in got.items()} == dict(enumerate(CHUNKED))


LINES = ["- Age at least 18 years old", "* ECOG 0 or 1 at entry", "plain prose that goes on", "", "  ", "(2) No prior systemic therapy", "short"]


def test_chunk_properties(spark):
    """Sections begin at headings only, criteria keep their order and words, bullets go, short ones are left out."""
    rnd = random.Random(11)
    texts = []
    for _ in range(200):
        before, after = ([rnd.choice(LINES) for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        texts.append((before, after, "\n".join([*before, "Exclusion Criteria:", *after])))
    df = spark.createDataFrame([(i, t[2]) for i, t in enumerate(texts)], "id int, text string")
    by_text = {}
    for r in chunk_rows(df, "id", "text").orderBy("id", "chunk_id").collect():
        by_text.setdefault(r["id"], []).append((r["criterion_section"], r["chunk_text"]))
    for i, (before, after, _) in enumerate(texts):
        found = by_text.get(i, [])
        sections = [s for s, _ in found]
        assert sections == sorted(sections, key=["UNKNOWN", "EXCLUSION"].index)
        assert all(len(c) >= 15 and c == " ".join(c.split()) and c[0] not in "-*(" for _, c in found)
        for section, lines in (("UNKNOWN", before), ("EXCLUSION", after)):
            said = " ".join(c for s, c in found if s == section).split()
            source = iter(" ".join(lines).split())
            assert all(word in source for word in said)
            assert sum(x.startswith(("- A", "* E", "(2)")) for x in lines) <= len([s for s, _ in found if s == section])


def test_private_characters_stay_in_a_criterion(spark):
    text = "one criterion \ue000 still \ue001 the same S line C"
    df = spark.createDataFrame([(1, "- " + text)], "id int, text string")
    assert [r["chunk_text"] for r in chunk_rows(df, "id", "text").collect()] == [text]


def study(nct, **over):
    body = {
        "identificationModule": {"nctId": nct, "briefTitle": "T"},
        "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-01"}},
        "designModule": {"studyType": "INTERVENTIONAL", "phases": ["PHASE3"], "enrollmentInfo": {"count": 100}},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "S", "class": "INDUSTRY"}},
        "eligibilityModule": {"eligibilityCriteria": "Inclusion Criteria:\n- Adults with measurable disease", "minimumAge": "18 Years"},
        "conditionsModule": {"conditions": ["c1", "c2"]},
        "outcomesModule": {"primaryOutcomes": [{"measure": "OS", "timeFrame": "2y"}], "secondaryOutcomes": [{"measure": "PFS"}, {"measure": "ORR"}]},
        "armsInterventionsModule": {"armGroups": [{"type": "EXPERIMENTAL", "label": "a"}, {"label": "b"}], "interventions": [{"type": "DRUG", "name": "Keytruda"}]},
        "contactsLocationsModule": {"locations": [{"country": "France"}, {"country": "France"}, {"country": "United States"}, {}]},
    }
    body.update(over)
    return {"protocolSection": body}


@pytest.fixture(scope="module")
def studies(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshot")
    empty = {k: {} for k in study("x")["protocolSection"] if k != "identificationModule"}
    rows = [study("NCT1"), study("NCT2", **empty), study(None), study("NCT3", eligibilityModule={"eligibilityCriteria": "short"})]
    lines = root / "studies.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf8")
    whole = root / "snapshot.json.gz"
    with gzip.open(whole, "wt", encoding="utf8") as f:
        json.dump({"_meta": {"trials": 4}, "studies": rows}, f, indent=1)
    return registry.read_lines(spark, str(lines)), registry.read_document(spark, str(whole))


def test_both_forms_of_a_snapshot_give_the_same_tables(studies):
    lines, document = (registry.shred(s) for s in studies)
    for name in lines:
        assert sorted(map(str, lines[name].collect())) == sorted(map(str, document[name].collect()))
    assert lines["trials"].count() == 3
    assert sorted(r["country"] for r in lines["trial_countries"].filter("nct_id = 'NCT1'").collect()) == ["France", "United States"]
    assert [r["arm_type"] for r in lines["trial_arms"].filter("nct_id = 'NCT1'").orderBy("seq").collect()] == ["EXPERIMENTAL", "UNSPECIFIED"]
    outcomes = lines["trial_outcomes"].filter("nct_id = 'NCT1'").orderBy("outcome_kind", "seq").collect()
    assert [(r["outcome_kind"], r["seq"]) for r in outcomes] == [("PRIMARY", 0), ("SECONDARY", 0), ("SECONDARY", 1)]
    bare = lines["trials"].filter("nct_id = 'NCT2'").first()
    assert (bare["phase"], bare["elig_chars"], bare["enrollment"], bare["min_age_years"]) == ("UNKNOWN", 0, None, None)


def test_metrics(studies):
    want = {"trials": 3, "chunks": 1, "incl": 1, "excl": 0, "unk": 0, "no_elig": 2}
    assert registry.metrics(studies[0]).first().asDict() == want


def test_first_snapshot_wins_and_clashes_are_counted(spark, studies):
    sources = [("NSCLC", studies[0].filter("protocolSection.identificationModule.nctId = 'NCT1'").drop("_indication")), ("BREAST", studies[0].drop("_indication"))]
    union = registry.union_snapshots(sources)
    got = {r["nct_id"]: r["indication"] for r in registry.trials(union).collect()}
    assert got == {"NCT1": "NSCLC", "NCT2": "BREAST", "NCT3": "BREAST"}
    assert registry.clashes(sources).first().asDict() == {"trials": 3, "cross_listed_dropped": 1}


def test_a_union_ranks_the_fields_that_are_read(studies):
    union = registry.union_snapshots([("A", studies[0].drop("_indication")), ("B", studies[0].drop("_indication"))])
    slim = union.select(registry.study_key().alias("nct_id"), F.col("_indication").alias("indication"))
    assert sorted(map(tuple, slim.collect())) == [("NCT1", "A"), ("NCT2", "A"), ("NCT3", "A")]
    plan = slim._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Union")].splitlines()
    assert any("Window" in line for line in above) and not any("protocolSection#" in line for line in above)


def test_scopes_meet_a_trial_once_with_its_countries_and_drugs(spark):
    resolved = spark.createDataFrame([(1, "X", "PHASE1"), (2, "X", "PHASE2"), (3, None, "PHASE1"), (None, "X", "PHASE1")], "nct_id long, indication string, phase string")
    countries = spark.createDataFrame([(1, "France"), (1, "France"), (1, "Peru"), (2, "Peru"), (3, None)], "nct_id long, country string")
    interventions = spark.createDataFrame([(1, "Alphamab 5 mg"), (2, "Betamab"), (2, "other alphamab"), (3, None)], "nct_id long, intervention_name string")
    aliases = spark.createDataFrame([("betamab", "Alphamab", "brand")], "alias string, canonical string, alias_kind string")
    scopes = spark.createDataFrame(
        [(0, None, None, None, None, None), (1, "X", None, "Peru", None, None), (2, None, "PHASE1", "France", "alphamab", False), (3, None, None, None, "alphamab", False), (4, "Y", None, None, None, None)],
        "question int, indication string, phase string, country string, drug string, drug_resolved boolean",
    )
    out = report.in_scopes(report.Layer(resolved, countries, interventions, None, aliases), scopes)
    got = sorted((r["question"], r["nct_id"] or 0) for r in out.collect())
    assert got == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    # Countries and drugs are met before a trial is repeated for its scopes.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") >= 2 and "LeftOuter, ((nct_id" not in plan


ARTICLES = """<Set>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><ISOAbbreviation>J Onc</ISOAbbreviation><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue><Title>Journal of Oncology</Title></Journal>
<ArticleTitle>Effect of <i>drug</i> X</ArticleTitle><Abstract><AbstractText Label="A">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType><PublicationType>Article</PublicationType><PublicationType>Review</PublicationType></PublicationTypeList>
<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>nct2</AccessionNumber><AccessionNumber>NCT1</AccessionNumber><AccessionNumber>NCT1</AccessionNumber></AccessionNumberList></DataBank>
<DataBank><DataBankName>GENBANK</DataBankName><AccessionNumberList><AccessionNumber>NCT9</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
<ArticleDate><Year>2018</Year></ArticleDate></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2015 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>Other</Title></Journal><ArticleTitle>Y</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>Spring</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Z</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</Set>"""


def test_articles(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(ARTICLES, encoding="utf8")
    flat = articles.flatten(articles.read_xml(spark, str(path)))
    rows = {r["pmid"]: r for r in flat.collect()}
    a = rows["11"]
    assert (a["title"], a["journal"], a["pub_year"], a["doi"], a["abstract"]) == ("Effect of drug X", "J Onc", "2018", "10.1/x", "One. Two.")
    assert a["pub_types"] == ["Article", "Review"] and a["nct_ids"] == ["NCT1", "NCT2"]
    assert (rows["12"]["pub_year"], rows["12"]["journal"], rows["12"]["nct_ids"]) == ("2015", "Other", [])
    assert rows["13"]["pub_year"] == ""
    kept = articles.citing(flat)
    assert kept.count() == 1 and articles.links(kept).count() == 2
    assert articles.publications(flat).filter("pmid = '13'").first()["pub_year"] is None
    scope = spark.createDataFrame([("NCT1",), ("NCT3",), ("NCT3",), ("NCT4",)], "nct_id string")
    assert articles.linkage_rate(kept, scope).first().asDict() == {"trials": 3, "linked": 1, "pct": 33.3}


def test_delimited_text_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nsecond line'), (2, None), (3, "plain")], "id int, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), df.schema, multi_line=True)
    assert sorted(back.collect()) == sorted(df.collect())


def test_refresh_keeps_the_newest_version(spark, tmp_path):
    root = str(tmp_path / "t")
    files.refresh(spark.createDataFrame([(1,)], "x int"), root, 1)
    files.refresh(spark.createDataFrame([(2,), (3,)], "x int"), root, 10)
    assert sorted(r["x"] for r in files.current(spark, root).collect()) == [2, 3]


# --------------------------------------------------------------------- views


@pytest.fixture(scope="module")
def layer(spark):
    trials = spark.createDataFrame(
        [(1, "NSCLC", "t1", "Genentech, a subsidiary of Roche", "INDUSTRY", "PHASE3", "COMPLETED", 100, "2020"),
         (2, "NSCLC", "t2", "Roche", "INDUSTRY", "UNKNOWN", "COMPLETED", None, ""),
         (3, "BREAST", "t3", "Clinic", "OTHER", "NOT_APPLICABLE", "RECRUITING", 1_000_000, "2021-03")],
        "nct_id int, indication string, brief_title string, lead_sponsor string, sponsor_class string, phase string, overall_status string, enrollment long, start_date string",
    ).selectExpr("*", "0D AS min_age_years", "0D AS max_age_years", "'ALL' AS sex", "10L AS elig_chars")
    countries = spark.createDataFrame([(1, "United States"), (2, "United States"), (2, "France"), (2, "Spain")], "nct_id int, country string")
    arms = spark.createDataFrame([(1, "PLACEBO_COMPARATOR"), (1, "EXPERIMENTAL"), (2, "UNSPECIFIED")], "nct_id int, arm_type string")
    outcomes = spark.createDataFrame([(1, "PRIMARY", "OS"), (1, "PRIMARY", "Adverse events"), (1, "SECONDARY", "AUC")], "nct_id int, outcome_kind string, measure string")
    interventions = spark.createDataFrame([(1, "DRUG", "Pembrolizumab 200 mg"), (2, "BIOLOGICAL", "KEYTRUDA"), (2, "DRUG", "x"), (3, "DEVICE", "d")], "nct_id int, intervention_type string, intervention_name string")
    land = semantic.v_landscape(trials, arms, countries, outcomes)
    return trials, countries, arms, interventions, outcomes, land


def test_landscape_and_boards(spark, layer):
    trials, countries, _, _, _, land = layer
    rows = {r["nct_id"]: r for r in land.collect()}
    assert rows[1]["comparator_design"] == "Placebo-controlled" and rows[2]["comparator_design"] == "Single-arm"
    assert rows[3]["comparator_design"] == "No arms recorded" and rows[3]["region_count"] == 0
    assert rows[1]["primary_endpoint_category"] == "Overall survival" and rows[2]["region_count"] == 2
    chunks = spark.createDataFrame([(1, "INCLUSION")] * 20 + [(1, "EXCLUSION")] * 6, "nct_id int, criterion_section string")
    board = {r["trial_id"]: r for r in boards.board_global(land, chunks, trials, countries).collect()}
    assert board[1]["criteria"] == 26 and board[1]["screening_burden"] == "3 · High" and board[3]["screening_burden"] == "1 · Light"
    assert board[2]["planned_enrolment"] is None and board[3]["planned_enrolment"] < 1_000_000
    region = boards.board_region(land, chunks, trials, countries).collect()
    assert len(region) == 4 and {r["trial_id"] for r in region} == {1, 2}
    assert boards.without_country(land, countries).count() == 1


def test_allocated_enrolment_adds_up_to_the_trial(spark, layer):
    trials, _, arms, _, outcomes, _ = layer
    countries = spark.createDataFrame([(1, c) for c in ("Spain", "France", "Italy", "Japan")], "nct_id int, country string")
    land = semantic.v_landscape(trials, arms, countries, outcomes)
    none = spark.createDataFrame([], "nct_id int, criterion_section string")
    rows = boards.board_region(land, none, trials, countries).collect()
    assert sum(r["enrolment_share"] for r in rows) == pytest.approx(rows[0]["trial_enrolment"], abs=0.05 * len(rows))


def test_report(spark, layer):
    trials, countries, _, interventions, outcomes, land = layer
    links = spark.createDataFrame([(1, "p1"), (1, "p2")], "nct_id int, pmid string")
    rl = report.Layer(resolution.v_resolved(land, countries, interventions), countries, interventions, outcomes, resolution.drug_aliases(spark), links)
    by_id = {r["nct_id"]: r for r in rl.resolved.collect()}
    assert by_id[1]["us_only"] and by_id[2]["has_us_site"] and not by_id[2]["us_only"] and not by_id[3]["has_us_site"]
    assert by_id[1]["is_monotherapy"] and not by_id[2]["is_monotherapy"] and by_id[3]["is_monotherapy"] is None
    scope = report.Scope(country="United States", drug="pembrolizumab")
    assert {r["nct_id"] for r in report.in_scope(rl, scope).collect()} == {1, 2}
    assert {r["nct_id"] for r in report.in_scope(rl, report.Scope(drug="pembrolizumab", drug_resolved=False)).collect()} == {1}
    assert {r["nct_id"] for r in report.in_scope(rl, report.Scope(country="Spain")).collect()} == {2}
    said = {r["judgement"]: (r["this_report"], r["alternative"]) for r in report.definitions_applied(rl, scope).collect()}
    assert said == {"drug identity": (2, 1), "what 'in the US' means": (2, 1), "us-led": (None, None), "combination therapy": (2, 1)}
    parts = report.sections(rl, scope)
    assert parts["sponsors"].first()["raw_names"] == 2 and parts["publications"].first()[:3] == (2, 1, 1)
    none = report.sections(rl, report.Scope(indication="OTHER"))
    sizes = {r["section"]: r["rows"] for r in report.section_sizes(none).collect()}
    assert set(sizes) == set(none) and sizes["trials"] == 0


def test_whole_word_aliases_are_an_option(spark):
    names = spark.createDataFrame([(1, "xopdivox"), (2, "Opdivo 10mg")], "nct_id int, intervention_name string")
    aliases = resolution.drug_aliases(spark)
    assert resolution.v_trial_drug(names, aliases).count() == 2
    assert [r["nct_id"] for r in resolution.v_trial_drug(names, aliases, whole_words=True).collect()] == [2]


def test_landed_lines_are_compressed_and_whole(spark, tmp_path, monkeypatch):
    from braid.catalog import ingest

    rows = [(i, f"Line {i}. More\nof it, {'x' * i}", "en", "web", 20 + i) for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ingest, "LANDED_RECORDS", 2)
    monkeypatch.setattr(ingest, "_LANDED", {})
    assert ingest.studies(spark, str(tmp_path)).count() == 7
    root = next(iter(ingest._LANDED.values())).removesuffix("/studies")
    files = spark.read.format("binaryFile").load(f"{root}/lines").select("path").collect()
    assert len(files) >= 4 and all(f["path"].endswith(".txt.gz") for f in files)


def test_a_table_that_is_small_on_disk_only_is_not_broadcast(spark, tmp_path):
    spark.range(400_000).selectExpr("id AS k", "id % 7 AS v").coalesce(1).write.parquet(f"{tmp_path}/few.parquet")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file()) < 10 << 20
    held = read_table(spark, str(tmp_path), "few")
    size = held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size > 400_000 * 16


def test_the_cap_of_enrolment_reads_written_values(spark, monkeypatch):
    trials = spark.createDataFrame([(i, i * 10) for i in range(200)], "nct_id int, enrollment long").join(spark.range(150), F.col("nct_id") == F.col("id"))
    read = []
    whole = boards.quantile_cont
    monkeypatch.setattr(boards, "quantile_cont", lambda df, *a: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, *a))
    rows = {r["nct_id"]: r for r in boards.v_enrol(trials).collect()}
    assert len(rows) == 150 and rows[149]["enrollment"] == pytest.approx(1475.1) and rows[149]["enrollment_raw"] == 1490
    assert "Join" not in read[0]
