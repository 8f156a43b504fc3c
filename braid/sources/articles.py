"""Publication records in XML: flattening, and the link table to registry trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_TAG = "PubmedArticle"
REGISTRY = "ClinicalTrials.gov"
ID_PREFIX = "NCT"
ABSTRACT_CHARS = 4000

ARTICLE_DDL = """
MedlineCitation STRUCT<
  PMID: STRING,
  Article: STRUCT<
    ArticleTitle: STRING,
    ArticleDate: ARRAY<STRUCT<Year: STRING>>,
    Journal: STRUCT<ISOAbbreviation: STRING, Title: STRING,
                    JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>,
    Abstract: STRUCT<AbstractText: ARRAY<STRING>>,
    PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>,
    DataBankList: STRUCT<DataBank: ARRAY<STRUCT<DataBankName: STRING,
                                                AccessionNumberList: STRUCT<AccessionNumber: ARRAY<STRING>>>>>>>,
PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>>
"""


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", ROW_TAG).schema(ARTICLE_DDL).load(path)


def parse(raw: DataFrame, column: str) -> DataFrame:
    """Articles from a string column, one article element per row."""
    return raw.select(F.from_xml(column, ARTICLE_DDL, {"rowTag": ROW_TAG}).alias("a")).select("a.*")


def _text(c: Column) -> Column:
    """Text of an element: inline markup removed, surrounding space trimmed, absent as empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"<[^>]+>", "")), F.lit(""))


def _filled(c: Column) -> Column:
    return F.nullif(_text(c), F.lit(""))


def flatten(articles: DataFrame) -> DataFrame:
    """One row per article; what an article does not say stays empty.

    Year: article date, then issue year, then the leading digits of the free-form
    issue date. Journal: abbreviation, then title. Types and registry ids are
    sorted and distinct. The DOI is the article's own, not one of its references.
    """
    a = "MedlineCitation.Article."
    issue = a + "Journal.JournalIssue.PubDate."
    loose = F.substring(_text(F.col(issue + "MedlineDate")), 1, 4)
    year = F.coalesce(
        _filled(F.get(F.col(a + "ArticleDate.Year"), 0)), _filled(F.col(issue + "Year")), F.when(loose.rlike(r"^\d{4}$"), loose), F.lit("")
    )
    ids = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "doi")
    banks = F.filter(F.col(a + "DataBankList.DataBank"), lambda b: F.trim(b["DataBankName"]) == REGISTRY)
    numbers = F.flatten(F.transform(banks, lambda b: F.coalesce(b["AccessionNumberList"]["AccessionNumber"], F.array().cast("array<string>"))))
    trials = F.filter(F.transform(numbers, lambda v: F.upper(F.trim(v))), lambda v: v.startswith(ID_PREFIX))
    types = F.filter(F.transform(F.col(a + "PublicationTypeList.PublicationType"), _text), lambda t: t != "")
    empty = F.array().cast("array<string>")
    abstract = F.array_join(F.transform(F.col(a + "Abstract.AbstractText"), _text), " ")
    return articles.select(
        _text(F.col("MedlineCitation.PMID")).alias("pmid"),
        F.coalesce(F.trim(F.try_element_at(ids, F.lit(-1))["_VALUE"]), F.lit("")).alias("doi"),
        _text(F.col(a + "ArticleTitle")).alias("title"),
        F.coalesce(_filled(F.col(a + "Journal.ISOAbbreviation")), _text(F.col(a + "Journal.Title"))).alias("journal"),
        year.alias("pub_year"),
        F.coalesce(F.array_sort(F.array_distinct(types)), empty).alias("pub_types"),
        F.coalesce(F.array_sort(F.array_distinct(trials)), empty).alias("nct_ids"),
        F.coalesce(F.substring(F.trim(abstract), 1, ABSTRACT_CHARS), F.lit("")).alias("abstract"),
    ).filter("pmid <> ''")


def citing(flat: DataFrame) -> DataFrame:
    """Articles that cite at least one registry id."""
    return flat.filter(F.size("nct_ids") > 0)


def publications(flat: DataFrame) -> DataFrame:
    """Publication table: integer year or null, types joined by a vertical bar."""
    return flat.select(
        "pmid", "doi", "title", "journal", F.col("pub_year").try_cast("int").alias("pub_year"),
        F.array_join("pub_types", "|").alias("pub_types"), "abstract",
    )


def links(flat: DataFrame) -> DataFrame:
    return flat.select(F.explode("nct_ids").alias("nct_id"), "pmid")


def linkage_rate(flat: DataFrame, trials: DataFrame) -> DataFrame:
    """Trials in scope, how many a kept article cites, and the percentage."""
    cited = links(flat).select("nct_id").distinct()
    joined = trials.select("nct_id").distinct().join(cited.withColumn("_c", F.lit(1)), "nct_id", "left")
    n, hit = F.count(F.lit(1)), F.count("_c")
    return joined.agg(n.alias("trials"), hit.alias("linked"), F.round(F.lit(100.0) * hit / F.nullif(n, F.lit(0)), 1).alias("pct"))
