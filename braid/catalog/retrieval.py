"""Retrieval queries: index, BM25, cosine, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog import trial_frames as T
from braid.catalog.base import query, with_ctes
from braid.catalog.ingest import CHUNK_CTES, document_chunks
from braid.functions.text import Analyzer, accent_pairs, spark_stop_words
from braid.functions.vectors import dot, l2_norm
from braid.operators.ranking import global_rank
from braid.operators import shares
from braid.operators.shares import term_set_diff
from braid.plans import evaluation as E
from braid.plans import lsa
from braid.plans import retrieval as R
from braid.session import read_table, run_dir, settle, spread, table_version

KEY = ["doc_id", "chunk_id"]
K = 20


def corpus(spark, sf):
    """Every document as one chunk, its section read off the language."""
    section = F.when(F.col("lang") == "en", "INCLUSION").when(F.col("lang") == "fr", "EXCLUSION").otherwise("UNKNOWN")
    return spread(read_table(spark, sf, "documents")).select(
        "doc_id", F.lit(0).alias("chunk_id"), section.alias("criterion_section"), F.col("text").alias("chunk_text"), "lang"
    )


def vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("embedding").alias("vector"))


def questions(spark, sf):
    """Benchmark items as questions about the INCLUSION section; an item's vector is the one with its number."""
    items, emb = read_table(spark, sf, "benchmark"), read_table(spark, sf, "embeddings")
    category = F.when(F.length("text") >= 150, "long").otherwise("short")
    return items.join(emb, items["item_id"] == emb["vec_id"], "left").select(
        F.col("item_id").alias("question"), "text", category.alias("category"), F.lit("INCLUSION").alias("section"),
        F.col("embedding").alias("vector"), F.lit("derived").alias("gold_source"),
    )


def index(spark, sf):
    return R.build_index(corpus(spark, sf), KEY, "chunk_text", Analyzer())


_BUILT: dict[tuple[str, str], R.Index] = {}


def stored_index(spark, sf):
    """The index as an artefact in the shared folder, built anew when the documents have changed."""
    name = (spark.sparkContext.applicationId, table_version(spark, sf, "documents"))
    if name not in _BUILT:
        _BUILT[name] = R.build_index(corpus(spark, sf), KEY, "chunk_text", Analyzer(), root=run_dir(spark, "index"))
    return _BUILT[name]


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in spark_stop_words())


def _analyzed(name: str, source: str, key: str, text: str) -> str:
    marked, plain = accent_pairs()
    flat = f"translate(lower({text}), '{marked}', '{plain}')"
    words = f"list_filter(regexp_extract_all({flat}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {source}),
{name} AS (SELECT {key}, unnest(w) AS term FROM {name}_w
  UNION ALL SELECT {key}, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM {name}_w WHERE len(w) > 1)"""


INDEX = (
    _analyzed("terms", "documents", "doc_id", "text"),
    "counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)",
    """vocab AS MATERIALIZED (SELECT term, count(*) AS df, ln(1.0 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM counts GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.6 * (SELECT count(*) FROM documents))""",
    "postings AS MATERIALIZED (SELECT c.* FROM counts c JOIN vocab v ON v.term = c.term)",
    """lengths AS (SELECT d.doc_id, CAST(coalesce(sum(p.tf), 0) AS BIGINT) AS len FROM documents d LEFT JOIN postings p ON p.doc_id = d.doc_id GROUP BY 1)""",
)
SECTION = "CASE lang WHEN 'en' THEN 'INCLUSION' WHEN 'fr' THEN 'EXCLUSION' ELSE 'UNKNOWN' END"
REQUESTS = (
    _analyzed("qterms", "benchmark", "item_id", "text"),
    """requests AS (SELECT item_id, text, mode, CASE WHEN mode = 'with_section' THEN 'INCLUSION' END AS want, e.embedding AS qv
  FROM benchmark JOIN (VALUES ('text_only'), ('with_section')) m(mode) ON true LEFT JOIN embeddings e ON e.vec_id = item_id)""",
)
BM25 = f"""bm AS (SELECT q.item_id, r.mode, p.doc_id,
    round(sum(v.idf * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * l.len / (SELECT avg(len) FROM lengths)))), 6) AS score
  FROM (SELECT DISTINCT item_id, term FROM qterms) q JOIN vocab v ON v.term = q.term JOIN postings p ON p.term = q.term
  JOIN lengths l ON l.doc_id = p.doc_id JOIN documents d ON d.doc_id = p.doc_id JOIN requests r ON r.item_id = q.item_id
  WHERE r.want IS NULL OR r.want = {SECTION} GROUP BY 1, 2, 3)"""


def _cos(a: str, b: str) -> str:
    def d(x, y):
        return f"list_dot_product(CAST({x} AS DOUBLE[]), CAST({y} AS DOUBLE[]))"

    return f"round({d(a, b)} / (sqrt({d(a, a)}) * sqrt({d(b, b)})), 6)"


COSINE = f"""vec AS (SELECT r.item_id, r.mode, e.vec_id AS doc_id, {_cos("e.embedding", "r.qv")} AS score
  FROM requests r JOIN documents d ON r.want IS NULL OR r.want = {SECTION} JOIN embeddings e ON e.vec_id = d.doc_id WHERE r.qv IS NOT NULL)"""
RANKED = (
    "vr AS (SELECT *, row_number() OVER (PARTITION BY item_id, mode ORDER BY score DESC, doc_id) AS rank FROM vec)",
    "br AS (SELECT *, row_number() OVER (PARTITION BY item_id, mode ORDER BY score DESC, doc_id) AS rank FROM bm)",
    """fused AS (SELECT coalesce(v.item_id, b.item_id) AS item_id, coalesce(v.mode, b.mode) AS mode, coalesce(v.doc_id, b.doc_id) AS doc_id,
    v.score AS vec_score, b.score AS bm25_score, v.rank AS vec_rank, b.rank AS bm25_rank,
    coalesce(CAST(1 AS DOUBLE) / CAST(60 + v.rank AS DOUBLE), 0) + coalesce(CAST(1 AS DOUBLE) / CAST(60 + b.rank AS DOUBLE), 0) AS rrf
  FROM vr v FULL JOIN br b ON v.item_id = b.item_id AND v.mode = b.mode AND v.doc_id = b.doc_id)""",
    f"""hits AS (SELECT * FROM (SELECT f.*, {SECTION} AS criterion_section, d.text AS chunk_text,
    row_number() OVER (PARTITION BY item_id, mode ORDER BY rrf DESC, f.doc_id) AS rank FROM fused f JOIN documents d ON d.doc_id = f.doc_id) WHERE rank <= {K})""",
)
SEARCH = (*INDEX, *REQUESTS, BM25, COSINE, *RANKED)


@query(
    "term_index",
    with_ctes(*INDEX) + "SELECT p.doc_id, p.term, CAST(p.tf AS BIGINT) AS tf, CAST(v.df AS BIGINT) AS df, round(v.idf, 9) AS idf FROM postings p JOIN vocab v USING (term)",
)
def term_index(spark, sf):
    ix = index(spark, sf)
    return ix.counts.join(ix.vocabulary, "term").select("doc_id", "term", "tf", "df", F.round("idf", 9).alias("idf"))


@query("chunk_lengths", with_ctes(*INDEX) + "SELECT * FROM lengths")
def chunk_lengths(spark, sf):
    return index(spark, sf).lengths.select("doc_id", "len")


@query(
    "index_metadata",
    with_ctes(*INDEX)
    + """SELECT CAST(count(*) AS BIGINT) AS chunks, (SELECT count(*) FROM vocab) AS vocab, round(avg(len), 9) AS avg_chunk_len FROM lengths""",
)
def index_metadata(spark, sf):
    return R.index_metadata(index(spark, sf)).select("chunks", "vocab", F.round("avg_chunk_len", 9).alias("avg_chunk_len"))


@query(
    "query_terms",
    with_ctes(*INDEX, *REQUESTS)
    + "SELECT item_id AS request, term, CAST(count(*) AS BIGINT) AS qtf FROM qterms WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2",
)
def query_terms(spark, sf):
    asked = questions(spark, sf).withColumnRenamed("question", "request")
    return R.request_terms(asked, index(spark, sf).vocabulary, Analyzer())


@query(
    "bm25_topk",
    with_ctes(*INDEX, *REQUESTS, BM25)
    + """SELECT item_id AS request, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE mode = 'text_only') WHERE rank <= 10""",
)
def bm25_topk(spark, sf):
    asked = questions(spark, sf).withColumnRenamed("question", "request")
    scores = R.bm25_scores(stored_index(spark, sf), asked, corpus(spark, sf), Analyzer())
    return R.best(scores, KEY, 10).drop("chunk_id")


@query(
    "cosine_topk",
    f"""SELECT request, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT b.item_id AS request, e.vec_id AS doc_id, {_cos("e.embedding", "q.embedding")} AS score
            FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e)) WHERE rank <= 10""",
)
def cosine_topk(spark, sf):
    asked = questions(spark, sf).withColumnRenamed("question", "request")
    return R.best(R.cosine_scores(vectors(spark, sf), KEY, asked), KEY, 10).drop("chunk_id")


def searched(spark, sf, k=K):
    """Both modes of every question in one plan."""
    asked = R.both_modes(questions(spark, sf))
    chunks = corpus(spark, sf)
    found = R.hybrid_search(stored_index(spark, sf), vectors(spark, sf), asked, chunks, Analyzer(), k, ["criterion_section"])
    named = found.join(asked.select("request", "question", "mode"), "request")
    return named.join(chunks, KEY)


@query(
    "hybrid_rrf",
    with_ctes(*SEARCH)
    + """SELECT item_id AS question, mode, doc_id, criterion_section, vec_score, bm25_score, CAST(vec_rank AS INTEGER) AS vec_rank,
                CAST(bm25_rank AS INTEGER) AS bm25_rank, round(rrf, 9) AS rrf, CAST(rank AS INTEGER) AS rank FROM hits""",
)
def hybrid_rrf(spark, sf):
    return searched(spark, sf).select(
        "question", "mode", "doc_id", "criterion_section", "vec_score", "bm25_score", "vec_rank", "bm25_rank",
        F.round("rrf", 9).alias("rrf"), "rank",
    )


@query(
    "search_results",
    with_ctes(*SEARCH, *T.LANDSCAPE_CTES)
    + """SELECT CAST(item_id AS VARCHAR) || '/' || mode AS request, CAST(rank AS INTEGER) AS rank, doc_id, criterion_section, CAST(vec_rank AS INTEGER) AS vec_rank,
                CAST(bm25_rank AS INTEGER) AS bm25_rank, phase, status_group, indication, lead_sponsor, substr(chunk_text, 1, 220) AS criterion
         FROM hits JOIN landscape l ON l.nct_id = doc_id""",
)
def search_results(spark, sf):
    """Results as shown to a reader; the trial of a document is the order with its number."""
    asked = R.both_modes(questions(spark, sf))
    chunks = corpus(spark, sf)
    found = R.hybrid_search(stored_index(spark, sf), vectors(spark, sf), asked, chunks, Analyzer(), K, ["criterion_section"])
    trials = T.landscape(spark, sf).withColumnRenamed("nct_id", "doc_id")
    return R.present(found, chunks, trials, KEY, "doc_id").drop("chunk_id", "vec_sim", "bm25", "rrf")


_TYPED = (
    *INDEX,
    _analyzed("qterms", "benchmark", "item_id", "text"),
    """asks AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'PHASE1' END AS want_phase, CASE item_id % 3 WHEN 1 THEN 1000 END AS least, embedding AS qv
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)""",
    """candidates AS (SELECT item_id, qv, doc_id FROM asks JOIN landscape ON ifnull(phase = want_phase, want_phase IS NULL) AND (least IS NULL OR enrollment >= least)
  JOIN documents ON doc_id = nct_id)""",
    """near AS (SELECT item_id, doc_id, """
    + _cos("embedding", "qv")
    + """ AS score FROM candidates JOIN embeddings ON vec_id = doc_id WHERE qv IS NOT NULL)""",
    """said AS (SELECT item_id, doc_id, round(sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lengths)))), 6) AS score
  FROM candidates JOIN (SELECT DISTINCT item_id, term FROM qterms) USING (item_id) JOIN vocab USING (term) JOIN postings USING (term, doc_id)
  JOIN lengths USING (doc_id) GROUP BY ALL)""",
    """placed AS (SELECT 'v' AS side, *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM near
  UNION ALL SELECT 'b', *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) FROM said)""",
    "merged AS (SELECT item_id, doc_id, sum(CAST(1 AS DOUBLE) / (60 + place) ORDER BY side DESC) AS rrf FROM placed GROUP BY ALL)",
)


@query(
    "hybrid_trial_filter",
    with_ctes(*T.LANDSCAPE_CTES, *_TYPED)
    + f"""SELECT item_id AS request, doc_id, phase, enrollment, round(rrf, 9) AS rrf,
                 CAST(row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS INTEGER) AS rank
          FROM merged JOIN landscape ON nct_id = doc_id QUALIFY rank <= {K}""",
)
def hybrid_trial_filter(spark, sf):
    """Each request with a typed filter of its own on the trials: a phase, a least enrolment or none."""
    number = F.col("question") % 3
    asked = questions(spark, sf).select(
        F.col("question").alias("request"), "text", "vector",
        F.when(number == 0, "PHASE1").alias("want_phase"), F.when(number == 1, 1000).alias("least_enrollment"),
    )
    trials = T.landscape(spark, sf).select(F.col("nct_id").alias("doc_id"), "phase", "enrollment")
    chunks = corpus(spark, sf).join(trials, "doc_id")
    wanted = [("want_phase", "=", "phase"), ("least_enrollment", ">=", "enrollment")]
    found = R.hybrid_search(stored_index(spark, sf), vectors(spark, sf), asked, chunks, Analyzer(), K, wanted)
    return found.join(trials, "doc_id").select("request", "doc_id", "phase", "enrollment", F.round("rrf", 9).alias("rrf"), "rank")


@query(
    "deep_and_shown",
    with_ctes(*SEARCH) + "SELECT item_id AS question, mode, CAST(count(*) AS BIGINT) AS deep, CAST(count(*) FILTER (rank <= 5) AS BIGINT) AS shown FROM hits GROUP BY 1, 2",
)
def deep_and_shown(spark, sf):
    """Rows kept for analysis and rows shown: one ranking, two cuts."""
    return searched(spark, sf).groupBy("question", "mode").agg(F.count(F.lit(1)).alias("deep"), F.count_if(F.col("rank") <= 5).alias("shown"))


# ---------------------------------------------------------------- evaluation

_SENTENCE = 20


def gold(spark, sf):
    """A document answers an item when the two share a whole sentence."""

    def sentences(df, key, text):
        parts = F.transform(F.split(text, r"[.\n]", -1), lambda s: F.trim(s))
        return df.select(key, F.explode(F.array_distinct(F.filter(parts, lambda s: F.length(s) >= _SENTENCE))).alias("sentence"))

    asked = sentences(read_table(spark, sf, "benchmark"), "item_id", "text")
    held = sentences(spread(read_table(spark, sf, "documents")), "doc_id", "text")
    return asked.join(held, "sentence").select(F.col("item_id").alias("question"), "doc_id", F.lit(0).alias("chunk_id")).distinct()


GOLD = (
    f"""bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, trim(unnest(regexp_split_to_array(text, '[.\\n]')), ' ') AS s FROM benchmark) WHERE length(s) >= {_SENTENCE})""",
    f"""ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\\n]')), ' ') AS s FROM documents) WHERE length(s) >= {_SENTENCE})""",
    "gold AS (SELECT DISTINCT item_id, doc_id FROM bs JOIN ds USING (s))",
)
EVAL = (
    *SEARCH,
    *GOLD,
    """evaluated AS (SELECT r.item_id AS question, CASE WHEN length(r.text) >= 150 THEN 'long' ELSE 'short' END AS category, r.mode,
      coalesce(g.n, 0) AS gold_size, count(h.doc_id) AS returned, count(x.doc_id) AS hits,
      CASE WHEN g.n > 0 THEN CAST(count(x.doc_id) AS DOUBLE) / least(20, g.n) END AS recall_at_k,
      CAST(count(x.doc_id) AS DOUBLE) / nullif(count(h.doc_id), 0) AS precision_at_k,
      CAST(count(*) FILTER (h.criterion_section = 'INCLUSION') AS DOUBLE) / nullif(count(h.doc_id), 0) AS section_purity
    FROM requests r LEFT JOIN hits h ON h.item_id = r.item_id AND h.mode = r.mode LEFT JOIN gold x ON x.item_id = h.item_id AND x.doc_id = h.doc_id
    LEFT JOIN (SELECT item_id, count(*) AS n FROM gold GROUP BY 1) g ON g.item_id = r.item_id GROUP BY r.item_id, r.text, r.mode, g.n)""",
)


@query("gold_sentences", with_ctes(*GOLD) + "SELECT item_id AS question, doc_id FROM gold")
def gold_sentences(spark, sf):
    return gold(spark, sf).select("question", "doc_id")


def evaluated(spark, sf):
    return E.evaluate(searched(spark, sf), gold(spark, sf), questions(spark, sf), KEY, K)


@query(
    "eval_recall",
    with_ctes(*EVAL)
    + """SELECT question, category, mode, CAST(gold_size AS BIGINT) AS gold_size, CAST(returned AS BIGINT) AS returned, CAST(hits AS BIGINT) AS hits,
                round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(section_purity, 6) AS section_purity FROM evaluated""",
)
def eval_recall(spark, sf):
    rows = evaluated(spark, sf)
    return rows.select(*[F.round(c, 6).alias(c) if c in E.MEASURES else c for c in rows.columns])


@query(
    "eval_summary",
    with_ctes(*EVAL, "scopes AS (SELECT 'all' AS scope, * FROM evaluated UNION ALL SELECT category, * FROM evaluated)")
    + """SELECT scope, mode, CAST(count(*) AS BIGINT) AS questions, round(avg(recall_at_k), 5) AS recall_at_k,
                round(avg(precision_at_k), 5) AS precision_at_k, round(avg(section_purity), 5) AS section_purity FROM scopes GROUP BY 1, 2""",
)
def eval_summary(spark, sf):
    return E.summarise(evaluated(spark, sf), 5)


RULES = [
    E.GoldRule("g1", "INCLUSION", ("(^| )THE ", "TION"), ("(^| )WITH ",)),
    E.GoldRule("g2", "EXCLUSION", ("(^| )(QUE|LES) ",)),
    E.GoldRule("g3", "INCLUSION", ("EREN|ANNT", "(^| )OF ")),
    E.GoldRule("g4", "EXCLUSION", ("(^| )THE ", "(^| )AND "), (" FOR ", " BY ")),
]


def _rule_sql(r: E.GoldRule) -> str:
    tests = [f"criterion_section = '{r.section}'"]
    tests += [f"regexp_matches(upper(chunk_text), '{p}')" for p in r.every]
    tests += [f"NOT regexp_matches(upper(chunk_text), '{p}')" for p in r.none]
    return f"SELECT '{r.question}' AS question, doc_id, chunk_id FROM echunks WHERE " + " AND ".join(tests)


@query("gold_by_rules", with_ctes(*CHUNK_CTES) + " UNION ALL ".join(_rule_sql(r) for r in RULES))
def gold_by_rules(spark, sf):
    return E.gold_by_rules(document_chunks(spark, sf), KEY, RULES)


OPPOSITES = {"the": ["and", "of the"], "and": ["with"], "with": ["for"]}


@query(
    "antonym_first_rank",
    with_ctes(*SEARCH, "opp(word, opposite) AS (VALUES ('the', 'and'), ('the', 'of the'), ('and', 'with'), ('with', 'for'))")
    + r"""SELECT h.item_id AS question, CAST(min(h.rank) AS INTEGER) AS rank FROM hits h JOIN benchmark b ON b.item_id = h.item_id JOIN opp o
           ON regexp_matches(lower(b.text), '(^|[^\p{L}\p{N}_])' || o.word || '($|[^\p{L}\p{N}_])')
          AND regexp_matches(lower(h.chunk_text), '(^|[^\p{L}\p{N}_])' || o.opposite || '($|[^\p{L}\p{N}_])')
         WHERE h.mode = 'with_section' AND h.criterion_section = 'INCLUSION' GROUP BY 1""",
)
def antonym_first_rank(spark, sf):
    rows = searched(spark, sf).filter("mode = 'with_section'").select("question", "rank", "criterion_section", "chunk_text")
    return E.opposite_meaning(rows, questions(spark, sf), OPPOSITES).select("question", "rank")


@query(
    "wrong_section",
    with_ctes(*SEARCH)
    + """SELECT item_id AS question, mode, round(avg(CASE WHEN criterion_section <> 'INCLUSION' THEN 1.0 ELSE 0.0 END), 6) AS wrong_share,
                CAST(min(rank) FILTER (criterion_section <> 'INCLUSION') AS INTEGER) AS first_wrong_rank FROM hits GROUP BY 1, 2""",
)
def wrong_section(spark, sf):
    out = E.wrong_section(searched(spark, sf), questions(spark, sf))
    return out.withColumn("wrong_share", F.round("wrong_share", 6))


@query(
    "term_set_diff",
    with_ctes(
        _analyzed("ta", "conversations", "conv_id, turn", "text"),
        "sets AS (SELECT conv_id, turn, list_sort(list(DISTINCT term)) AS t FROM ta GROUP BY 1, 2)",
        "turns AS (SELECT c.conv_id, c.turn, coalesce(s.t, []) AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN sets s USING (conv_id, turn))",
    )
    + """SELECT a.conv_id, a.turn, len(list_filter(a.t, lambda x: list_contains(b.t, x))) AS shared, len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS only_a,
                len(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) AS only_b, a.t = b.t AS identical
         FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def term_set_diff_query(spark, sf):
    """Each turn of a conversation against the one that follows it."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", Analyzer().terms(F.col("text")).alias("t"))
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    diff = term_set_diff(conv.join(nxt, ["conv_id", "turn"]), "t", "u")
    sized = [F.size(c).cast("bigint").alias(c) for c in ("shared", "only_a", "only_b")]
    return diff.select("conv_id", "turn", *sized, "identical")


@query(
    "vector_statistics",
    "SELECT CAST(sum(len(embedding)) AS BIGINT) AS vector_rows, CAST(count(DISTINCT vec_id) AS BIGINT) AS criteria, sum(len(embedding)) / count(DISTINCT vec_id) AS dims_each FROM embeddings",
)
def vector_statistics(spark, sf):
    return R.vector_statistics(vectors(spark, sf), KEY)


@query(
    "long_vectors",
    "SELECT vec_id AS doc_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings",
)
def long_vectors(spark, sf):
    return R.long_vectors(vectors(spark, sf), ["doc_id"]).withColumn("val", F.col("val").cast("double"))


@query(
    "global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders",
)
def global_rank_query(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ranked = global_rank(orders, [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")])
    return ranked.select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


_FITTED: dict[tuple[str, str], lsa.LsaModel] = {}


def stored_model(spark, sf):
    """The decomposition as an artefact beside the index, fitted anew when the documents have changed."""
    name = (spark.sparkContext.applicationId, table_version(spark, sf, "documents"))
    if name not in _FITTED:
        _FITTED[name] = lsa.fit(stored_index(spark, sf), Analyzer())
    return _FITTED[name]


@query("svd_embed")
def svd_embed(spark, sf):
    """Latent vectors of all documents: norm of each and number of dimensions."""
    out = lsa.embed_documents(stored_index(spark, sf), stored_model(spark, sf))
    return out.select("doc_id", F.size("vector").alias("dims"), F.round(l2_norm(F.col("vector")), 4).alias("norm"))


@query("artefact_metadata")
def artefact_metadata(spark, sf):
    """One row on index and decomposition: chunks, dims, vocabulary, average length, explained variance."""
    ix, model = stored_index(spark, sf), stored_model(spark, sf)
    about = R.index_metadata(ix, model.dims, lsa.explained_variance(ix, model))
    return about.withColumns({c: F.round(c, 6) for c in ("avg_chunk_len", "explained_variance")})


# As many terms as dimensions: nothing is cut off, so that products of latent rows are those of the weighted matrix.
FULL_RANK_TERMS = 48


@query(
    "svd_full_rank",
    with_ctes(
        *INDEX,
        f"""few AS (SELECT v.term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + v.df)) + 1.0 AS idf_smooth
  FROM vocab v JOIN (SELECT term, sum(tf) AS cf FROM counts GROUP BY 1) c ON c.term = v.term ORDER BY c.cf DESC, v.term LIMIT {FULL_RANK_TERMS})""",
        "cells AS MATERIALIZED (SELECT doc_id, p.term, (1.0 + ln(tf)) * idf_smooth AS w FROM postings p JOIN few f ON f.term = p.term)",
        "norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM cells GROUP BY 1)",
        """dots AS (SELECT a.doc_id, sum(a.w * b.w) AS s FROM cells a JOIN cells b ON b.doc_id = a.doc_id + 1 AND b.term = a.term GROUP BY 1)""",
    )
    + """SELECT a.doc_id, round(1.0, 6) AS length, round(coalesce(s, 0) / (a.norm * b.norm), 6) AS next_cosine
         FROM norms a JOIN norms b ON b.doc_id = a.doc_id + 1 LEFT JOIN dots d ON d.doc_id = a.doc_id""",
)
def svd_full_rank(spark, sf):
    """Each document's latent row against the next document's, where the decomposition keeps every direction."""
    few = R.build_index(corpus(spark, sf), KEY, "chunk_text", Analyzer(), max_terms=FULL_RANK_TERMS, root=run_dir(spark, "index"))
    model = lsa.fit(few, Analyzer(), dims=FULL_RANK_TERMS)
    z = settle(lsa.latent(lsa.weighted(few.postings, model.vocabulary, KEY), model, KEY).select("doc_id", "z"), "latent")
    follower = z.select((F.col("doc_id") - 1).alias("doc_id"), F.col("z").alias("next"))
    cosine = dot(F.col("z"), F.col("next")) / (l2_norm(F.col("z")) * l2_norm(F.col("next")))
    # Adding 0 turns a negative zero into zero.
    return z.join(follower, "doc_id").select("doc_id", F.round(l2_norm(F.col("z")), 6).alias("length"), (F.round(cosine, 6) + 0.0).alias("next_cosine"))


@query(
    "corpus_totals",
    with_ctes(T.TRIALS, T.GEO, T.OUTCOMES, T.CHUNKS, *INDEX)
    + """SELECT 'trials' AS fact, CAST(count(*) AS BIGINT) AS n FROM trials
         UNION ALL SELECT 'criteria', CAST(count(*) AS BIGINT) FROM chunks
         UNION ALL SELECT 'outcomes', CAST(count(*) AS BIGINT) FROM outcomes
         UNION ALL SELECT 'countries', CAST(count(DISTINCT country) AS BIGINT) FROM countries
         UNION ALL SELECT 'sponsors', CAST(count(DISTINCT lead_sponsor) AS BIGINT) FROM trials
         UNION ALL SELECT 'vector rows', CAST(sum(len(embedding)) AS BIGINT) FROM embeddings
         UNION ALL SELECT 'token rows', CAST(count(*) AS BIGINT) FROM postings
         UNION ALL SELECT 'vocabulary', CAST(count(*) AS BIGINT) FROM vocab""",
)
def corpus_totals(spark, sf):
    """The eight counters of the corpus and its retrieval artefacts."""
    trials, ix = T.trials(spark, sf), stored_index(spark, sf)
    vectors = read_table(spark, sf, "embeddings").select(F.explode("embedding").alias("val"))
    counted = shares.labelled_counts(
        {
            "trials": trials,
            "criteria": T.chunks(spark, sf),
            "outcomes": T.outcomes(spark, sf),
            "countries": T.countries(spark, sf).select("country").distinct(),
            "sponsors": trials.select("lead_sponsor").distinct(),
            "vector rows": vectors,
            "vocabulary": ix.vocabulary,
        }
    )
    # A document knows how many postings it has.
    tokens = ix.sizes.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("n"))
    return counted.unionByName(tokens.select(F.lit("token rows").alias("fact"), "n"))


@query("gold_sources", "SELECT 'derived' AS gold_source, CAST(count(*) AS BIGINT) AS questions FROM benchmark")
def gold_sources(spark, sf):
    """How many questions take their gold from which source."""
    return E.gold_sources(questions(spark, sf))
