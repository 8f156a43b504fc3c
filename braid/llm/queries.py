"""The queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braid.llm.conversations import OP12_SQL, op12_conversation_repair
from braid.llm.embeddings import op7_embedding_links
from braid.llm.fingerprints import op3_fingerprint
from braid.llm.languages import op9_language
from braid.llm.mixing import op2_mixing
from braid.llm.ngram_join import OP1_SQL, op1_ngram_join
from braid.llm.packing import op10_packing
from braid.llm.passages import op4_fuzzy_passages
from braid.llm.search import OP13_SQL, op13_ranked_search
from braid.llm.secrets import op8_secret_scan
from braid.llm.suffixes import op6_substring_dedup
from braid.llm.toxicity import op11_toxicity
from braid.llm.urls import OP5_SQL, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_fingerprint": op3_fingerprint,
    "op4_fuzzy_passages": op4_fuzzy_passages,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_links": op7_embedding_links,
    "op8_secret_scan": op8_secret_scan,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op5_url_filter": OP5_SQL, "op12_conversation_repair": OP12_SQL, "op13_ranked_search": OP13_SQL}
