"""Secret scan: fixed patterns, and weak credential parts that count only beside their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braid.session import read_table, settle

# The base patterns, their order and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
BASE = KINDS[:3]
LEAST_SECRET = 6

# Weak parts: none of them is a secret by itself.
IDENTIFIER = r"""(?i)\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9_.@+-]{3,}"""
KEY = r"""(?i)\b(?:pwd|pass|auth|credentials?|private_?key|access_?key|signature)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""(?i)\b(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{4,}|(?:host|endpoint|server)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9.-]+)"""
SCOPE = 200

_SPAN = "array<struct<start:int,end:int,kind:int>>"


def spans(text: Column, pattern: str, kind: int, needs: Column, keep=None) -> Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches, in code points.

    Positions follow from the lengths of the pieces between the matches. `needs` is a cheap
    condition that every text with a match meets; only such texts reach the pattern. `keep`
    is a condition on a match; those failing it have been matched but are left out.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out"))
    start = start.withField("out", F.array().cast(_SPAN))

    def step(state, x):
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        good = x["hit"].isNotNull() & (keep(x["hit"]) if keep else F.lit(True))
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(good, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    folded = F.aggregate(pairs, start, step, lambda s: s["out"])
    return F.when(needs, folded).otherwise(F.array().cast(_SPAN))


def found_spans(text: Column) -> dict[str, Column]:
    """The base kinds and the weak kinds of one text."""
    small = F.lower(text)
    any_of = lambda *words: _any(small, words)
    has_value = small.contains(":") | small.contains("=")
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_SECRET
    return {
        "assign": spans(text, ASSIGN, 0, any_of("password", "passwd", "secret", "token", "apikey", "api_key") & has_value, long_enough),
        "access": spans(text, ACCESS, 1, text.contains("AKIA")),
        "hex": spans(text, HEX, 2, text.rlike(HEX)),
        "identifier": spans(text, IDENTIFIER, 3, any_of("user", "login", "account", "client", "access") & has_value),
        "key": spans(text, KEY, 4, any_of("pwd", "pass", "auth", "credential", "key", "signature") & has_value),
        "endpoint": spans(text, ENDPOINT, 5, small.contains("://") | (any_of("host", "endpoint", "server") & has_value)),
    }


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, spans) per row; spans are (start, end, kind) by start, then kind, then end.

    Base kinds are always reported. A weak identifier is reported when a key or a base secret
    lies within `scope` code points, a weak key when an identifier or access key lies there,
    an endpoint when both an identifier and a secret do. Weak spans that overlap a base span
    are left out. Distances are measured between the nearest ends.

    Spans are joined by interval inside a document: each span meets the nearest part of each
    sort before and after it, found by running maxima, so the work is linear in the spans.
    Texts never leave their row; only spans of documents that hold weak parts are shuffled.

    Null and empty texts have no spans. Rows with equal or null doc_id are told apart by
    their text; equal rows give equal results. Further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    by_kind = found_spans(body)
    weak = F.concat(*[by_kind[k] for k in KINDS[3:]])
    base = F.concat(*[by_kind[k] for k in BASE])
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(body).alias("text_hash"),
        base.alias("base"),
        weak.alias("weak"),
    )
    # The patterns run once; what follows reads positions only.
    rows = settle(rows, "spans")
    linked = link_parts(rows, scope)
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
    every = F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return rows.join(linked, same, "left").select("doc_id", "text_hash", F.array_sort(F.transform(every, order)).alias("spans"))


def link_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of `rows` (doc_id, text_hash, base, weak) that have their complements near."""
    parts = (
        rows.filter(F.size("weak") > 0)
        .select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("s"))
        .select("doc_id", "text_hash", "s.*")
        .distinct()
    )
    # Nearest end of a part before (largest end so far) and after (smallest start to come).
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind", "end")
    back = doc.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    sorts = {"name": F.col("kind").isin(1, 3), "proof": F.col("kind").isin(0, 2, 4), "strong": F.col("kind") < 3}
    for name, test in sorts.items():
        parts = parts.withColumn(f"{name}_before", F.max(F.when(test, F.col("end"))).over(back))
    for name, test in sorts.items():
        parts = parts.withColumn(f"{name}_after", F.min(F.when(test, F.col("start"))).over(ahead))

    def near(name: str) -> Column:
        before = F.col("start") - F.col(f"{name}_before") <= scope
        after = F.col(f"{name}_after") - F.col("end") <= scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    overlaps = F.coalesce(F.col("strong_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_after") < F.col("end"), F.lit(False))
    complete = (
        F.when(F.col("kind") == 3, near("proof"))
        .when(F.col("kind") == 4, near("name"))
        .when(F.col("kind") == 5, near("name") & near("proof"))
        .otherwise(False)
    )
    return (
        parts.filter(complete & ~overlaps)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"))
        .agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    )


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by `mark`."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(found, begin, step, rest)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.concat_ws(",", text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
