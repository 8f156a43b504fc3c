"""Mixing to target weights: soft domain membership, nonnegative document rates by least squares."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braid.session import read_table, settle

BITS = 17
SAMPLE = 9_000
PASSES = 25
FEATURES = 600
LEAST_SUPPORT = 10
#: Bias of a domain that no labelled text has.
NEVER = -1e9

#: Domains of the labels table, and the share of the mixed tokens that each is to have.
TOXIC, POOR, GOOD = "toxic", "poor", "good"
TARGETS = {TOXIC: 0.0, POOR: 0.2, GOOD: 0.8}


def label_domain() -> Column:
    """The domain that a row of labels states; null without labels."""
    return (
        F.when(F.col("toxic") == 1, TOXIC)
        .when(F.col("quality") == 1, GOOD)
        .when(F.col("quality") == 0, POOR)
    )


# ---- classifier -----------------------------------------------------------------------


_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()
_SIGNS = tuple(c.encode() for c in ".,!?*#$%&@:;=_/<>{}()0\n")


def word_buckets(text: str | bytes | None) -> tuple[np.ndarray, int]:
    """Distinct hashed features of a whole text, and its number of words.

    A-Z are lower-cased; white space and ASCII signs part words. Further features are the
    frequency of some signs and the number of words, each by powers of two.
    """
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else (text or b"")
    words = raw.translate(_PLAIN).split()
    found = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    if len(words):
        more = [b"words %d" % len(words).bit_length()]
        more += [b"sign %b %d" % (s, (1000 * raw.count(s) // len(raw)).bit_length()) for s in _SIGNS]
        found = np.concatenate([found, np.fromiter(map(zlib.crc32, more), np.uint32, len(more))])
    return np.unique(found & np.uint32((1 << BITS) - 1)).astype(np.int32), len(words)


class Classifier(NamedTuple):
    domains: list[str]
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posterior(self, buckets: np.ndarray) -> np.ndarray:
        if not len(buckets):
            z = self.bias
        else:
            z = self.weights[buckets].sum(0) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_classifier(examples: list[tuple[str, np.ndarray]], domains: list[str], features: int = FEATURES, passes: int = 60, decay: float = 1e-3) -> Classifier:
    """Multinomial logistic regression on the presence of the `features` most telling features."""
    width, k = 1 << BITS, len(domains)
    examples = [(d, x) for d, x in examples if d in domains]
    if not examples:
        return Classifier(domains, np.zeros((width, k), np.float32), np.zeros(k))
    goal = np.array([[float(d == own) for own in domains] for d, _ in examples])
    counts = goal.sum(0)
    rows = np.repeat(np.arange(len(examples)), [len(x) for _, x in examples])
    columns = np.concatenate([x for _, x in examples]).astype(np.int64)
    # Keep the features of some support whose presence depends most on the domain.
    support = np.stack([np.bincount(columns, goal[rows, d], width) for d in range(k)], 1)
    seen = support.sum(1)
    expected = np.outer(seen, counts / counts.sum())
    score = np.where(seen >= LEAST_SUPPORT, ((support - expected) ** 2 / np.maximum(expected, 0.5)).sum(1), 0)
    chosen = np.sort(np.argsort(-score, kind="stable")[: min(features, int((score > 0).sum()))])
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    sheet = np.zeros((len(examples), len(chosen)), np.float32)
    good = place[columns] >= 0
    sheet[rows[good], place[columns[good]]] = 1
    bias = np.log((counts + 1) / (counts + 1).sum())
    beta, memory = np.zeros((len(chosen), k), np.float32), np.full((len(chosen), k), 1e-6, np.float32)
    for _ in range(passes):
        z = sheet @ beta + bias
        e = np.exp(z - z.max(1, keepdims=True))
        gap = e / e.sum(1, keepdims=True) - goal
        step = sheet.T @ gap.astype(np.float32) / len(examples) + decay * beta
        memory += step**2
        beta -= 0.3 * step / np.sqrt(memory)
        bias = bias - 0.3 * gap.mean(0)
    weights = np.zeros((width, k), np.float32)
    weights[chosen] = beta
    return Classifier(domains, weights, bias)


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Fit on at most about `sample` labelled rows, an equal number per domain, of smallest id hash.

    Only the ids of the sample and then the hashed words of its texts reach the driver.
    Labels without a domain, repeated labels and labels of unknown documents add nothing.
    """
    own = labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).filter("id IS NOT NULL AND domain IS NOT NULL").distinct()
    own = own.filter(F.col("domain").isin(domains)).withColumn("at", F.xxhash64("id"))
    most = max(1, sample // max(1, len(domains)))
    share = {r["domain"]: r["count"] for r in own.groupBy("domain").count().collect()}
    chosen: dict = {}
    for name in domains:
        for r in own.filter(F.col("domain") == name).orderBy("at", "id").limit(most).collect():
            chosen.setdefault(r["id"], r["domain"])
    if not chosen:
        return fit_classifier([], domains)
    rows = docs.filter(F.col(doc_id).isin(list(chosen))).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_buckets(t)[0].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "words"])

    kind = {str(k): d for k, d in chosen.items()}
    found = sorted((r["id"], bytes(r["words"])) for r in rows.mapInArrow(run, "id string, words binary").collect())
    examples = [(kind[i], np.frombuffer(w, np.int32)) for i, w in dict(found).items()]
    model = fit_classifier(examples, domains)
    # The sample has as many of a rare domain as of a frequent one; the labels' own shares return.
    sampled = [sum(d == own for d, _ in examples) for own in domains]
    prior = [np.log((share.get(d, 0) + 1) / (n + 1)) if n else NEVER for d, n in zip(domains, sampled, strict=True)]
    return model._replace(bias=model.bias + np.array(prior)) if any(sampled) else model


def soft_members(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """`docs` with n_tokens (words of the whole text) and p, the posteriors in order of the domains.

    Null and empty texts have no tokens and the prior. Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_tokens", "p")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    place = keep.index(text)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*docs.schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_buckets(t) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            p = [shared.value.posterior(b).astype(float).tolist() for b, _ in found]
            new = [pa.array([n for _, n in found], pa.int64()), pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*keep, "n_tokens", "p"])

    return docs.mapInArrow(run, schema)


# ---- rates ----------------------------------------------------------------------------


def _rate(history: list[np.ndarray]) -> Column:
    """The rate after all steps so far, from the posteriors of one row."""
    rate = F.lit(1.0)
    for step in history:
        move = functools.reduce(lambda a, b: a + b, [F.col("p")[d] * float(x) for d, x in enumerate(step)])
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(members: DataFrame, targets: list[float], passes: int = PASSES, tolerance: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of the projected gradient; (steps, expected tokens per domain, goal).

    Minimizes the squared gaps between the expected tokens of the domains, sum of rate x
    tokens x posterior, and the goal, over rates >= 0. The goal has the targets' shares and
    is as large as keeps the rate of a domain with a target at 1 or more on average, so that
    mixing repeats scarce domains before it drops others. All rates begin at 1, and a step
    moves a rate by the posteriors times the gaps, preconditioned by the domains' second
    moments over the rates that aren't held at 0; a step that widens the gaps is halved. Each
    pass is one aggregation of a few numbers over `members` (n_tokens, p).
    """
    k = len(targets)
    share = np.array(targets, float)
    share = share / share.sum()

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens per domain, and second moments over the rows whose rate can move."""
        rows = members.select(F.col("n_tokens").cast("double").alias("t"), "p", _rate(steps).alias("rate"))
        p = [F.col("p")[d] for d in range(k)]
        moves = F.when(F.col("rate") > 0, F.col("t")).otherwise(0.0)
        got = rows.agg(
            *[F.sum(F.col("rate") * F.col("t") * x).alias(f"s{d}") for d, x in enumerate(p)],
            *[F.sum(moves * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)],
        ).first()
        sums = np.array([got[f"s{d}"] or 0.0 for d in range(k)])
        gram = np.array([[got[f"m{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])
        return sums, gram

    now, gram = measure([])
    wanted = share > 0
    total = max((now[wanted] / share[wanted]).max(), 0.0)
    goal = share * total
    if not total:
        return [], now, goal
    gap_of = lambda sums: np.abs(sums - goal).sum() / total
    steps: list[np.ndarray] = []
    damp = 1.0
    for _ in range(passes):
        if gap_of(now) < tolerance or damp < 1e-3:
            break
        guard = gram + 1e-6 * np.trace(gram) / k * np.eye(k)
        tried = [*steps, damp * np.linalg.solve(guard, now - goal)]
        sums, moments = measure(tried)
        if gap_of(sums) < gap_of(now):
            steps, now, gram, damp = tried, sums, moments, min(1.0, 2 * damp)
        else:
            damp /= 2
    return steps, now, goal


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column | None = None,
    targets: dict[str, float] | None = None,
    sample: int = SAMPLE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`docs` without their text, with n_tokens, p (posterior per domain, in order of `targets`),
    domain (the likeliest) and rate, the expected number of times to take the document.

    Null and empty texts have no tokens, so that no rate of theirs changes a total; they get the
    prior's rate. A domain without a labelled text has posterior 0 and no target; without any
    labelled text of a domain with a target, all rates are 1. An empty table gives an empty result.
    """
    targets = TARGETS if targets is None else targets
    names = list(targets)
    model = train(docs, labels, label_domain() if domain is None else domain, names, sample, doc_id, text)
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "p", "rate", "domain")]
    members = soft_members(docs, model, text).select(*[F.col(f"`{c}`") for c in keep], "n_tokens", "p")
    # The words are read once; the passes read these narrow rows.
    members = settle(members, "members")
    seen = [float(b) > NEVER / 2 for b in model.bias]
    reachable = [t if ok else 0.0 for t, ok in zip(targets.values(), seen, strict=True)]
    steps, _, _ = fit_rates(members, reachable) if model.weights.any() and any(reachable) else ([], None, None)
    label = F.array(*[F.lit(n) for n in names])
    top = F.get(label, F.array_position("p", F.array_max("p")).cast("int") - 1)
    return members.withColumn("domain", top).withColumn("rate", _rate(steps))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, read_table(spark, sf_dir, "labels"))
    posteriors = [F.round(F.col("p")[d], 6).alias(f"p_{name}") for d, name in enumerate(TARGETS)]
    return mixed.select("doc_id", "n_tokens", *posteriors, "domain", F.round("rate", 6).alias("rate"))
