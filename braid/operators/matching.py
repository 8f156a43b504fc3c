"""Which phrases occur in which texts, as an equi-join.

A containment join on LIKE compares every text with every phrase. Here both
sides are keyed by the phrase's first three characters: a text offers each of its
distinct three-character pieces once, so only plausible pairs meet and the
containment test runs on those. A side of any size can take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))))
    )


def contains_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Pairs (texts columns, phrases columns) where the text contains the phrase, both compared as they are.

    Phrases shorter than three characters are keyed by their own length, and a text offers
    pieces of the lengths that occur. Pieces travel with the text's hash alone; the text is
    joined back to the plausible pairs, once each, for the test. Give distinct texts; the
    caller joins the matches back to its rows.
    """
    keyed = (
        phrases.filter(F.length(phrase) > 0)
        .withColumn("_size", F.least(F.lit(GRAM), F.length(phrase)))
        .withColumn("_gram", F.substring(F.col(phrase), F.lit(1), F.col("_size")))
    )
    sizes = sorted(r[0] for r in keyed.select("_size").distinct().collect())
    hashed = texts.withColumn("_key", F.xxhash64(text))
    pieces = F.flatten(F.filter(F.array(*[_grams(F.col(text), n) for n in sizes]), lambda a: a.isNotNull())) if sizes else F.array().cast("array<string>")
    offered = hashed.select("_key", F.explode(pieces).alias("_gram"))
    names = {c: f"_p_{c}" for c in phrases.columns}
    pairs = offered.join(keyed.withColumnsRenamed(names), "_gram").select("_key", *names.values()).distinct()
    return (
        hashed.join(pairs, "_key")
        .filter(F.contains(F.col(text), F.col(names[phrase])))
        .select(*texts.columns, *[F.col(n).alias(c) for c, n in names.items() if c not in texts.columns])
    )


def has_words(text: Column, phrase: Column) -> Column:
    """True when the phrase occurs with no word character directly before or after it.

    A constant phrase makes one pattern; a column makes one per row, so test rows that
    contain the phrase only. A phrase may hold any characters.
    """
    escaped = F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    quoted = F.concat(F.lit(rf"(^|[^\p{{L}}\p{{N}}_])\Q"), escaped, F.lit(r"\E($|[^\p{L}\p{N}_])"))
    return F.regexp_like(text, quoted)
