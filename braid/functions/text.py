"""Text analysis shared by documents and questions: lower case, no accents, stop words, one- and two-word terms."""

from __future__ import annotations

import os
import unicodedata
import zipfile
from dataclasses import dataclass, field
from functools import cache
from glob import glob

from pyspark.sql import Column
from pyspark.sql import functions as F

from braid.functions.binding import let

WORD = r"[\p{L}\p{N}_]{2,}"


@cache
def accent_pairs() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks whose decomposition is one plain letter, and those letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if letter.islower() and len(base) == 1 and base != letter:
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


@cache
def spark_stop_words() -> tuple[str, ...]:
    """The English list that ships with Spark ML, read from its jar so that no session is needed."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        for jar in glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                text = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf8")
            return tuple(w.strip() for w in text.splitlines() if w.strip())
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


@dataclass(frozen=True)
class Analyzer:
    """``stop_words`` is a parameter: pass another library's list to match its vocabulary."""

    stop_words: tuple[str, ...] = field(default_factory=spark_stop_words)
    bigrams: bool = True

    def words(self, text: Column) -> Column:
        flat = F.translate(F.lower(text), *accent_pairs())
        found = F.regexp_extract_all(flat, F.lit(f"({WORD})"), F.lit(1))
        return F.filter(found, lambda w: ~w.isin(*self.stop_words)) if self.stop_words else found

    def terms(self, text: Column) -> Column:
        """Kept words, then pairs of neighbouring kept words; a null text has no terms."""
        none = F.array().cast("array<string>")
        words = F.coalesce(self.words(text), none)
        if not self.bigrams:
            return words

        def with_pairs(w: Column) -> Column:
            pairs = F.zip_with(
                F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)
            )
            return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)

        return let(words, with_pairs)

    def counts(self, text: Column) -> Column:
        """Array of (term, tf), each term once: the terms are sorted and runs of equal ones measured inside the row."""
        return let(F.sort_array(self.terms(text)), _runs)


def _runs(terms: Column) -> Column:
    n = F.size(terms)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))

    def measured(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, i: F.struct(
                F.get(terms, at).alias("term"), (F.coalesce(F.get(starts, i + 1), n) - at).cast("bigint").alias("tf")
            ),
        )

    return let(starts, measured)
