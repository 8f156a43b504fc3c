"""Helpers of the tests of the corpus operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(dice, n, stock=400):
    return [f"{'abcdefghij'[dice.randrange(10)]}{dice.randrange(stock)}" for _ in range(n)]


def roots(n, pairs):
    """Smallest member of each one's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def odd_texts():
    """Cases that every operator must take: nulls, empty, blanks, short, repeated, long, foreign."""
    dice = random.Random(5)
    long = " ".join(words(dice, 30_000, 100_000))
    return [None, "", " \t\n ", "one", "Zwei Wörter", "a b c d", "a b c d e", "A B C D E", "a b c d e", long, long + " x", "é" * 300, "𝔘𝔫𝔦 " * 80, "12345 !!!"]
