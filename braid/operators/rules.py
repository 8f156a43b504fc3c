"""First-match rules, lookups and typed filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_rules(rules: list[tuple[Column, object]], default) -> Column:
    """The value of the first rule whose condition holds."""
    if not rules:
        return F.lit(default)
    (cond, value), rest = rules[0], rules[1:]
    chain = F.when(cond, F.lit(value))
    for cond, value in rest:
        chain = chain.when(cond, F.lit(value))
    return chain.otherwise(F.lit(default))


def regex_rules(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """``ordered_rules`` over (pattern, label) pairs; a pattern matches anywhere in the text."""
    return ordered_rules([(text.rlike(pattern), label) for pattern, label in rules], default)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
}


def typed_filter(clauses: list[tuple[str, str, object]], allowed: set[str]) -> Column:
    """Conjunction of (column, operator, literal); one bad clause refuses the whole filter."""
    for column, op, value in clauses:
        if column not in allowed:
            raise ValueError(f"column {column} is not filterable; allowed: {', '.join(sorted(allowed))}")
        if op not in _COMPARE:
            raise ValueError(f"operator {op} is not known; allowed: {' '.join(_COMPARE)}")
        if not isinstance(value, (str, int, float, bool)):
            raise ValueError(f"value of {column} must be a literal")
    return reduce(lambda a, b: a & b, [_COMPARE[op](F.col(c), F.lit(v)) for c, op, v in clauses], F.lit(True))


def apply_filter(df: DataFrame, clauses: list[tuple[str, str, object]], allowed: set[str]) -> DataFrame:
    return df.filter(typed_filter(clauses, allowed)) if clauses else df
