"""Functions of symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(symbol: Column) -> Column:
    """What follows the last colon and the last dot."""
    return F.element_at(F.split(F.element_at(F.split(symbol, ":"), -1), r"\."), -1)


def suffix_keys(symbol: Column) -> Column:
    """The symbol and each of its dot suffixes: a suffix match becomes an equality."""
    parts = F.split(symbol, r"\.")
    n = F.size(parts)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def candidate_keys(symbol: Column) -> Column:
    """The whole name, what follows the first colon, module.leaf if there are both a colon and a dot behind it, and the leaf; distinct, in this order."""
    tail = F.regexp_replace(symbol, "^[^:]*:", "")
    last = F.element_at(F.split(tail, r"\."), -1)
    module = F.element_at(F.split(F.substring_index(symbol, ":", 1), r"\."), -1)
    both = F.when((F.instr(tail, ".") > 0) & (F.instr(symbol, ":") > 0), F.concat(module, F.lit("."), last))
    return F.array_distinct(F.filter(F.array(symbol, tail, both, last), lambda k: k.isNotNull() & (k != "")))


#: Priority of entity kinds, and their weight in importance scores.
PRIORITY = {"class": 10, "interface": 9, "function": 8, "method": 7, "type": 6, "variable": 5}
IMPORTANCE = {"class": 100, "interface": 90, "function": 50, "method": 40, "type": 30, "variable": 10}


def by_kind(kind: Column, values: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind), F.lit(0))


def match_score(query: Column, name: Column) -> Column:
    """1 for the same name, .9 if only case differs, .7 for a dot suffix, .5 if contained, else null."""
    q, n = F.lower(query), F.lower(name)
    return F.when(name == query, 1.0).when(n == q, 0.9).when(n.endswith(F.concat(F.lit("."), q)), 0.7).when(F.contains(n, q), 0.5)


def importance(kind: Column, symbol: Column, lines: Column, n_in: Column, n_out: Column) -> Column:
    name = leaf(symbol)
    private = F.when(name.startswith("__"), -30).when(name.startswith("_"), -20).otherwise(0)
    test = F.when(F.contains(F.lower(name), F.lit("test")), -10).otherwise(0)
    return by_kind(kind, IMPORTANCE) + private + test + F.least(lines * 0.5, F.lit(50.0)) + F.least(n_in * 5, F.lit(50)) + F.least(n_out, F.lit(20))
