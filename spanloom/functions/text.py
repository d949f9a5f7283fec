"""Functions of text: tokens, overlap, truncation, slugs, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, longer than one."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas within it use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counts(words: Column) -> Column:
    """Array of structs (term, tf) of the distinct words, in order: they are sorted, and counted where a run of equal ones begins."""
    starts = lambda o: F.filter(F.slice(F.sequence(F.lit(0), F.size(o)), F.lit(1), F.size(o)), lambda i: (i == 0) | (F.get(o, i) != F.get(o, F.greatest(i - 1, F.lit(0)))))
    run = lambda o, at: F.transform(at, lambda i, j: F.struct(F.get(o, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(o)) - i).alias("tf")))
    return once(F.sort_array(words), lambda o: once(starts(o), lambda at: run(o, at)))


#: Words that a query plan ignores.
STOP = ["the", "a", "an", "and", "or", "to", "of", "in", "for", "with", "is", "are", "do", "does", "how", "what", "where", "when", "why", "who", "we", "please"]


def plan_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.filter(words, lambda t: ~t.isin(*STOP))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_jaccard(a: Column, b: Column) -> Column:
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y)).otherwise(0.0)


def presence(needle: Column, text: Column) -> Column:
    return F.when((needle != "") & F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(needle)), 1.0).otherwise(0.0)


def intent_slug(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 4), "-")).otherwise("general_query")


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def first_words(text: Column, most: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(words, 1, most), " ")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop that white space and a capital follow."""
    at = F.regexp_instr(text, F.lit(r"\.\s+[A-Z]"))
    return F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", ""))


def tokens_by_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def tokens_by_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def tokens_of_prompt(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1


def tokens_of_lines(start: Column, end: Column) -> Column:
    return (end - start) * 4


def latin1(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\xFF]")


def score_confidence(score: Column) -> Column:
    return F.when(score <= 0, 0.0).otherwise(F.least(F.lit(0.99), score / (score + 4.0)))


def embedding_text(path: Column, symbol: Column, lang: Column, start: Column, end: Column, body: Column, most: int = 4000) -> Column:
    head = F.concat(F.lit("File: "), path, F.lit("\nSymbol: "), symbol, F.lit("\nLanguage: "), lang, F.lit("\nLines: "), start, F.lit("-"), end)
    return F.concat(head, F.lit("\n\n"), F.substring(body, 1, most))


def head_trim(text: Column, most_tokens: int, marker: str = "\n[truncated]") -> Column:
    return F.when(tokens_of_prompt(text) > most_tokens, F.concat(F.substring(text, 1, 3 * most_tokens), F.lit(marker))).otherwise(text)
