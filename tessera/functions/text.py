"""Scalar text functions as Column expressions of built-ins; nulls count as empty text unless said otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\x0B\x1C-\x1F\u0085   -     　]"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """White space off both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def entity_name(c: Column) -> Column:
    """White space, then quotes and marks off both ends, once; inner runs of white space to one space."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^[\"'`.,;:]+|[\"'`.,;:]+$", "")
    return F.regexp_replace(bare, f"{SPACE}+", " ")


def comparison_form(c: Column) -> Column:
    return F.lower(entity_name(c))


def name_tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the comparison form."""
    return F.array_distinct(F.regexp_extract_all(comparison_form(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = name_tokens(a), name_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(jaccard(x, y))


def acronym(c: Column) -> Column:
    """First letters of the words of a name, lower case; empty for fewer than two words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    return F.when(F.size(words) >= 2, F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))).otherwise(F.lit(""))


def acronym_match(a: Column, b: Column) -> Column:
    """Whether one name is the acronym of the other."""
    x, y = acronym(entity_name(a)), acronym(entity_name(b))
    return ((x != "") & (x == comparison_form(b))) | ((y != "") & (y == comparison_form(a)))


def alias_pairs(text: Column) -> Column:
    """Array of (long, short, how): names with their acronym in parentheses, and names "abbreviated as" another."""
    def found(pattern: str, how: str) -> Column:
        groups = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2)]
        return F.zip_with(*groups, lambda a, b: F.struct(comparison_form(a).alias("long"), comparison_form(b).alias("short"), F.lit(how).alias("how"), (acronym(a) == F.lower(b)).alias("fits")))

    in_parentheses = F.filter(found(fixed.ALIAS_IN_PARENTHESES, "parentheses"), lambda x: x["fits"])
    every = F.concat(in_parentheses, found(fixed.ALIAS_ABBREVIATED, "abbreviated"))
    return F.transform(every, lambda x: F.struct(x["long"].alias("long"), x["short"].alias("short"), x["how"].alias("how")))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        met = free & places.get(ch, 0)
        free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b)], dtype=float)


def lexical_ratio(a: Column, b: Column) -> Column:
    """200 x longest common subsequence / both lengths, of the comparison forms; 100 where both are empty. A Pandas UDF: built-ins would copy an array for each character of each pair."""
    return F.pandas_udf(_ratios, "double")(comparison_form(a), comparison_form(b))


def context_similarity(relations: Column, neighbours: Column, types: Column) -> Column:
    """Weighted sum of three Jaccard values."""
    return F.lit(0.35).cast("double") * relations + F.lit(0.40).cast("double") * neighbours + F.lit(0.25).cast("double") * types


def is_generic(c: Column) -> Column:
    """No tokens, one generic token, or generic tokens from 70 % on."""
    t = name_tokens(c)
    share = F.size(F.array_intersect(t, _words(fixed.GENERIC_TERMS))) / F.size(t)
    return F.when(F.size(t) == 0, True).when(F.size(t) == 1, share == 1.0).otherwise(share >= 0.70)


def query_tokens(c: Column) -> Column:
    """Distinct lower-case words and decimals of at least two characters that aren't stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)?)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(_words(fixed.STOPWORDS), t)))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text's tokens have; 0 if either has none."""
    return F.when((F.size(query) == 0) | (F.size(text) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def share_of(tokens: list[str], text: Column) -> Column:
    """overlap() of a question's tokens with query_tokens(text), which needs no others of these: stopwords and single characters are in no question's tokens."""
    if not tokens:
        return F.lit(0.0)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)?)"), F.lit(1))
    return F.size(F.array_intersect(_words(tokens), found)) / F.lit(len(tokens))


def is_metadata_name(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).rlike("|".join(re.escape(m).replace(r"\ ", " ") for m in fixed.METADATA_MARKS))


def is_value_name(c: Column) -> Column:
    """A number with a unit."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).rlike("|".join(f"(?:{p})" for p in fixed.VALUE_PATTERNS))


def trimmed(c: Column, limit: int) -> Column:
    """Stripped text, cut at `limit` characters with three dots."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), f"{SPACE}+$", ""), F.lit("..."))).otherwise(t)


def is_rate_limit(error: Column) -> Column:
    return F.lower(F.coalesce(error, F.lit(""))).rlike("|".join(fixed.RATE_LIMIT_MARKS))


def is_suspicious(answer: Column, phrases: list[str] | None = None) -> Column:
    """Whether an answer says that nothing was found; the plain variant leaves out the last phrase."""
    return F.lower(F.coalesce(answer, F.lit(""))).rlike("|".join(phrases or fixed.SUSPICIOUS_PHRASES))


def validation_label(reply: Column) -> Column:
    """NEEDS_CORRECTION, UNSUPPORTED or SUPPORTED, looked for in this order; NEEDS_CORRECTION if there is none."""
    r = F.upper(F.coalesce(reply, F.lit("")))
    return F.when(r.contains("NEEDS_CORRECTION"), "NEEDS_CORRECTION").when(r.contains("UNSUPPORTED"), "UNSUPPORTED").when(r.contains("SUPPORTED"), "SUPPORTED").otherwise("NEEDS_CORRECTION")


def clean_relation(c: Column) -> Column:
    """snake_case of a-z, 0-9 and single underscores."""
    r = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?:[-]|" + SPACE + ")+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(r, "[^a-z0-9_]", ""), "_+", "_"), "^_+|_+$", "")


def is_valid_relation(c: Column) -> Column:
    """Non-empty, short, few parts, no word of a sentence, at least one letter."""
    parts = F.split(c, "_")
    return (c != "") & (F.length(c) <= fixed.MAX_RELATION_LENGTH) & (F.size(parts) <= fixed.MAX_RELATION_PARTS) & ~F.arrays_overlap(parts, _words(fixed.FORBIDDEN_WORDS)) & c.rlike("[a-z]")


def edge_type(c: Column) -> Column:
    """UPPER_CASE edge type; RELATED_TO if nothing is left."""
    r = F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), "[^A-Z0-9_]+", "_")
    r = F.regexp_replace(F.regexp_replace(r, "_+", "_"), "^_+|_+$", "")
    return F.when(r == "", "RELATED_TO").otherwise(r)


def safe_stem(name: Column) -> Column:
    """File stem for an upload: letters, digits, dots, underscores and hyphens."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(stem == "", "document").otherwise(stem)
