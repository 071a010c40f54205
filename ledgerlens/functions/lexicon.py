"""Lexicon and keyword functions on text columns (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DECOMPOSE_FALLBACK,
    DECOMPOSE_RULES,
    FINANCIAL_ENTITIES,
    NEGATIVE_WORDS,
    NUMERIC_ENTITY_PATTERNS,
    POSITIVE_WORDS,
    QUERY_ROUTES,
    QUERY_TYPES,
    SUBSTANTIVE_MARKER,
    SUBSTANTIVE_MARKER_WINDOW,
    SUBSTANTIVE_MIN_CHARS,
)
from .text import py_regex


def _count_contained(low: Column, words: list[str]) -> Column:
    terms = list(dict.fromkeys(words))
    if not terms:
        return F.lit(0)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in terms), F.lit(0))


def sentiment_score(text: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """(p - n) / (p + n) over lexicon words contained as substrings (each word once); none -> 0.0."""
    low = F.lower(text)
    p = _count_contained(low, positive if positive is not None else POSITIVE_WORDS)
    n = _count_contained(low, negative if negative is not None else NEGATIVE_WORDS)
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n).cast("double") / (p + n).cast("double"))


def entity_extract(text: Column, lexicon: list[str] | None = None) -> Column:
    """Lexicon terms contained in the lower-cased text, in lexicon order."""
    terms = lexicon if lexicon is not None else FINANCIAL_ENTITIES
    low = F.lower(text)
    # The tests sit outside the lambda so the lower-cased text is computed once per row.
    hits = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms])
    return F.filter(hits, lambda t: t.isNotNull())


def numeric_entities(text: Column, patterns: list[str] | None = None) -> Column:
    """Money, percent and amount-noun matches, concatenated pattern by pattern (duplicates kept)."""
    pats = patterns if patterns is not None else NUMERIC_ENTITY_PATTERNS
    return F.concat(*[F.regexp_extract_all(text, F.lit(py_regex(p)), 0) for p in pats])


def classify_query(question: Column, types: dict | None = None) -> Column:
    """First query type (in order) with a keyword contained in the lower-cased question; else 'general'."""
    low = F.lower(question)
    out = None
    for qtype, words in (types or QUERY_TYPES).items():
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        out = F.when(cond, F.lit(qtype)) if out is None else out.when(cond, F.lit(qtype))
    return out.otherwise(F.lit("general")) if out is not None else F.lit("general")


def route_section(query_type: Column, section: Column | None = None, routes: dict | None = None) -> Column:
    """Section chosen for a query type: risk -> RISK_FACTORS, financial -> MD&A, else the caller's section."""
    out = section if section is not None else F.lit(None).cast("string")
    for qtype, sec in (routes or QUERY_ROUTES).items():
        out = F.when(query_type == F.lit(qtype), F.lit(sec)).otherwise(out)
    return out


def decompose_tasks(question: Column) -> Column:
    """array<struct<task_id, description, role, section>>: price, risk, financial subtasks in that order.

    No keyword -> one general task for the financial analyst without a section.
    """
    low = F.lower(question)
    entries = []
    for task_id, desc, role, words, section in DECOMPOSE_RULES:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        entries.append(F.when(cond, F.struct(F.lit(task_id).alias("task_id"), F.lit(desc).alias("description"),
                                             F.lit(role).alias("role"),
                                             F.lit(section).cast("string").alias("section"))))
    tasks = F.filter(F.array(*entries), lambda t: t.isNotNull())
    fid, fdesc, frole, fsec = DECOMPOSE_FALLBACK
    fallback = F.array(F.struct(F.lit(fid).alias("task_id"), F.lit(fdesc).alias("description"),
                                F.lit(frole).alias("role"), F.lit(fsec).cast("string").alias("section")))
    return F.when(F.size(tasks) > 0, tasks).otherwise(fallback)


def substantive_answer(prediction: Column) -> Column:
    """Longer than 100 characters and no 'context' in the first 50 lower-cased characters."""
    head = F.substring(F.lower(prediction), 1, SUBSTANTIVE_MARKER_WINDOW)
    return (F.length(prediction) > SUBSTANTIVE_MIN_CHARS) & ~F.contains(head, F.lit(SUBSTANTIVE_MARKER))
