"""Filing documents: sections, parsed section rows, chunks and chunk ids.

Section rules (per pattern of the filing type):

1. all case-insensitive matches; a ``word.*word.*word`` alternative is greedy,
   so its single match runs from its first word to the last closing word and
   swallows other matches inside it;
2. with more than one match, starts below ``toc_skip`` are ignored;
3. end = first ``ITEM n.`` at or after start + 100, else the end of the text (``max_span``: at most
   that many characters on);
4. the longest span wins (ties: earliest); if rule 2 removed all, the first match;
5. kept when longer than ``min_chars`` characters, whole (``keep_chars``: cut to that many).

Whole sections are the default; ``SECTION_MAX_SPAN`` and ``SECTION_KEEP_CHARS`` of ``constants`` are the
values for parity with tools that cut sections.

The greedy alternative is evaluated from word offsets (linear time) instead of
a backtracking regex, which is quadratic on long filings without a closing word.
Text is expected whitespace-collapsed (as the parsing step produces it).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DOCUMENT_MIN_CHARS,
    NEXT_ITEM_PATTERN,
    SECTION_MIN_CHARS,
    SECTION_PATTERNS,
    SECTION_SEARCH_OFFSET,
    TOC_SKIP_CHARS,
)
from ..functions.text import match_spans, py_regex, py_strip, read_html, with_chunks


def _empty_int() -> Column:
    return F.array().cast("array<int>")


def _alternatives(pattern: str) -> tuple[list[str], list[list[str]]]:
    """Split ``(?:a|b)`` into plain regex alternatives and greedy word chains."""
    body = pattern[3:-1] if pattern.startswith("(?:") and pattern.endswith(")") else pattern
    plain, chains = [], []
    for alt in body.split("|"):
        if ".*" in alt and all(re.fullmatch(r"[A-Za-z&' ]+", w) for w in alt.split(".*")):
            chains.append(alt.split(".*"))
        else:
            plain.append(alt)
    return plain, chains


def _at_least(lo: Column):
    return lambda s: s >= lo


def _outside(span: Column):
    return lambda s: (s < span["start"]) | (s >= span["stop"])


def _chain_span(word_cols: list[Column], words: list[str]) -> Column:
    """struct(start, stop) of the greedy match of ``w1.*w2.*...*wk`` (NULL when absent).

    ``word_cols`` hold the start offsets of each word.  The match starts at the
    first ``w1``; the middle words are taken at their earliest feasible place and
    the match ends after the last ``wk`` that still follows them.
    """
    first = F.element_at(F.concat(word_cols[0], F.array(F.lit(None).cast("int"))), 1)
    pos = first
    for prev, wc in zip(words[:-2], word_cols[1:-1]):
        lo = pos + F.lit(len(prev))
        pos = F.array_min(F.filter(wc, _at_least(lo)))
    lo = pos + F.lit(len(words[-2]))
    last = F.array_max(F.filter(word_cols[-1], lambda s: s >= lo))
    return F.when(last.isNotNull(), F.struct(first.alias("start"), (last + F.lit(len(words[-1]))).alias("stop")))


def _best_span(n: Column, starts: Column, items: Column, toc_skip: int, max_span: int | None) -> Column:
    """The longest span (rules 2 to 4), by one sweep from the right over starts and headings in one order.

    A heading counts for starts up to SECTION_SEARCH_OFFSET before it, so it is put there; the sweep carries
    the heading last passed, the best span and the leftmost start's span.
    """
    marks = F.concat(F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(0).alias("heading"))),
                     F.transform(items, lambda i: F.struct((i - F.lit(SECTION_SEARCH_OFFSET)).alias("at"), F.lit(1).alias("heading"))))
    none = F.lit(None).cast("int")
    span = lambda s, length: F.struct(s.alias("s"), length.alias("len"))
    several = F.size(starts) > 1

    def step(acc: Column, x: Column) -> Column:
        end = F.coalesce(acc["next"] + F.lit(SECTION_SEARCH_OFFSET), F.least(x["at"] + F.lit(max_span), n) if max_span else n)
        here = span(x["at"], end - x["at"])
        better = (here["len"] > 0) & (here["len"] >= acc["best"]["len"]) & (~several | (x["at"] >= F.lit(toc_skip)))
        return F.when(x["heading"] == 1, F.struct(x["at"].alias("next"), acc["best"].alias("best"), acc["first"].alias("first"))) \
            .otherwise(F.struct(acc["next"].alias("next"), F.when(better, here).otherwise(acc["best"]).alias("best"), here.alias("first")))

    start = F.struct(none.alias("next"), span(F.lit(-1), F.lit(0)).alias("best"), span(F.lit(-1), F.lit(0)).alias("first"))
    swept = F.aggregate(F.reverse(F.array_sort(marks)), start, step, lambda acc: F.when(acc["best"]["s"] >= 0, acc["best"]).otherwise(acc["first"]))
    return F.when(F.size(starts) > 0, swept)


def _item_alt(alt: str) -> bool:
    return alt.upper().startswith("ITEM")


def _full(pattern: str) -> str:
    return "^" + py_regex("(?:" + pattern + ")") + "$"


def _starts_where(spans: Column, pattern: str) -> Column:
    """Starts of the spans whose whole text matches ``pattern`` (case-insensitive)."""
    full = _full(pattern)
    return F.transform(F.filter(spans, lambda x: F.regexp_like(x["m"], F.lit(full))), lambda x: x["s"])


def extract_sections(df: DataFrame, text: str = "text", filing_type: str = "filing_type",
                     patterns: dict | None = None, toc_skip: int = TOC_SKIP_CHARS, max_span: int | None = None,
                     keep_chars: int | None = None, min_chars: int = SECTION_MIN_CHARS, errors: str | None = None) -> DataFrame:
    """One row per kept section: the input columns (minus ``text``) + section, text.

    Unknown filing types give no rows.  A row with a value in the column ``errors`` stays, without a section.  The text is scanned twice per row: once
    for every ``ITEM n.`` heading (each section's ``ITEM`` alternative matches a
    subset of those, at the same offsets) and once for all phrase words, which
    never overlap one another.  Each section's match starts are then filtered
    from these two arrays; the greedy ``w1.*w2.*w3`` alternative is evaluated from
    the word offsets.
    """
    patterns = patterns or SECTION_PATTERNS
    keep = [c for c in df.columns if c != text]
    ftype = F.col(filing_type)

    phrases: list[str] = []
    for secs in patterns.values():
        for pat in secs.values():
            plain, chains = _alternatives(pat)
            for alt in plain:
                if not _item_alt(alt) and alt not in phrases:
                    phrases.append(alt)
            for ch in chains:
                for w in ch:
                    q = _quote_word(w)
                    if q not in phrases:
                        phrases.append(q)
    stage1 = df.select(
        *keep, F.col(text).alias("_text"), F.length(text).alias("_n"),
        match_spans(F.col(text), NEXT_ITEM_PATTERN).alias("_items"),
        (match_spans(F.col(text), "(?:" + "|".join(phrases) + ")") if phrases
         else F.array().cast("array<struct<s:int,m:string>>")).alias("_phr"),
    )

    users: dict[str, set] = {}
    for t, secs in patterns.items():
        for pat in secs.values():
            users.setdefault(pat, set()).add(t)
    p_name = {p: f"_p{i}" for i, p in enumerate(users)}
    merged = []
    for pat, types in users.items():
        plain, chains = _alternatives(pat)
        parts = []
        items = [a for a in plain if _item_alt(a)]
        others = [a for a in plain if not _item_alt(a)]
        if items:
            parts.append(_starts_where(F.col("_items"), "|".join(items)))
        if others:
            parts.append(_starts_where(F.col("_phr"), "|".join(others)))
        starts = F.concat(*parts) if parts else _empty_int()
        for ch in chains:
            word_cols = [_starts_where(F.col("_phr"), _quote_word(w)) for w in ch]
            span = _chain_span(word_cols, ch)
            starts = F.when(span.isNull(), starts).otherwise(F.concat(F.filter(starts, _outside(span)),
                                                                       F.array(span["start"])))
        merged.append(F.when(ftype.isin(*sorted(types)), F.array_sort(starts)).alias(p_name[pat]))
    stage2 = stage1.select(*keep, "_text", "_n", F.transform("_items", lambda x: x["s"]).alias("_istarts"), *merged)

    b_name = {}
    spans = []
    for t, secs in patterns.items():
        for sec, pat in secs.items():
            name = f"_b{len(b_name)}"
            b_name[(t, sec)] = name
            spans.append(F.when(ftype == F.lit(t), _best_span(F.col("_n"), F.col(p_name[pat]), F.col("_istarts"),
                                                               toc_skip, max_span)).alias(name))
    stage3 = stage2.select(*keep, "_text", *spans)

    per_type = F.array().cast("array<struct<section:string,text:string>>")
    for t, secs in patterns.items():
        entries = []
        for sec in secs:
            best = F.col(b_name[(t, sec)])
            body = F.substring(F.col("_text"), best["s"] + 1, best["len"])
            ok = best.isNotNull() & (best["len"] > F.lit(min_chars))
            kept = F.substring(body, 1, keep_chars) if keep_chars else body
            entries.append(F.when(ok, F.struct(F.lit(sec).alias("section"), kept.alias("text"))))
        per_type = F.when(ftype == F.lit(t), F.filter(F.array(*entries), lambda e: e.isNotNull())).otherwise(per_type)
    # explode_outer + filter: a plain explode lets Spark push an inferred size() > 0
    # filter below the projections, which would recompute every stage.
    kept = F.col("_s").isNotNull() | F.col(errors).isNotNull() if errors else F.col("_s").isNotNull()
    secs_df = stage3.select(*keep, F.explode_outer(per_type).alias("_s")).where(kept)
    return secs_df.select(*keep, F.col("_s.section").alias("section"), F.col("_s.text").alias("text"))


def _quote_word(w: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in w)


def parse_filing(filings: DataFrame, *, html: str = "html", text_is_html: bool = True,
                 min_chars: int = DOCUMENT_MIN_CHARS, errors: str | None = None, **section_options) -> DataFrame:
    """Filing rows (ticker, filing_type, filing_date, file_path, html) -> one row per section.

    Sections with a stripped length of at most ``min_chars`` characters are dropped; ``section_options`` go to
    ``extract_sections``.  ``metadata`` = struct(file_path, text_length).  ``errors`` names a column more: a filing
    without content, or whose page cannot be read, keeps a row without a section that says so there.
    """
    # No emptiness filter: an empty text has no matches, hence no sections, and a
    # filter would be pushed below the projection and run the extraction twice.
    given = ["ticker", "filing_type", "filing_date", "file_path"]
    if text_is_html:
        body = filings.select(*given, read_html(F.col(html)).alias("_page"))
        base = body.select(*given, F.col("_page.text").alias("text"), *([F.col("_page.error").alias(errors)] if errors else []))
    else:
        base = filings.select(*given, F.col(html).alias("text"), *([F.when(F.col(html).isNull(), F.lit("no content")).alias(errors)] if errors else []))
    secs = extract_sections(base, errors=errors, **section_options)
    long_enough = F.length(py_strip(F.col("text"))) > F.lit(min_chars)
    secs = secs.where(long_enough | F.col(errors).isNotNull() if errors else long_enough)
    return secs.select(
        "ticker", "filing_type", "filing_date", "section", "text",
        F.struct(F.col("file_path"), F.length("text").alias("text_length")).alias("metadata"), *([errors] if errors else []),
    )


def chunk_documents(docs: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    text: str = "text", errors: str | None = None) -> DataFrame:
    """Section rows -> chunk rows with chunk_id from 0 and chunk_index / total_chunks in metadata.

    Row-local: ``posexplode`` of the chunk array, no window and no shuffle.  A row with a value in the column
    ``errors`` stays, without a chunk.
    """
    keep = [c for c in docs.columns if c not in (text, "metadata", errors)]
    has_meta = "metadata" in docs.columns
    base = keep + (["metadata"] if has_meta else []) + ([errors] if errors else [])
    # Split once, chunk from the projected words, then size and explode the projected chunks.
    staged = with_chunks(docs, text, "_chunks", size, overlap, keep=base)
    total = F.when(F.col(errors).isNull(), F.size("_chunks")) if errors else F.size("_chunks")
    sized = staged.select(*base, "_chunks", total.alias("_total"))
    # _outer: a plain explode makes Spark infer size(_chunks) > 0 and push it below
    # the projections, which re-evaluates the whole split/chunk expression.
    kept = F.col("chunk_id").isNotNull() | F.col(errors).isNotNull() if errors else F.col("chunk_id").isNotNull()
    rows = sized.select(*base, "_total", F.posexplode_outer("_chunks").alias("chunk_id", "text")).where(kept)
    meta_fields = [F.col(f"metadata.{f}") for f in docs.schema["metadata"].dataType.names] if has_meta else []
    return rows.select(
        *keep,
        F.col("chunk_id").cast("int").alias("chunk_id"),
        "text",
        F.struct(*meta_fields, F.col("chunk_id").cast("int").alias("chunk_index"),
                 F.col("_total").cast("int").alias("total_chunks")).alias("metadata"),
        *([errors] if errors else []),
    )


def process_filings(filings: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    html: str = "html", **options) -> DataFrame:
    """Whole filing table -> chunk table in one plan and one pass (parse, cut sections, chunk).

    A filing without content (NULL html), or whose page cannot be read, is kept as a row with an ``error`` and no
    chunk; ``error`` is NULL on chunk rows.
    """
    return chunk_documents(parse_filing(filings, html=html, errors="error", **options), size=size, overlap=overlap, errors="error")


def chunk_id_key(ticker: Column, filing_type: Column, filing_date: Column, section: Column,
                 chunk_id: Column) -> Column:
    """Vector id ``ticker_type_date_section_chunk``; the date renders as ``yyyy-MM-dd HH:mm:ss`` (NULL: ``NaT``)."""
    date_text = F.coalesce(F.date_format(filing_date.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))
    return F.concat_ws("_", ticker, filing_type, date_text, section, chunk_id.cast("string"))
