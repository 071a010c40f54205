"""DuckDB oracle for section cutting: the original patterns run in RE2, offsets from split pieces."""

from __future__ import annotations

from ..constants import (
    NEXT_ITEM_PATTERN,
    SECTION_MIN_CHARS,
    SECTION_PATTERNS,
    SECTION_SEARCH_OFFSET,
    TOC_SKIP_CHARS,
    WS_RUN,
)
from . import bindings as b


def _starts(pat: str) -> str:
    """0-based start offsets of the matches of a pattern in column ``text``."""
    pieces = f"string_split_regex(text, '{pat}')"
    ms = f"regexp_extract_all(text, '{pat}')"
    return (f"list_transform(range(1, len({ms}) + 1), lambda i: "
            f"coalesce(list_sum(list_transform(list_slice({pieces}, 1, i), lambda x: length(x))), 0) + "
            f"coalesce(list_sum(list_transform(list_slice({ms}, 1, i - 1), lambda x: length(x))), 0))")


def filings_sql() -> str:
    heads = ", ".join(f"'{h}'" for h in b.FILING_HEADINGS)
    return f"""parts AS (
  SELECT source AS ticker, doc_id // {b.FILING_BLOCK_IDS} AS block,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN '10-K' ELSE '10-Q' END AS filing_type,
         doc_id, ([{heads}])[doc_id % 4 + 1] || ' ' || text AS piece FROM documents),
fil AS (
  SELECT ticker, filing_type, DATE '2020-01-01' + CAST(block * 91 AS INTEGER) AS filing_date,
         'filings/' || ticker || '/' || filing_type || '/' || CAST(block AS VARCHAR) AS file_path,
         trim(regexp_replace(string_agg(piece, ' ' ORDER BY doc_id), '{WS_RUN}', ' ', 'g')) AS text
  FROM parts GROUP BY ticker, block, filing_type)"""


def sections_sql(source: str = "fil") -> str:
    rows = []
    for t, secs in SECTION_PATTERNS.items():
        for i, (name, pat) in enumerate(secs.items()):
            rows.append(f"('{t}', '{name}', {i}, '(?i){pat}')")
    pats = ", ".join(rows)
    body = []
    for t, secs in SECTION_PATTERNS.items():
        for name, pat in secs.items():
            body.append(f"SELECT {source}.*, '{name}' AS section, {_starts('(?i)' + pat)} AS st "
                        f"FROM {source} WHERE filing_type = '{t}'")
    union = " UNION ALL ".join(body)
    end = (f"coalesce(list_min(list_filter(its, lambda j: j >= s + {SECTION_SEARCH_OFFSET})), "
           f"length(text))")
    del pats
    return f"""m AS ({union}),
mi AS (SELECT *, {_starts('(?i)' + NEXT_ITEM_PATTERN)} AS its,
              CASE WHEN len(st) > 1 THEN list_filter(st, lambda s: s >= {TOC_SKIP_CHARS}) ELSE st END AS el FROM m),
best AS (SELECT *, CASE WHEN len(el) > 0
     THEN list_sort(list_transform(el, lambda s: [s - ({end}), s]))[1]
     WHEN len(st) > 0 THEN list_transform([st[1]], lambda s: [s - ({end}), s])[1] END AS bs FROM mi),
sec AS (SELECT *, substr(text, CAST(bs[2] + 1 AS BIGINT), CAST(-bs[1] AS BIGINT)) AS body FROM best WHERE bs IS NOT NULL),
kept AS (SELECT * EXCLUDE (body), body AS stext FROM sec
         WHERE length(body) > {SECTION_MIN_CHARS})"""
