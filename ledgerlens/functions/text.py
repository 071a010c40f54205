"""Column functions for filing text: whitespace, HTML, words, chunks and match offsets.

Native Spark expressions (regular expressions, higher-order array functions), but for two Arrow functions:
match offsets, which have no linear native form, and the tables of rows whose table markup is nested or
unclosed.
"""

from __future__ import annotations

import html as html_library
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE, WS_CLASS, WS_RUN

# FIXED VALUES: named character references decoded by the HTML step (with or
# without the trailing ';').  '&amp;' is decoded last so '&amp;lt;' stays '&lt;'.
HTML_ENTITIES = [
    ("nbsp", " "),
    ("lt", "<"),
    ("gt", ">"),
    ("quot", '"'),
    ("apos", "'"),
    ("copy", "©"),
    ("reg", "®"),
    ("middot", "·"),
]

# Any reference but the common ones written with their ';'.
_RARE_ENTITY = "&(?!(?:amp|" + "|".join(n for n, _ in HTML_ENTITIES) + ");)[A-Za-z#]"
# A tag starts with a letter, '/', '!' or '?'; a quoted attribute value may hold '>'.  Possessive, so linear.
_TAG = r"""<[A-Za-z/!?](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
_TABLE = r"(?is)<table\b[^>]*>.*?</table\s*>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
_STRIP_EDGES = f"^{WS_CLASS}+|{WS_CLASS}+$"


def collapse_ws(c: Column) -> Column:
    """Runs of Unicode whitespace -> one space (the reference's ``\\s+`` rule)."""
    return F.regexp_replace(c, WS_RUN, " ")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, _STRIP_EDGES, "")


def split_words(c: Column) -> Column:
    """Python ``str.split()``: words between runs of Unicode whitespace."""
    return F.filter(F.split(c, WS_RUN, -1), lambda w: w != F.lit(""))


def _interleave(pieces: Column, inserts: Column) -> Column:
    """pieces[0] + inserts[0] + pieces[1] + ... (len(pieces) == len(inserts) + 1)."""
    return F.array_join(
        F.zip_with(pieces, F.concat(inserts, F.array(F.lit(""))), lambda p, i: F.concat(p, F.coalesce(i, F.lit("")))),
        "",
    )


def decode_entities(c: Column) -> Column:
    """Decode character references exactly as Python's ``html.unescape``.

    Rows whose references are all among ``HTML_ENTITIES`` and ``&amp;`` (nearly all) are decoded by plain
    replacements, the others by that function in Arrow batches.
    """
    rare = F.regexp_like(c, F.lit(_RARE_ENTITY))
    return F.coalesce(_unescape(F.when(rare, c)), _common_entities(c))


def _common_entities(c: Column) -> Column:
    for name, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html_library.unescape(t) if isinstance(t, str) else None)


def strip_markup(c: Column) -> Column:
    """Remove comments, declarations, script and style bodies."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<!DOCTYPE[^>]*>", " ")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    return F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")


def _cell_text(cell_html: Column) -> Column:
    """A cell's text with inner strings stripped and joined without separator."""
    return F.array_join(F.transform(F.split(cell_html, _TAG, -1), py_strip), "")


class _LenientText(HTMLParser):
    """The text nodes of a page, with tables as their rows; script and style bodies are no text.

    Cells and rows close as HTML closes them: a cell at the next cell, row or table end of its own table, a
    row at the next row or table end.  A row of an outer table has the cells of tables inside it as well,
    and the text of an inner table is part of each cell around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.rows, self.text, self.hidden = [], [], [], "", 0

    def _end_text(self):
        """A text node ends at a tag: each open cell gets it stripped, outside of tables it is text."""
        if not self.open:
            self.out.append(self.text)
        for table in self.open:
            if table["cell"] is not None:
                table["cell"].append(self.text.strip())
        self.text = ""

    def parse_marked_section(self, i, report=1):
        """``<![...``: as browsers read it, a comment up to the next ``>``, whatever is in it."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        self._end_text()
        self.hidden += tag in ("script", "style")
        if tag == "table":
            if not self.open:
                self.rows = []
            self.open.append({"row": None, "cell": None})
        elif self.open and tag == "tr":
            self.open[-1].update(cell=None, row=[])
            self.rows.append(self.open[-1]["row"])
        elif self.open and tag in ("td", "th"):
            if self.open[-1]["row"] is None:
                self.handle_starttag("tr", [])
            self.open[-1]["cell"] = cell = []
            for table in self.open:
                if table["row"] is not None:
                    table["row"].append(cell)

    def handle_endtag(self, tag):
        self._end_text()
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if self.open and tag == "table":
            self.open.pop()
            if not self.open:
                self.out += [" | ".join("".join(c) for c in r) for r in self.rows if r]
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif self.open and tag == "tr":
            self.open[-1].update(cell=None, row=None)

    def handle_data(self, data):
        self.text += "" if self.hidden else data


def lenient_text(page: str) -> str:
    """What ``html_to_text`` returns, before white space is collapsed, for any markup."""
    parser = _LenientText()
    parser.feed(page)
    parser.close()
    while parser.open:
        parser.handle_endtag("table")
    parser.handle_endtag("")
    return " ".join(parser.out)


def read_or_error(page: str | None, read=lenient_text) -> tuple[str | None, str | None]:
    """A page's text, or what went wrong with it."""
    if not isinstance(page, str):
        return None, None
    try:
        return read(page), None
    except Exception as e:  # noqa: BLE001 - one page that cannot be read must not end the job
        return None, f"{type(e).__name__}: {e}"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _lenient_text(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_or_error(h) for h in html], columns=["text", "error"], dtype=object)


def _needs_lenient(body: Column) -> Column:
    """Whether references are other than the common ones, tables are nested, or any table, row or cell is
    unclosed or holds references (its text nodes are stripped after decoding)."""
    count = lambda p: F.regexp_count(body, F.lit(p))
    tables = F.regexp_extract_all(body, F.lit(_TABLE), 0)
    odd = F.exists(tables, lambda t: F.regexp_like(F.substring(t, 2, 1 << 30), F.lit(r"(?i)<table\b|&")))
    for t in ("table", "tr", "td", "th"):
        odd = odd | (count(rf"(?i)<{t}\b") != count(rf"(?i)</{t}\b"))
    return F.regexp_like(body, F.lit(_RARE_ENTITY)) | (F.regexp_like(body, F.lit(r"(?i)<table\b")) & odd)


def table_rows(table_html: Column) -> Column:
    """Array of row strings: each ``tr`` with cells -> cell texts joined `` | ``; rows without cells dropped."""
    rows = F.regexp_extract_all(table_html, F.lit(_ROW), 1)
    joined = F.transform(
        rows,
        lambda r: F.when(
            F.size(F.regexp_extract_all(r, F.lit(_CELL), 1)) > 0,
            F.array_join(F.transform(F.regexp_extract_all(r, F.lit(_CELL), 1), _cell_text),
                         " | "),
        ),
    )
    return F.filter(joined, lambda x: x.isNotNull())


def table_flatten(table_html: Column) -> Column:
    """One table as text: rows joined by newlines (empty string when no row has cells)."""
    return decode_entities(F.array_join(table_rows(table_html), "\n"))


def read_html(c: Column) -> Column:
    """struct(text, error) of a page; NULL input: no text and the error ``no content``.

    script/style/comments/declarations dropped; every table replaced by its rows
    (cells joined `` | ``); other tags separate text nodes by a space; character
    references decoded exactly; whitespace collapsed and trimmed.  Pages with rare
    references, or with nested or unclosed tables, are read by ``lenient_text`` in
    Arrow batches, and one that cannot be read has an error; all others natively.
    """
    body = strip_markup(F.coalesce(c, F.lit("")))
    pieces = F.split(body, _TABLE, -1)
    tables = F.regexp_extract_all(body, F.lit(_TABLE), 0)
    flat_tables = F.transform(tables, lambda t: F.concat(F.lit(" "), F.array_join(table_rows(t), " "), F.lit(" ")))
    native = _common_entities(_interleave(F.transform(pieces, lambda p: F.regexp_replace(p, _TAG, " ")), flat_tables))
    lenient = _lenient_text(F.when(_needs_lenient(body), body))
    error = F.when(c.isNull(), F.lit("no content")).otherwise(lenient["error"])
    # After the collapse the only whitespace left is ' ', so trim() equals Python's strip().
    text = F.when(error.isNull(), F.trim(collapse_ws(F.coalesce(lenient["text"], native))))
    return F.struct(text.alias("text"), error.alias("error"))


def html_to_text(c: Column) -> Column:
    """The text of ``read_html``; NULL input and pages that cannot be read give ``""``."""
    return F.coalesce(read_html(c)["text"], F.lit(""))


# ------------------------------------------------------------------ chunks
def chunk_starts(words: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Word offsets 0, step, 2*step, ... < n (empty for no words)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    step = size - overlap
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunks_from_words(words: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunk strings from a word-array column.

    Pass a column that is already materialised (a projected ``split_words``):
    a word expression referenced inside the lambda would be re-split per chunk.
    """
    return F.transform(chunk_starts(words, size, overlap), lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def chunk_words(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunk strings: windows of ``size`` words every ``size - overlap`` words.

    Single-expression form; DataFrame code should project ``split_words`` first
    and call ``chunks_from_words`` (see ``operators.documents.chunk_documents``).
    """
    return chunks_from_words(split_words(text), size, overlap)


def with_chunks(df, text: str = "text", out: str = "_chunks", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, keep: list[str] | None = None):
    """``df`` projected to ``keep`` + ``out`` (chunk array), splitting each text once."""
    cols = keep if keep is not None else [c for c in df.columns if c != text]
    words = df.select(*cols, split_words(F.col(text)).alias("_words"))
    return words.select(*cols, chunks_from_words(F.col("_words"), size, overlap).alias(out))


# ------------------------------------------------------------------ match offsets
def match_spans(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """array<struct<s:int, m:string>>: start offset and text of each non-overlapping match of a Python pattern.

    One linear pass per text, in Arrow batches; NULL text has no matches.
    """
    compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    schema = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("m", T.StringType())]))

    @F.pandas_udf(schema)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"s": m.start(), "m": m.group()} for m in compiled.finditer(t)] if t else [] for t in texts])

    return spans(text)


def py_regex(pattern: str, ignore_case: bool = True) -> str:
    """A Python ``re`` pattern in Java syntax with Python's Unicode classes.

    ``\\s`` and ``\\d`` become explicit Unicode classes, and case folding is
    Unicode-aware, which is cheaper than Java's UNICODE_CHARACTER_CLASS mode.
    """
    inner = WS_CLASS[1:-1]
    out = pattern.replace("\\s", "[" + inner + "]").replace("\\d", "\\p{Nd}")
    return ("(?iu)" if ignore_case else "") + out
