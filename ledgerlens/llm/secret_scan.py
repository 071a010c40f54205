"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two bigram models over ASCII bytes are counted in Spark from samples that the texts label themselves:
values that the fixed patterns find are random strings, other runs of eight or more letters, digits and
underscores are ordinary identifiers (so is every word that no pattern marks).  One pass over a run of token
characters sums the log-likelihood ratio of its bigrams, less SHIFT each; where the sum has risen by RATIO from its
last low, the stretch from that low to the highest sum, drawn out to whole runs of letters and digits, is a span of
kind ``markov``, if it overlaps no fixed-pattern span; those always stay.  So a random string is found behind a
path or the name of a setting, and a run may hold several (parted where the sum falls DROP under its highest).

Defined results: null text counts as empty (no spans); repeated rows and null ids keep a result row each;
extra columns are ignored; without any labelled random string the ratio rests on the uniform
distribution over token characters; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .tokens import buffers

# FIXED VALUES: the patterns of the base spans, in the order of their kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_VALUE, ACCESS_SPAN, HEX_SPAN = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "api")

#: a candidate run's least length, what each bigram's ratio is lessened by, the sum that a stretch needs, and the fall that ends it
MARKOV_SPAN, SHIFT, RATIO, DROP = 14, 1.0, 20.0, 10.0
SYMBOLS = 128
#: weight of a model's single-character distribution in each of its rows
SMOOTH = 10.0
REDACTED = "[SECRET]"

_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[[*range(48, 58), *range(97, 103)]] = True
_IDENTIFIER = np.zeros(256, bool)
_IDENTIFIER[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_ALNUM = _IDENTIFIER.copy()
_ALNUM[[43, 95]] = True, False  # a plus sign is inside random strings only
_TOKEN = _IDENTIFIER.copy()
_TOKEN[[43, 45, 47, 61]] = True


def _runs(mask: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of at least this many bytes; rows end at ``ends``."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    begins = ends[:-1][ends[:-1] < len(mask)]
    first[begins] = mask[begins]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    stops = ends[1:][ends[1:] > 0] - 1
    last[stops] = mask[stops]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = z - a >= least
    return a[long], z[long]


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_SPAN]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_SPAN]
    return sorted(out)


def _batch_spans(b, column: str = "text"):
    """Text bytes and offsets, runs of token characters, and the base spans of each row."""
    raw, at = buffers(b.column(column))
    hexes = np.zeros(len(at) - 1, bool)
    a, _ = _runs(_HEXDIGIT[raw], at, HEX_SPAN)
    hexes[np.searchsorted(at, a, "right") - 1] = True
    texts = b.column(column).to_pylist()
    return raw, at, texts, [base_spans(t or "", h) for t, h in zip(texts, hexes.tolist(), strict=True)]


def _count_pairs(batches):
    """Bigram counts of random (1) and ordinary (0) strings of a task."""
    counts = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for b in (p for whole in batches for p in pieces(whole)):
        raw, at, texts, spans = _batch_spans(b)
        used = np.zeros(len(raw), bool)
        for r, found in enumerate(spans):
            for start, kind, end in found:
                lo = at[r] + len(texts[r][:start].encode())
                hi = lo + len(texts[r][start:end].encode())
                used[lo:hi] = True
                value = ASSIGN.match(texts[r], start)[2] if kind == 0 else texts[r][start:end]
                v = np.frombuffer(value.encode(), np.uint8).astype(np.int64)
                # plain words after a keyword ("token: of the") label nothing
                if len(v) >= 16 and any(c.isdigit() for c in value):
                    counts[1] += np.bincount(v[:-1] * SYMBOLS + v[1:], minlength=SYMBOLS * SYMBOLS)
        word = _IDENTIFIER[raw] & ~used
        a, z = _runs(word, at, 8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[a] += 1
        inside[np.maximum(z - 1, 0)] -= 1
        pair = np.flatnonzero(np.cumsum(inside[:-1]) > 0)  # every byte of a run but its last
        counts[0] += np.bincount(raw[pair].astype(np.int64) * SYMBOLS + raw[pair + 1], minlength=SYMBOLS * SYMBOLS)
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "pair": pa.array(pair, pa.int32()), "n": pa.array(counts[label, pair], pa.int64())})


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p(random) - log p(ordinary) of every bigram, given its first character."""
    symbols = np.flatnonzero(_TOKEN[:SYMBOLS])
    alphabet = np.zeros(SYMBOLS, bool)
    alphabet[symbols] = True
    p = []
    for c in counts.reshape(2, SYMBOLS, SYMBOLS):
        c = np.where(alphabet[None, :], c, 0).astype(float)
        single = (c.sum(axis=0) + 1) / (c.sum() + len(symbols))
        p.append(np.log((c + SMOOTH * single) / (c.sum(axis=1, keepdims=True) + SMOOTH)))
    return p[1] - p[0]


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The log-ratio table; at most 2 * 128 * 128 sums reach the driver."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count_pairs, "label int, pair int, n long")
    counts = np.zeros((2, SYMBOLS * SYMBOLS))
    for r in rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"]] = r["n"]
    return log_ratio(counts)


def stretches(steps: np.ndarray) -> list[tuple[int, int]]:
    """First and end of the stretches of a run's steps that sum to RATIO or more, in one pass."""
    out, total, best, first, end = [], 0.0, 0.0, 0, 0
    for i, x in enumerate([*steps.tolist(), -np.inf]):
        total += x
        if total <= 0 or total < best - DROP:
            if best >= RATIO:
                out.append((first, end))
            total, best, first = 0.0, 0.0, i + 1
        elif total > best:
            best, end = total, i + 1
    return out


def find(b, ratio: np.ndarray, column: str = "text") -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts and (start, kind, end) of all spans of each row, by start and kind."""
    raw, at, texts, spans = _batch_spans(b, column)
    a, z = _runs(_TOKEN[raw], at, MARKOV_SPAN)
    for lo, hi in zip(a.tolist(), z.tolist(), strict=True):
        v = raw[lo:hi].astype(np.int64)
        steps = ratio[v[:-1], v[1:]] - SHIFT
        sums = np.concatenate([[0.0], np.cumsum(steps)])
        if (sums - np.minimum.accumulate(sums)).max() < RATIO:
            continue
        r = int(np.searchsorted(at, lo, "right")) - 1
        before = len(raw[at[r] : lo].tobytes().decode())
        # whole runs of letters and digits, without what parts them at the ends
        inner = _ALNUM[v]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8)))
        opens, closes = edges[::2], edges[1::2]
        last = -1
        for first, stop in stretches(steps):
            a0, z0 = int(np.searchsorted(closes, first, "right")), int(np.searchsorted(opens, stop, "right")) - 1
            a0 = max(a0, last + 1)  # a run of letters belongs to the first stretch that reaches it
            if a0 > z0:
                continue
            last = z0
            start, end = before + int(opens[a0]), before + int(closes[z0])
            if all(e <= start or s >= end for s, _, e in spans[r]):
                spans[r].append((start, 3, end))
    return [t or "" for t in texts], [sorted(s) for s in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` of every row."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole)):
            _, found = find(b, ratio)
            out = {n: [] for n in names}
            for i, spans in zip(b.column("doc_id").to_pylist(), found, strict=True):
                kinds = [k for _, k, _ in spans]
                base = hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest()
                for n, v in zip(names, (i, *[kinds.count(k) for k in range(4)], base, written(spans)), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.string() if n in names[5:] else pa.int64()) for n in names], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n in names[5:] else 'long'}" for n in names))


def redact(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by REDACTED; other texts stay as they are, and so do other columns
    but ``length_col`` (if there), which follows a changed text."""
    length_col = length_col if length_col in docs.columns else None

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole, text_col)):
            texts, found = find(b, ratio, text_col)
            changed = [r for r, s in enumerate(found) if s]
            if changed:
                text, size = b.column(text_col).to_pylist(), b.column(length_col).to_pylist() if length_col else None
                for r in changed:
                    out, end = [], 0
                    for s, _, e in found[r]:
                        if s >= end:
                            out += [texts[r][end:s], REDACTED]
                        end = max(end, e)
                    text[r] = "".join([*out, texts[r][end:]])
                    if length_col:
                        size[r] = len(text[r])
                b = b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col), pa.array(text, b.schema.field(text_col).type))
                if length_col:
                    b = b.set_column(b.schema.get_field_index(length_col), b.schema.field(length_col), pa.array(size, b.schema.field(length_col).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
