"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies four terms: the likelihood of the text's byte trigrams, the
probability of the declared (markup) language, that of the address suffix or path, and the prior of the
host.  All are learned from the table by grouped aggregation:

* trigram counts by declared language, over all texts (hashed to BUCKETS), smoothed by those of all texts;
* host priors from the texts' own best languages, smoothed hierarchically: the host's counts on those of
  its domain, these on those of its suffix, these on all rows (weight PRIOR at every level);
* p(declared | language) and p(suffix | language) from their counts with the texts' best languages.

Every declared language with LEAST_TEXT trigrams of text is learned.  Declared ones with less text are one
language more, pooled: such a declaration's probability is the pool's, and a row that the pool wins has the
language it declares, or none if that is not one of the pool's.  All declared values and address suffixes
are evidence, however rare.

Trigrams are not independent, so a text's log-likelihood counts as at most EVIDENCE of them.  A row whose
declared language has a posterior under REJECT is rejected: its text or host speaks another language.

Defined results: a null or empty text gives no text evidence, a null declaration or address none of its
own; rows without any are kept with the prior; repeated rows and null ids keep a row each; extra columns
stay; without a language to learn, or on an empty table, the language is null and rows are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

from .arrays import load, save, shared_folder
from .common import by_group, pieces
from .tokens import LOWER, buffers

BUCKETS = 1 << 15
ADDED = ("language", "probability", "declared_probability", "rejected")
EVIDENCE, PRIOR, SMOOTH, REJECT = 60, 20.0, 0.5, 0.02
#: trigrams of text that a declared language must have to be learned
LEAST_TEXT = 2000
#: languages of a file of the model; languages counted at a time
BLOCK = 32
#: looked-up tables are broadcast up to this many numbers, by their most frequent keys
BROADCAST_CELLS = 3_000_000


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of every byte place and a mask of those inside a row."""
    b = LOWER[raw].astype(np.uint32)
    inside = np.zeros(len(b), bool)
    if len(b) < 3:
        return np.zeros(len(b), np.int64), inside
    g = np.zeros(len(b), np.int64)
    g[:-2] = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    inside[:-2] = True
    for back in (1, 2):
        cut = offsets[1:] - back
        inside[cut[(cut >= 0) & (cut >= offsets[:-1])]] = False
    return g, inside


def _texts(docs: DataFrame, text: Column, declared: Column | None, host: Column | None, suffix: Column | None) -> DataFrame:
    none = F.lit(None).cast("string")
    clean = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")) if c is not None else none
    return docs.select(F.coalesce(text, F.lit("")).alias("_text"), F.split_part(clean(declared), F.lit("-"), F.lit(1)).alias("_declared"),
                       clean(host).alias("_host"), clean(suffix).alias("_suffix"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns if c not in ADDED])


class Model:
    """Learned languages (the last is None if there is a pool of others) and their files of log p(trigram | language)."""

    def __init__(self, folder: str, languages: list[str], pooled: bool):
        self.folder, self.names = folder, [*languages, *([None] if pooled else [])]
        self.place = {x: i for i, x in enumerate(languages)}
        self.other = len(languages) if pooled else -1

    def places(self, declared: pa.Array) -> np.ndarray:
        """Of every declared language; -1: none."""
        return np.array([-1 if x is None else self.place.get(x, self.other) for x in declared.to_pylist()], np.int64)

    def likelihood(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods of every text by language, and its trigrams."""
        raw, offsets = buffers(texts)
        g, inside = grams(raw, offsets)
        ends = np.append(0, np.cumsum(inside))
        n = ends[offsets[1:]] - ends[offsets[:-1]]
        g, some = g[inside], np.flatnonzero(n)
        out = np.zeros((len(n), len(self.names)))
        if len(some):
            starts, scale = ends[offsets[some]], np.minimum(1.0, EVIDENCE / n[some])
            for at in range(0, len(self.names), BLOCK):
                for i, p in enumerate(load(f"{self.folder}/{at // BLOCK}.npy")):
                    out[some, at + i] = np.add.reduceat(p[g], starts) * scale
        return out, n


def train(rows: DataFrame) -> Model | None:
    """The model of the declared languages, from all texts that declare one."""
    text = F.greatest(F.octet_length("_text") - 2, F.lit(0)).cast("long")
    found = rows.where("_declared IS NOT NULL").groupBy("_declared").agg(F.sum(text).alias("n")).withColumn("learned", F.col("n") >= LEAST_TEXT)
    languages = sorted(r["_declared"] for r in found.where("learned").select("_declared").collect())
    if not languages:
        return None
    model = Model(shared_folder(rows.sparkSession, "languages"), languages, not found.where("NOT learned").isEmpty())

    def count(batches):
        for b in (p for whole in batches for p in pieces(whole, "_text")):
            raw, offsets = buffers(b.column("_text"))
            g, inside = grams(raw, offsets)
            present, label = np.unique(model.places(b.column("_declared")), return_inverse=True)
            label = np.repeat(label, np.diff(offsets))
            for at in range(0, len(present), BLOCK):
                some = inside & (label >= at) & (label < at + BLOCK)
                counts = np.bincount((label[some] - at) * BUCKETS + g[some], minlength=BUCKETS)
                key = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(present[at + key // BUCKETS], pa.int32()), pa.array(key % BUCKETS, pa.int32()), pa.array(counts[key], pa.int64())], names=["language", "gram", "n"])

    summed = rows.where("_declared IS NOT NULL").select("_text", "_declared").mapInArrow(count, "language int, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).checkpoint()
    every = np.full(BUCKETS, SMOOTH)
    for r in summed.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most BUCKETS rows
        every[np.asarray(r["gram"])] += np.asarray(r["n"])
    every *= SMOOTH * BUCKETS / every.sum()
    folder, last = model.folder, len(model.names)

    def write(key, t: pa.Table) -> pa.Table:
        at = key[0].as_py() * BLOCK
        counts = np.zeros((min(BLOCK, last - at), BUCKETS))
        counts[np.asarray(t["language"]) - at, np.asarray(t["gram"])] = np.asarray(t["n"])
        save(f"{folder}/{key[0].as_py()}.npy", np.log((counts + every) / (counts.sum(axis=1, keepdims=True) + every.sum())))
        return pa.table({"n": pa.array([len(counts)], pa.int64())})

    # the pool may have no text; its place in the last block is filled all the same
    blocks = summed.withColumn("block", F.expr(f"language div {BLOCK}").cast("int"))
    if model.other >= 0:
        blocks = blocks.unionByName(summed.sparkSession.createDataFrame([(model.other, 0, 0, model.other // BLOCK)], "language int, gram int, n long, block int"))
        blocks = blocks.groupBy("language", "gram", "block").agg(F.sum("n").alias("n"))
    by_group(blocks, "block", write, "n long").collect()
    return model


def best_languages(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``rows``' columns of ``keep`` with the text's best language (null: no text)."""

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole, "_text")):
            ll, n = model.likelihood(b.column("_text"))
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(ll.argmax(axis=1), pa.int32(), mask=n == 0)], names=[*keep, "_best"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _best int")


def _by_key(best: DataFrame, *keys: str) -> DataFrame:
    """Rows by the texts' best language as a list of at most a pair a language; a grouped row stands for ``_n`` rows."""
    return best.groupBy(*keys, "_best").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(F.collect_list(F.struct("_best", "_n")).alias("_counts"), F.sum("_n").alias("_n"))


def _every(best: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n)
    for r in best.where("_best IS NOT NULL").groupBy("_best").agg(F.sum("_n").alias("_n")).collect():
        out[r["_best"]] = r["_n"]
    return out


def _root(best: DataFrame, n: int) -> np.ndarray:
    every = _every(best, n)
    return (every + 1.0) / (every.sum() + n)


def _dense(column: pa.Array, n: int) -> np.ndarray:
    """Lists of (language, count) as rows of ``n`` counts."""
    values = column.flatten()
    i, c = (pa.compute.struct_field(values, k) for k in (0, 1))
    row = np.repeat(np.arange(len(column)), np.asarray(pa.compute.list_value_length(column)))
    out, known = np.zeros((len(column), n)), np.asarray(i.is_valid())
    out[row[known], np.asarray(i.drop_null())] = np.asarray(c)[known]
    return out


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel(), pa.float64()))


def _slices(batches, n: int):
    """Batches of at most some MB as rows of ``n`` numbers."""
    rows = max(1, (1 << 20) // n)
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def host_priors(best: DataFrame, n: int) -> DataFrame:
    """``_host`` with its smoothed prior by language (an array) and rows, from (_host, _best, _n) rows."""
    root = _root(best, n)
    hosts = _by_key(best.where("_host IS NOT NULL"), "_host")
    parts = best.where("_host IS NOT NULL").select(F.regexp_extract("_host", r"([^.]+\.[^.]+)$", 1).alias("_domain"), F.regexp_extract("_host", r"([^.]+)$", 1).alias("_top"), "_best", "_n")
    hosts = hosts.withColumn("_domain", F.regexp_extract("_host", r"([^.]+\.[^.]+)$", 1)).withColumn("_top", F.regexp_extract("_host", r"([^.]+)$", 1))
    domains = _by_key(parts, "_domain", "_top").select("_domain", "_top", F.col("_counts").alias("_domain_counts"))
    tops = _by_key(parts, "_top").select("_top", F.col("_counts").alias("_top_counts"))

    def smooth(batches):
        for b in _slices(batches, n):
            p = root
            for level in ("_top_counts", "_domain_counts", "_counts"):
                c = _dense(b.column(level), n)
                p = (c + PRIOR * p) / (c.sum(axis=1, keepdims=True) + PRIOR)
            yield pa.RecordBatch.from_arrays([b.column("_host"), _lists(p), b.column("_n")], names=["_host", "_prior", "_n"])

    return hosts.join(domains, ["_domain", "_top"]).join(tops, "_top").mapInArrow(smooth, "_host string, _prior array<double>, _n long")


def _evidence(best: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """log p(value | language) of every value (an array) and its rows, from (value, _best, _n) rows."""
    known = best.where(F.col(column).isNotNull())
    values = _by_key(known, column).checkpoint()
    total = _every(known, n) + SMOOTH * (values.count() + 1)

    def run(batches):
        for b in _slices(batches, n):
            yield pa.RecordBatch.from_arrays([b.column(column), _lists(np.log((_dense(b.column("_counts"), n) + SMOOTH) / total)), b.column("_n")], names=[column, name, "_n"])

    return values.mapInArrow(run, f"{column} string, {name} array<double>, _n long").checkpoint()


def _looked_up(rows: DataFrame, table: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """``rows`` with the array of their key, or null; frequent keys are broadcast and only rows of the others shuffled."""
    most = max(1, BROADCAST_CELLS // n)
    hot = table.orderBy(F.desc("_n"), key).limit(most).drop("_n")
    if table.count() <= most:
        return rows.join(F.broadcast(table.drop("_n")), key, "left")
    hot = hot.checkpoint()
    rare = table.drop("_n").join(F.broadcast(hot.select(key)), key, "left_anti")
    found = rows.join(F.broadcast(hot), key, "left")
    done = F.col(key).isNull() | F.col(name).isNotNull()
    return found.where(done).unionByName(found.where(~done).drop(name).join(rare, key, "left"))


def _matrix(column: pa.Array, missing: np.ndarray) -> np.ndarray:
    out, known = np.tile(missing, (len(column), 1)), np.asarray(column.is_valid())
    if known.any():
        out[known] = np.asarray(column.flatten()).reshape(-1, len(missing))
    return out


def identify(docs: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """``docs``' columns with language, probability, declared_probability and rejected, in place of any such."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = _texts(docs, text, declared, host, suffix)
    own = [c for c in rows.columns if c.startswith("k_")]
    model = train(rows)
    if model is None:
        return docs.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"),
                                 "declared_probability": F.lit(None).cast("double"), "rejected": F.lit(False)})
    n = len(model.names)
    evidence = ["_declared", "_host", "_suffix"]
    best = best_languages(rows.select("_text", *evidence), model, evidence).groupBy(*evidence, "_best").agg(F.count("*").alias("_n")).checkpoint()
    root, nothing = _root(best, n), np.zeros(n)
    for table, key, name in ((host_priors(best, n).checkpoint(), "_host", "_prior"), (_evidence(best, "_declared", "_said", n), "_declared", "_said"), (_evidence(best, "_suffix", "_at", n), "_suffix", "_at")):
        rows = _looked_up(rows, table, key, name, n)

    def fuse(batches):
        for b in (p for whole in batches for p in pieces(whole, "_text")):
            log = model.likelihood(b.column("_text"))[0]
            log += np.log(_matrix(b.column("_prior"), root)) + _matrix(b.column("_said"), nothing) + _matrix(b.column("_at"), nothing)
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            top, place, said = log.argmax(axis=1), model.places(b.column("_declared")), b.column("_declared").to_pylist()
            names = [said[r] if i == model.other and place[r] == i else model.names[i] for r, i in enumerate(top.tolist())]
            each = np.arange(len(top))
            spoken = p[each, place]
            yield pa.RecordBatch.from_arrays([*b.select(own).columns, pa.array(names, pa.string()), pa.array(p[each, top]), pa.array(spoken, mask=place < 0), pa.array((place >= 0) & (spoken < REJECT))], names=[*own, *ADDED])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(fuse, ", ".join(f"`{c}` {types[c]}" for c in own) + ", language string, probability double, declared_probability double, rejected boolean")
    return out.select(*[F.col(f"`{c}`").alias(c[2:]) for c in own], *ADDED)


# FIXED VALUES: where a page declares its language, and what of an address says one
MARKUP = r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)"
HOST = r"^[a-z]+://([^/:?#]+)"
PATH_LANGUAGE = r"^[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)"


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents declare a language in ``lang`` and come from the host ``source``."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages declare it in the markup; the address has a host and perhaps a language as its first folder."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>", " "), r"<[^>]*>", " ")
    empty = lambda c: F.nullif(c, F.lit(""))
    url = F.lower("url")
    return identify(pages, text, empty(F.regexp_extract("html", MARKUP, 1)), empty(F.regexp_extract(url, HOST, 1)), empty(F.regexp_extract(url, PATH_LANGUAGE, 1)))
