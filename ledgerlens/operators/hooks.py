"""Model hooks: embeddings, text generation and per-partition functions.

Models are supplied by the caller and run inside Arrow batch UDFs, so Spark
partitions the work and each task calls the model on whole batches.  The only
built-in embedding is Spark ML's HashingTF -> IDF -> Normalizer pipeline.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EMBED_BATCH, EMBEDDING_DIM
from ..functions.text import split_words


def hashed_tfidf_embedding(docs: DataFrame, *, text: str = "text", dim: int = EMBEDDING_DIM,
                           out: str = "embedding", min_doc_freq: int = 0) -> DataFrame:
    """Built-in embedding: hashed term counts -> IDF (fitted on ``docs``) -> unit L2 norm, as ARRAY<FLOAT>.

    Fitting IDF is one distributed aggregation of document frequencies.
    Documents with no words get a zero vector.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.withColumn("_words", split_words(F.lower(F.col(text))))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    idf = IDF(inputCol="_tf", outputCol="_idf", minDocFreq=min_doc_freq).fit(tf).transform(tf)
    normed = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf)
    return normed.withColumn(out, vector_to_array("_n", "float32")).drop("_words", "_tf", "_idf", "_n")


def embed_with(model_fn: Callable[[list[str]], list[list[float]]], text: Column, *,
               batch_size: int = EMBED_BATCH) -> Column:
    """Caller-supplied embedding model over Arrow batches: ``model_fn(texts) -> vectors``."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(s: pd.Series) -> pd.Series:
        vals = s.fillna("").tolist()
        out: list = []
        for i in range(0, len(vals), batch_size):
            out.extend([list(map(float, v)) for v in model_fn(vals[i:i + batch_size])])
        return pd.Series(out)

    return _embed(text)


#: models that ``embed_once`` made in this worker
_MODELS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def _made(name: str, make_model: Callable) -> Callable:
    """The worker's model of that name (a function of the module, so that tasks share the module's models)."""
    if name not in _MODELS:
        _MODELS[name] = make_model()
    return _MODELS[name]


def embed_once(make_model: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column, *,
               batch_size: int = EMBED_BATCH) -> Column:
    """Caller-supplied embedding model that is costly to load: ``make_model() -> (texts -> vectors)``.

    A worker process makes the model once and keeps it for its later tasks; the model gets ``batch_size``
    texts at a time, also across Arrow batches.  A NULL text is embedded as an empty one.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, held = _made(name, make_model), []
        for s in batches:
            held += s.fillna("").tolist()
            whole = len(held) // batch_size * batch_size
            for i in range(0, whole, batch_size):
                yield pd.Series([list(map(float, v)) for v in model(held[i : i + batch_size])])
            held = held[whole:]
        if held:
            yield pd.Series([list(map(float, v)) for v in model(held)])

    return _embed(text)


def generate_with(generate_fn: Callable[[str], str], prompt: Column) -> Column:
    """Caller-supplied text generator over Arrow batches.

    Returns struct(answer, error): a failing prompt gets a NULL answer and the
    error message (the reference returns the error text as the answer).
    """
    schema = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def _gen(s: pd.Series) -> pd.DataFrame:
        answers, errors = [], []
        for p in s.fillna(""):
            try:
                answers.append(generate_fn(p))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - reported per row
                answers.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"answer": answers, "error": errors})

    return _gen(prompt)


def batch_generate(prompts: DataFrame, generate_fn: Callable[[str], str], *, prompt: str = "prompt") -> DataFrame:
    """Answer every prompt of a table; adds ``answer`` and ``error``."""
    g = prompts.withColumn("_g", generate_with(generate_fn, F.col(prompt)))
    return g.select(*prompts.columns, F.col("_g.answer").alias("answer"), F.col("_g.error").alias("error"))


def compare_models(prompts: DataFrame, base_fn: Callable[[str], str], tuned_fn: Callable[[str], str], *,
                   prompt: str = "prompt") -> DataFrame:
    """Two generators over the same prompts, responses side by side."""
    return prompts.select(*prompts.columns, generate_with(base_fn, F.col(prompt))["answer"].alias("base_response"),
                          generate_with(tuned_fn, F.col(prompt))["answer"].alias("tuned_response"))


def apply_per_filing(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Caller function over each filing (a one-row pandas frame), for logic with no native form.

    Returns ``schema``'s columns and ``error``.  A filing on which the function fails is kept as one row: the
    columns that it shares with the input, NULLs, and the error; other filings are not affected.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema  # noqa: SLF001
    names = [f.name for f in target.fields]
    full = T.StructType([*target.fields, T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            parts = []
            for i in range(len(pdf)):
                one = pdf.iloc[[i]]
                try:
                    got = fn(one)
                    if got is not None and len(got):
                        parts.append(got[names].assign(error=None))
                except Exception as e:  # noqa: BLE001 - reported per filing
                    row = {n: one[n].iloc[0] if n in one else None for n in names}
                    parts.append(pd.DataFrame([{**row, "error": f"{type(e).__name__}: {e}"}], dtype=object))
            if parts:
                yield pd.concat([p.astype(object) for p in parts], ignore_index=True)

    return df.mapInPandas(run, full)
