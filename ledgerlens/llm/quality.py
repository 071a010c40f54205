"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0).  Documents are grouped by their votes (at most 3 to
the number of rules patterns, whatever the table's size); expectation-maximisation on the pattern counts
estimates the share of good documents and, for each rule, how often it votes good or bad on documents of
either kind; the posterior probability of good replaces an all-must-pass filter.

The fixed base rules come first: a document that fails them is never kept.

Defined results: null text counts as empty (no words: base_failed); repeated rows and null ids keep a row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

# FIXED VALUES: white space of the word pattern, symbols, window and limits of the base rules
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: expectation-maximisation: rounds, prior share of good documents, weight of the first guesses for good ones as
#: a share of the documents (2 at least), posterior that keeps
ROUNDS, PRIOR_GOOD, WEIGHT, KEEP = 25, 0.8, 0.1, 0.5
#: first guess that a document with no, one, more bad votes is good; first guess of p(vote | bad, good)
FIRST = (0.95, 0.3, 0.05)
START = ({-1: 0.4, 0: 0.2, 1: 0.4}, {-1: 0.01, 0: 0.2, 1: 0.79})


def words(text: Column) -> Column:
    """Runs of characters that are no white space of the word pattern."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def _pairs(hashes: str, step: int) -> Column:
    """Hash of every element with the one ``step`` after it."""
    return F.expr(f"transform(slice({hashes}, 1, greatest(size({hashes}) - {step}, 0)), (h, i) -> xxhash64(h, element_at({hashes}, i + {step + 1})))")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' own ratios."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4, 8 words
        df = df.withColumn("_h", _pairs("_h", step))
    twice = F.size("_h") > F.size(F.array_distinct("_h"))
    # windows by hash, then the places of those with an equal neighbour, then the words that they cover
    by_hash = F.expr("array_sort(transform(_h, (h, i) -> struct(h AS h, i AS i)))")
    places = F.expr("array_sort(transform(filter(_s, (x, k) -> (k > 0 AND element_at(_s, greatest(k, 1)).h = x.h) OR (k + 1 < size(_s) AND element_at(_s, least(k + 2, size(_s))).h = x.h)), x -> x.i))")
    covered = F.expr(f"aggregate(_p, struct(0L AS n, {-WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)")
    none = F.lit(None)
    df = df.withColumn("_s", F.when(twice, by_hash).otherwise(none)).withColumn("_p", F.when(F.col("_s").isNotNull(), places).otherwise(none))
    return df.withColumn("_distinct", F.array_distinct("_words")).select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]{{3}}|(?<=\\s)[{SYMBOLS}](?=\\s)")).alias("_n_marks"),
        F.size("_lines").alias("_n_lines"),
        F.size("_distinct").alias("_n_distinct"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_n_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_n_digits"),
        F.regexp_count("_text", F.lit("[.!?]")).alias("_n_stops"),
        F.size(F.array_intersect("_distinct", F.array(*[F.lit(w) for w in FUNCTION_WORDS]))).alias("_n_function"),
    )


# FIXED VALUES: frequent function words of English, German, French and Spanish
FUNCTION_WORDS = ["the", "and", "of", "to", "in", "that", "is", "der", "die", "das", "und", "in", "ist", "mit", "le", "la", "les", "de",
                  "et", "des", "une", "que", "el", "los", "las", "y", "en", "un", "se", "del"]


def votes() -> dict[str, Column]:
    """The rules: when they vote good, when bad; else they abstain."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    symbols, upper = F.col("n_symbols") / n, F.col("_n_upper") / chars
    duplicate = F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    distinct = F.col("_n_distinct") / n
    many = F.col("n_words") >= 50
    return {
        "symbols": vote(symbols < 0.02, symbols > 0.2),
        "marks": vote(F.col("_n_marks") / n < 0.01, F.col("_n_marks") / n > 0.1),  # runs of symbols, or alone
        "word_length": vote(mean.between(3, 9), (mean < 2) | (mean > 14)),
        "upper": vote(upper < 0.2, upper > 0.5),
        "digits": vote(F.col("_n_digits") / chars < 0.05, F.col("_n_digits") / chars > 0.3),
        "duplicate_lines": vote(duplicate < 0.1, duplicate > 0.6),
        "repeated_words": vote(repeat < 0.05, repeat > 0.29),
        "distinct_words": vote(many & (distinct > 0.2), many & (distinct < 0.1)),
        "sentences": vote(many & F.col("_n_stops").between(n / 60, n / 3), many & ((F.col("_n_stops") < n / 200) | (F.col("_n_stops") > n / 1.5))),
        "function_words": vote(F.col("_n_function") >= 2, many & (F.col("_n_function") == 0)),
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 25),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> tuple[float, list[list[dict[int, float]]]]:
    """Expectation-maximisation on (votes, count): share of good documents, and p(vote | kind) of each rule
    (kind 0: bad, 1: good).  It starts from FIRST, the guess by the number of bad votes: rules agree on most
    documents, so a start from equally able rules would let their many good votes outvote every bad one.
    The first guesses stay as pseudo-counts: lightly for bad documents, whose votes are to be learned, but
    heavily for good ones, as a rule that errs on those is no rule."""
    total = sum(n for _, n in patterns)
    pseudo = (2.0, max(2.0, WEIGHT * total))
    weights = [FIRST[min(v.count(-1), 2)] for v, _ in patterns]
    good, p = PRIOR_GOOD, [list(START) for _ in range(rules)]
    for _ in range(ROUNDS if total else 0):
        sums = [[dict.fromkeys((-1, 0, 1), 0.0) for _ in (0, 1)] for _ in range(rules)]
        mass = 0.0
        for (vote, n), w in zip(patterns, weights, strict=True):
            mass += w * n
            for r, v in enumerate(vote):
                sums[r][1][v] += w * n
                sums[r][0][v] += (1 - w) * n
        good = (mass + 2.0 * PRIOR_GOOD) / (total + 2.0)
        kinds = [total - mass, mass]
        p = [[{v: (sums[r][k][v] + pseudo[k] * START[k][v]) / (kinds[k] + pseudo[k]) for v in (-1, 0, 1)} for k in (0, 1)] for r in range(rules)]
        weights = [posterior(v, good, p) for v, _ in patterns]
    return good, p


def posterior(vote: tuple[int, ...], good: float, p) -> float:
    x = math.log(good / (1 - good)) + sum(math.log(p[r][1][v] / p[r][0][v]) for r, v in enumerate(vote) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measures, base_failed, quality (posterior probability of good), kept, the votes.

    The measures are written once to the checkpoint folder, without the texts; the votes are counted there.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rules = votes()
    names = [f"_v_{n}" for n in rules]
    df = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw")), "_raw").drop("_raw")
    df = df.withColumns(dict(zip(names, rules.values(), strict=True))).checkpoint()
    found = df.groupBy(*names).count().collect()  # at most 3 ** rules rows
    good, p = estimate([(tuple(r[:-1]), r[-1]) for r in found], len(names))
    odds = F.lit(math.log(good / (1 - good)))
    for r, n in enumerate(names):
        odds = odds + F.when(F.col(n) == 1, math.log(p[r][1][1] / p[r][0][1])).when(F.col(n) == -1, math.log(p[r][1][-1] / p[r][0][-1])).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    kept = ~F.col("base_failed") & (F.col("quality") >= KEEP)
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality"]
    return df.select("doc_id", *measured, kept.alias("kept"), *[F.col(n).alias(n[3:]) for n in names])
