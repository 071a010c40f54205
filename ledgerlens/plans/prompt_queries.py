"""Driver queries for prompts, routing, analysts and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AGENT_REGISTRY, CHAIN_TEMPLATES, DECOMPOSE_FALLBACK, DECOMPOSE_RULES, QUERY_ROUTES, QUERY_TYPES, WS_CLASS
from ..operators import prompts as pr
from ..operators import retrieval as rt
from ..session import materialize
from . import bindings as b
from .eval_queries import _PAIRS, KEY
from .registry import register
from .retrieval_queries import _CENTROIDS, _CORPUS, _sql_template

_STRIP = f"'^{WS_CLASS}+|{WS_CLASS}+$'"
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in b.QUESTION_WORDS) + "]"
_PQ = f"""pq AS (SELECT p_partkey AS query_id,
  'What is the ' || ({_WORDS_SQL})[p_partkey % 8 + 1] || ' for ' || p_name || '?' AS question,
  'T' || CAST(p_partkey % 5 AS VARCHAR) AS ticker, p_partkey % 1500 AS company_key FROM part)"""


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _classify_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(col, ws)} THEN '{t}'" for t, ws in QUERY_TYPES.items()) + " ELSE 'general' END"


def _route_sql(qt: str) -> str:
    return "CASE " + " ".join(f"WHEN {qt} = '{t}' THEN '{s}'" for t, s in QUERY_ROUTES.items()) + " ELSE NULL END"


@register("classify_query", f"WITH {_PQ} SELECT query_id, {_classify_sql('question')} AS query_type FROM pq")
def q_classify_query(spark, sf_dir):
    """#74: first matching type in order guidance, risk, financial, sentiment; else general."""
    q = b.part_questions(spark, sf_dir)
    return pr.route_queries(q).select("query_id", "query_type")


@register("route_query", f"""WITH {_PQ}, c AS (SELECT query_id, {_classify_sql('question')} AS query_type FROM pq)
SELECT query_id, query_type, {_route_sql('query_type')} AS section FROM c""")
def q_route_query(spark, sf_dir):
    """#75: risk -> RISK_FACTORS, financial -> MD&A, others keep the caller's (no) section."""
    return pr.route_queries(b.part_questions(spark, sf_dir)).select("query_id", "query_type", "section")


def _decompose_sql() -> str:
    parts = []
    for i, (tid, desc, role, words, sec) in enumerate(DECOMPOSE_RULES):
        s = f"'{sec}'" if sec else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT query_id, {i} AS o, '{tid}' AS task_id, '{desc}' AS description, '{role}' AS role, "
                     f"{s} AS section FROM pq WHERE {_any('question', words)}")
    fid, fdesc, frole, _ = DECOMPOSE_FALLBACK
    body = " UNION ALL ".join(parts)
    return f"""t AS ({body}),
tf AS (SELECT * FROM t UNION ALL SELECT query_id, 9, '{fid}', '{fdesc}', '{frole}', CAST(NULL AS VARCHAR)
       FROM pq WHERE query_id NOT IN (SELECT query_id FROM t)),
tasks AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS ordinal,
                 task_id, description, role, section FROM tf)"""


@register("decompose_query", f"WITH {_PQ}, {_decompose_sql()} SELECT * FROM tasks")
def q_decompose_query(spark, sf_dir):
    """#76: 0-3 subtasks in the order price, risk, financial; none -> one general task."""
    d = pr.decompose(b.part_questions(spark, sf_dir).select("query_id", "question"))
    return d.select("query_id", F.col("ordinal").cast("int").alias("ordinal"), "task_id", "description", "role",
                    "section")


_AGENTS_SQL = "agents AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{n}')" for r, n in AGENT_REGISTRY) + ") AS a(role, agent_name))"


@register("task_agent_dispatch", f"""WITH {_PQ}, {_decompose_sql()}, {_AGENTS_SQL},
st AS (SELECT query_id, ordinal, CASE WHEN query_id % 7 = 0 THEN 'section_specialist' ELSE role END AS role FROM tasks)
SELECT st.query_id, st.ordinal, st.role, agents.agent_name FROM st JOIN agents USING (role)""")
def q_task_agent_dispatch(spark, sf_dir):
    """#39: each task goes to the agent registered for its role; unregistered roles (every 7th
    question is sent to the unregistered section specialist here) are skipped."""
    d = pr.decompose(b.part_questions(spark, sf_dir).select("query_id", "question"))
    t = d.select("query_id", F.col("ordinal").cast("int").alias("ordinal"),
                 F.when(F.col("query_id") % 7 == 0, F.lit("section_specialist")).otherwise(F.col("role")).alias("role"))
    return pr.dispatch_tasks(t).select("query_id", "ordinal", "role", "agent_name")


def _answer(task_id, query_id):
    return F.concat(F.lit("answer to "), task_id, F.lit(" #"), query_id.cast("string"))


@register("synthesize", f"""WITH {_PQ}, {_decompose_sql()},
r AS (SELECT tasks.*, c.c_acctbal AS pe_ratio, c.c_mktsegment AS sector FROM tasks JOIN pq USING (query_id)
      LEFT JOIN customer c ON c.c_custkey = pq.company_key),
s AS (SELECT query_id, ordinal, CASE
   WHEN role = 'financial_analyst' THEN 'Financial Analysis:' || chr(10) || 'answer to ' || task_id || ' #' || query_id
   WHEN role = 'risk_analyst' THEN 'Risk Analysis:' || chr(10) || CASE WHEN query_id % 3 = 0 THEN '' ELSE 'answer to ' || task_id || ' #' || query_id END
   WHEN role = 'price_analyst' THEN 'Price & Fundamentals:' || chr(10) || 'P/E: ' || coalesce(CAST(pe_ratio AS VARCHAR), 'None')
        || ', Sector: ' || coalesce(sector, 'None') END AS part FROM r)
SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY ordinal) AS synthesis FROM s GROUP BY query_id""")
def q_synthesize(spark, sf_dir):
    """#86: per question, role headings and answers in task order; price line shows P/E and sector."""
    q = b.part_questions(spark, sf_dir)
    tasks = pr.decompose(q.select("query_id", "question", "company_key"))
    resp = tasks.join(b.customer_fundamentals(spark, sf_dir), "company_key", "left").select(
        "query_id", "ordinal", "role",
        F.when((F.col("role") == "risk_analyst") & (F.col("query_id") % 3 == 0), F.lit("")).otherwise(
            _answer(F.col("task_id"), F.col("query_id"))).alias("answer"), F.lit(True).alias("success"), "pe_ratio", "sector")
    return pr.synthesize(resp)


_FILINGS_SQL = """fi AS (SELECT DISTINCT source AS ticker, DATE '2020-01-01' + CAST((doc_id // 400) * 91 AS INTEGER) AS filing_date
  FROM documents)"""


def _tmpl_sql(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


@register("chain_prompts", f"""WITH {_FILINGS_SQL},
tp AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', {_tmpl_sql(t)}, {('CAST(NULL AS VARCHAR)' if s is None else repr(s))}, {k})"
                                         for i, (c, t, s, k) in enumerate(CHAIN_TEMPLATES))})
        AS v(ordinal, chain, tmpl, section, top_k))
SELECT fi.ticker, fi.filing_date, tp.ordinal, tp.chain,
       replace(replace(replace(tp.tmpl, '{{ticker}}', fi.ticker), '{{date1}}', CAST(fi.filing_date AS VARCHAR)),
               '{{date2}}', CAST(fi.filing_date - 91 AS VARCHAR)) AS question, tp.section, tp.top_k
FROM fi, tp""")
def q_chain_prompts(spark, sf_dir):
    """#85: 8 questions per (ticker, filing date); the date is carried, not used as a filter."""
    f = b.synthetic_filings(spark, sf_dir).select("ticker", "filing_date").distinct() \
        .withColumn("prev_date", F.date_sub("filing_date", 91))
    c = pr.chain_prompts(f, compare_date="prev_date")
    return c.select("ticker", "filing_date", "ordinal", "chain", "question", "section", "top_k")


_PREV = """prev AS (SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'assistant')"""


def _instr_sql(ctx: str, q: str, a: str) -> str:
    return (f"'### Context:' || chr(10) || coalesce(nullif({ctx}, ''), '') || chr(10) || chr(10) || '### Question:' "
            f"|| chr(10) || coalesce(nullif({q}, ''), '') || chr(10) || chr(10) || '### Answer:' || chr(10) || "
            f"coalesce(nullif({a}, ''), '')")


def _instr(spark, sf_dir):
    p = b.conversation_pairs(spark, sf_dir)
    c = b.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant") \
        .select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    ex = p.join(c, KEY, "left").select(*KEY, F.lit(None).cast("string").alias("pre_text"), "context",
                                       F.lit("").alias("input"), F.col("reference").alias("question"),
                                       F.lit(None).cast("string").alias("instruction"),
                                       F.col("prediction").alias("answer"))
    return pr.instruction_format(ex, keep=KEY)


@register("instruction_format", f"""WITH {_PAIRS}, {_PREV}
SELECT p.conv_id, p.turn, {_instr_sql('prev.text', 'p.reference', 'p.prediction')} AS text
FROM pairs p LEFT JOIN prev USING (conv_id, turn)""")
def q_instruction_format(spark, sf_dir):
    """#82: context / question / answer from the first non-empty fallback field each."""
    return _instr(spark, sf_dir)


@register("split_answer", f"""WITH {_PAIRS}, {_PREV},
i AS (SELECT p.conv_id, p.turn, {_instr_sql('prev.text', 'p.reference', 'p.prediction')} AS text
      FROM pairs p LEFT JOIN prev USING (conv_id, turn))
SELECT conv_id, turn, string_split(text, '### Answer:')[1] || '### Answer:' AS prompt,
       regexp_replace(string_split(text, '### Answer:')[2], {_STRIP}, '', 'g') AS reference,
       regexp_replace(string_split(text, '### Answer:')[-1], {_STRIP}, '', 'g') AS prediction FROM i""")
def q_split_answer(spark, sf_dir):
    """#83: prompt up to the marker, reference = second part, prediction = last part (stripped)."""
    i = _instr(spark, sf_dir)
    parts = pr.split_answer(F.col("text"), F.col("text"))
    return i.select(*KEY, parts["prompt"].alias("prompt"), parts["reference"].alias("reference"),
                    parts["prediction"].alias("prediction"))


@register("strip_prompt_echo", f"""WITH {_PAIRS},
g AS (SELECT conv_id, turn, reference AS prompt,
             CASE WHEN conv_id % 2 = 0 THEN reference || ' ' || prediction ELSE prediction END AS generated FROM pairs)
SELECT conv_id, turn, CASE WHEN contains(generated, prompt)
  THEN regexp_replace(substr(generated, length(prompt) + 1), {_STRIP}, '', 'g')
  ELSE regexp_replace(generated, {_STRIP}, '', 'g') END AS answer FROM g""")
def q_strip_prompt_echo(spark, sf_dir):
    """#84: an echoed prompt is cut by its length, then the answer is stripped."""
    p = b.conversation_pairs(spark, sf_dir)
    gen = F.when(F.col("conv_id") % 2 == 0, F.concat_ws(" ", "reference", "prediction")).otherwise(F.col("prediction"))
    return p.select(*KEY, pr.strip_prompt_echo(gen, F.col("reference")).alias("answer"))


_DOCS3 = """docs3 AS (SELECT doc_id % 100 AS ticker, doc_id, text,
  row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS rn FROM documents)"""


@register("qa_context_join", f"""WITH {_PAIRS}, {_DOCS3},
ctx AS (SELECT ticker, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS context FROM docs3 WHERE rn <= 3
        GROUP BY ticker)
SELECT p.conv_id, p.turn, {_instr_sql('coalesce(ctx.context, \'\')', 'p.reference', 'p.prediction')} AS text
FROM pairs p LEFT JOIN ctx ON ctx.ticker = p.conv_id""")
def q_qa_context_join(spark, sf_dir):
    """#35: first 3 documents of the pair's key as context (left join; no match -> empty)."""
    p = b.conversation_pairs(spark, sf_dir).withColumn("ticker", F.col("conv_id"))
    d = b.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("ticker"), "doc_id", "text")
    j = pr.qa_context_join(p, d)
    return j.select(*KEY, pr.instruction_text(F.col("context"), F.coalesce(F.nullif("reference", F.lit("")), F.lit("")),
                                              F.coalesce(F.nullif("prediction", F.lit("")), F.lit(""))).alias("text"))


@register("first_n_per_key", f"WITH {_DOCS3} SELECT ticker, doc_id FROM docs3 WHERE rn <= 3")
def q_first_n_per_key(spark, sf_dir):
    """#60: first 3 rows per key (row_number <= 3, WindowGroupLimit)."""
    d = b.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("ticker"), "doc_id")
    return pr.first_n_per_key(d, "ticker", ["doc_id"], 3)


@register("range_slice", f"""WITH {_PAIRS},
o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER () AS total FROM pairs)
SELECT conv_id, turn, pos AS _pos, CASE WHEN pos < 100 THEN 'train' ELSE 'test' END AS split FROM o
WHERE pos < 100 OR (pos >= least(200, total - 50) AND pos < least(200, total - 50) + 50)""")
def q_range_slice(spark, sf_dir):
    """#66: first 100 pairs for training; 50 test pairs from min(n + 100, total - 50)."""
    p = b.conversation_pairs(spark, sf_dir).select(*KEY)
    return pr.range_slice(p, KEY, 100, 50).select(*KEY, "_pos", "split")


@register("head_n", f"""SELECT user_id AS ticker, ts AS filing_date FROM events WHERE event_type = '{b.EVENT_FILING_TYPE}'
ORDER BY ticker, filing_date LIMIT 10""")
def q_head_n(spark, sf_dir):
    """#65: first 10 rows of the sorted filing index."""
    f = b.event_filings(spark, sf_dir)
    return pr.head_n(f, [F.col("ticker"), F.col("filing_date").asc_nulls_last()], 10).select("ticker", "filing_date")


@register("sort_index", f"""SELECT user_id AS ticker, ts AS filing_date, event_type AS filing_type FROM events
WHERE event_type = '{b.EVENT_FILING_TYPE}' ORDER BY ticker, filing_date NULLS LAST""")
def q_sort_index(spark, sf_dir):
    """#67: index ordered by ticker then date, missing dates last."""
    return pr.sort_index(b.event_filings(spark, sf_dir))


# ------------------------------------------------------------------ analysts and compositions
def _vec_questions(spark, sf_dir):
    """Every part question, with the centroid of label p_partkey % 10 as its vector and a year for two of three."""
    q = materialize(b.label_centroids(spark, sf_dir).withColumnRenamed("query_id", "_label"))  # the questions are read several times
    p = b.part_questions(spark, sf_dir).withColumn("year", F.when(F.col("query_id") % 3 > 0, F.lit(2019) + F.col("query_id") % 4).cast("int"))
    return p.join(F.broadcast(q), F.col("query_id") % 10 == F.col("_label")).drop("_label")


@register("section_specialist", f"""WITH {_CORPUS}, {_CENTROIDS},
sq AS (SELECT p_partkey AS query_id, lc.embedding, CASE WHEN p_partkey % 3 > 0 THEN 2019 + p_partkey % 4 END AS year FROM part JOIN lc ON p_partkey % 10 = lc.label),
d AS (SELECT sq.query_id, sq.year, c.id, c.filing_date,
        list_sum(list_transform(range(1, len(sq.embedding) + 1),
          lambda i: (CAST(sq.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))
                  * (CAST(sq.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS distance
      FROM sq, corpus c WHERE c.section = 'RISK_FACTORS'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r0 FROM d),
f AS (SELECT * FROM r WHERE r0 <= 50 AND (year IS NULL OR contains(CAST(filing_date AS VARCHAR), CAST(year AS VARCHAR))))
SELECT query_id, rank, id FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM f) WHERE rank <= 5""")
def q_section_specialist(spark, sf_dir):
    """#91: fixed-section analyst (RISK_FACTORS) over all part questions, each with its own year, k = 5, x10 overfetch."""
    qs = _vec_questions(spark, sf_dir).select("query_id", "embedding", "year")
    r = rt.vector_topk_overfetch_year(qs, b.vector_corpus(spark, sf_dir), 5, year_col="year", overfetch=10, filters={"section": "RISK_FACTORS"})
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@register("price_analyst", f"""WITH px AS (SELECT user_id, ts, value FROM events WHERE event_type <> '{b.EVENT_FILING_TYPE}')
SELECT px.user_id AS ticker, px.ts, round(px.value, 6) AS close, round(c.c_acctbal, 6) AS pe_ratio, c.c_mktsegment AS sector
FROM px LEFT JOIN customer c ON c.c_custkey = px.user_id
WHERE px.ts >= (SELECT max(ts) FROM px) - INTERVAL 365 DAY""")
def q_price_analyst(spark, sf_dir):
    """#92: the trailing year of every ticker's series with its fundamentals."""
    from ..sources.prices import price_analyst

    f = b.customer_fundamentals(spark, sf_dir).withColumnRenamed("company_key", "ticker")
    return price_analyst(b.event_prices(spark, sf_dir), f).select("ticker", "ts", "close", "pe_ratio", "sector")


_RAG = f"""WITH {_CORPUS}, {_CENTROIDS}, {_PQ},
qq AS (SELECT pq.query_id, lc.embedding, pq.question, pq.ticker, {_classify_sql('pq.question')} AS query_type,
              CASE WHEN pq.query_id % 3 > 0 THEN 2019 + pq.query_id % 4 END AS year FROM lc JOIN pq ON pq.query_id % 10 = lc.label),
qr AS (SELECT *, {_route_sql('query_type')} AS section FROM qq),
d AS (SELECT qr.query_id, c.id, c.ticker, c.filing_type, c.filing_date, c.section, c.text,
        list_sum(list_transform(range(1, len(qr.embedding) + 1),
          lambda i: (CAST(qr.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))
                  * (CAST(qr.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS distance
      FROM qr, corpus c WHERE c.ticker = qr.ticker AND (qr.section IS NULL OR c.section = qr.section)),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r0 FROM d) WHERE r0 <= 100),
h AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM w JOIN qr USING (query_id)
                     WHERE qr.year IS NULL OR contains(CAST(w.filing_date AS VARCHAR), CAST(qr.year AS VARCHAR)))
      WHERE rank <= 10),
ctx AS (SELECT query_id, string_agg('[Source ' || rank || '] ' || ticker || ' - ' || filing_type || ' ('
          || strftime(CAST(filing_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || ') - ' || section || ':' || chr(10) || text,
          chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id)"""


@register("rag_query", _RAG + f"""
SELECT qr.query_id, qr.query_type, {_sql_template("coalesce(ctx.context, '')", 'qr.question')} AS prompt,
       coalesce((SELECT string_agg(h.id || ':' || h.rank, ',' ORDER BY h.rank) FROM h WHERE h.query_id = qr.query_id), '') AS sources
FROM qr LEFT JOIN ctx USING (query_id)""")
def q_rag_query(spark, sf_dir):
    """#93: table of questions -> route -> filtered top-10 -> context -> prompt (generation is a hook)."""
    from .compositions import rag_prompts

    qs = _vec_questions(spark, sf_dir).select("query_id", "embedding", "question", "ticker", "year")
    sources = F.array_join(F.transform("sources", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["rank"].cast("string"))), ",")
    return rag_prompts(qs, b.vector_corpus(spark, sf_dir), top_k=10).select("query_id", "query_type", "prompt", sources.alias("sources"))
