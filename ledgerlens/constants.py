"""Defaults of the operators.

FIXED VALUES: everything in this module must equal the values the original
pipeline uses, so that results match.  They are stated as plain data; the
operators take them as default arguments and every one can be overridden.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Chunking: window of words and overlap between windows.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100

# Filing types indexed, and the settings used by the filing index.
FILING_TYPES = ["10-Q", "10-K"]
FILING_DATE_MARKER = "FILED AS OF DATE:"
FILING_DATE_SCAN_LINES = 50

# Section patterns per filing type, in the order they are reported.
SECTION_PATTERNS = {
    "10-Q": {
        "MD&A": r"(?:ITEM\s*[2]\.|Management.*Discussion.*Analysis)",
        "RISK_FACTORS": r"(?:ITEM\s*[1]A\.|Risk\s*Factors)",
        "FINANCIAL_STATEMENTS": r"(?:ITEM\s*[1]\.|Financial\s*Statements)",
    },
    "10-K": {
        "MD&A": r"(?:ITEM\s*[7]\.|Management.*Discussion.*Analysis)",
        "RISK_FACTORS": r"(?:ITEM\s*[1]A\.|Risk\s*Factors)",
        "BUSINESS": r"(?:ITEM\s*[1]\.|Description.*Business)",
        "FINANCIAL_STATEMENTS": r"(?:ITEM\s*[8]\.|Financial\s*Statements)",
    },
}
NEXT_ITEM_PATTERN = r"ITEM\s*\d+[A-Z]?\."
TOC_SKIP_CHARS = 10000
SECTION_SEARCH_OFFSET = 100
SECTION_MAX_SPAN = 100000
SECTION_MIN_CHARS = 500
SECTION_KEEP_CHARS = 50000
DOCUMENT_MIN_CHARS = 100

# Event study: rows on each side of the filing date.
PRICE_WINDOW_ROWS = 2

# Retrieval defaults.
ENGINE_TOP_K = 10
ENGINE_OVERFETCH = 10
RETRIEVER_TOP_K = 5
RETRIEVER_OVERFETCH = 3
ANALYST_TOP_K = 5
KEYWORD_TOP_K = 5
VECTOR_COLLECTION_NAME = "earnings_reports"
EMBED_BATCH = 32
EMBEDDING_DIM = 384

# Lexicons.
FINANCIAL_ENTITIES = ["revenue", "earnings", "eps", "ebitda", "margin", "profit",
                      "guidance", "forecast", "outlook", "cash flow"]
POSITIVE_WORDS = ["growth", "increase", "strong", "improved", "positive", "success", "gain"]
NEGATIVE_WORDS = ["decline", "decrease", "weak", "concern", "risk", "challenge", "loss"]
NUMERIC_ENTITY_PATTERNS = [
    r"\$[\d,]+\.?\d*[MBK]?",
    r"\d+\.?\d*%",
    r"\d+\.?\d*[MBK]?\s*(?:dollars|revenue|earnings|profit)",
]

# Query types in the order they are tested; the first hit wins.
QUERY_TYPES = {
    "guidance": ["guidance", "forecast", "outlook", "expect", "project"],
    "risk": ["risk", "concern", "challenge", "threat", "uncertainty"],
    "financial": ["revenue", "earnings", "profit", "margin", "cash flow"],
    "sentiment": ["sentiment", "tone", "optimistic", "pessimistic", "outlook"],
}
QUERY_ROUTES = {"risk": "RISK_FACTORS", "financial": "MD&A"}

# Decomposition into analyst tasks, in this order.
DECOMPOSE_RULES = [
    ("price_analysis", "Analyze price reaction", "price_analyst", ["price", "stock", "reaction"], None),
    ("risk_analysis", "Analyze risk factors", "risk_analyst", ["risk", "concern", "challenge"], "RISK_FACTORS"),
    ("financial_analysis", "Analyze financial metrics", "financial_analyst", ["revenue", "earnings", "guidance"], "MD&A"),
]
DECOMPOSE_FALLBACK = ("general_analysis", "General financial analysis", "financial_analyst", None)
DEFAULT_ANALYST_SECTION = "MD&A"

# Agents registered with the orchestrator: role -> agent name (a section
# specialist exists but is not registered, so its tasks would be skipped).
AGENT_REGISTRY = [
    ("query_decomposer", "Query Decomposer"),
    ("financial_analyst", "Financial Analyst"),
    ("risk_analyst", "Risk Analyst"),
    ("price_analyst", "Price Analyst"),
    ("synthesis", "Synthesis Agent"),
]

# Prompt template of the question-answering engine.
QA_TEMPLATE = """You are a financial analyst expert. Use the following context from SEC filings to answer the question.

Context:
{context}

Question: {question}

Instructions:
- Provide a clear, accurate answer based on the context
- Cite specific information from the filings
- If the context doesn't contain enough information, state that clearly
- Focus on quantifiable data and specific statements

Answer:"""

# Question chains per (ticker, filing date): (chain, question template, section, top_k).
CHAIN_TEMPLATES = [
    ("guidance", "What revenue guidance did {ticker} provide?", None, 10),
    ("guidance", "What EPS guidance did {ticker} provide?", None, 10),
    ("guidance", "What are the key metrics {ticker} mentioned for future performance?", None, 10),
    ("risk", "What are the main risk factors mentioned by {ticker}?", "RISK_FACTORS", 10),
    ("risk", "What operational risks does {ticker} face?", "RISK_FACTORS", 10),
    ("risk", "What market or competitive risks did {ticker} identify?", "RISK_FACTORS", 10),
    ("sentiment", "Analyze the overall tone and sentiment of {ticker}'s management discussion. "
                  "Is it optimistic, cautious, or pessimistic? Provide specific examples.", "MD&A", 10),
    ("compare", "Compare {ticker}'s performance and outlook between {date1} and {date2}. "
                "What changed in terms of revenue, risks, and guidance?", None, 10),
]

# Instruction format of question-answer examples.
INSTRUCTION_CONTEXT_FIELDS = ["pre_text", "context", "input"]
INSTRUCTION_QUESTION_FIELDS = ["question", "instruction"]
INSTRUCTION_ANSWER_FIELDS = ["answer", "output", "response"]
ANSWER_MARKER = "### Answer:"
QA_CONTEXT_DOCS = 3

# Evaluation helpers.
SUBSTANTIVE_MIN_CHARS = 100
SUBSTANTIVE_MARKER = "context"
SUBSTANTIVE_MARKER_WINDOW = 50
PREVIEW_CHARS = 300
TIME_BASELINE_METHOD = "baseline"
TIME_SYSTEM_METHOD = "llm_system"
REPORT_RULE_WIDTH = 50

# Fundamentals: provider field -> output column, in output order.
FUNDAMENTAL_FIELDS = [
    ("marketCap", "market_cap"),
    ("trailingPE", "pe_ratio"),
    ("forwardPE", "forward_pe"),
    ("priceToBook", "price_to_book"),
    ("totalRevenue", "revenue"),
    ("profitMargins", "profit_margin"),
    ("operatingMargins", "operating_margin"),
    ("returnOnEquity", "roe"),
    ("debtToEquity", "debt_to_equity"),
    ("sector", "sector"),
    ("industry", "industry"),
]

# Sample ticker list of the index loader.
SAMPLE_TICKERS = ["AAPL", "MSFT", "GOOGL", "NVDA", "TSLA", "META", "AMZN", "JPM", "V", "WMT"]

# ------------------------------------------------------------ END FIXED VALUES

# Whitespace as Python's str.split() sees it (Unicode White_Space plus the
# information separators U+001C..U+001F).  Written with \x{..} escapes that both
# Java regex and RE2 accept, so the same class runs in Spark and in DuckDB.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
