"""Prices, limits, patterns and word lists that results depend on."""

from __future__ import annotations

# --- Fixed values: USD per token, exact-name price table -------------------
TOKEN_PRICES = {
    "gpt-4o": ("0.0000025", "0.00001"),
    "gpt-4o-2024-08-06": ("0.0000025", "0.00001"),
    "gpt-5.1-codex-mini": ("0.00000003", "0.00000006"),
    "gpt-5.2": ("0.000000075", "0.0000003"),
    "gpt-5.2-2025-12-11": ("0.000000075", "0.0000003"),
    "gpt-5-mini": ("0.00000025", "0.000002"),
    "gpt-5-mini-2025-08-07": ("0.00000025", "0.000002"),
    "gpt-5-nano": ("0.00000005", "0.0000004"),
    "gpt-5-nano-2025-08-07": ("0.00000005", "0.0000004"),
    "gemini-3-flash-preview": ("0.000000075", "0.0000003"),
    "gemini-2.5-pro": ("0.00000125", "0.000005"),
}
TOKEN_PRICE_DEFAULT = ("0.00000025", "0.000002")

# --- Fixed values: USD per million tokens, fuzzy-name price table ----------
MILLION_PRICES = {
    "gpt-5.1-codex-mini": (0.03, 0.06),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5-nano": (0.05, 0.40),
    "gpt-5.2": (1.75, 14.00),
    "gpt-4o": (2.50, 10.00),
    "gemini-3-flash-preview": (0.075, 0.30),
    "gemini-2.5-flash": (0.075, 0.30),
    "gemini-2.5-pro": (1.25, 5.00),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-pro": (1.25, 5.00),
}
MILLION_PRICE_DEFAULT = (0.10, 0.30)

# --- Fixed values: subscription tiers --------------------------------------
# tier, monthly tokens, parsed pages, search queries, storage GB, order
TIERS = [
    ("free", 8_000_000, 50, 100, "1.00", 1),
    ("pro", 40_000_000, 500, 1_000, "10.00", 2),
    ("enterprise", 150_000_000, 5_000, 10_000, "100.00", 3),
]
UPGRADE_PATH = {"free": "pro", "pro": "enterprise"}
ALERT_PERCENT = 80
PRESET_DAYS = {"7d": 7, "14d": 14, "21d": 21, "28d": 28, "30d": 30, "90d": 90}
BULK_TOKENS_PER_DOCUMENT = 2_000

# --- Fixed values: personal-data patterns (matched case-insensitively) -----
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date_of_birth": r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])[-/](?:19|20)\d{2}\b",
}

# --- Fixed values: utterance patterns --------------------------------------
CONVERSATIONAL_PATTERNS = [
    r"\bprevious\s+query\b", r"\bprevious\s+question\b",
    r"\bwhat\s+did\s+i\s+ask\b", r"\bwhat\s+i\s+asked\b",
    r"\bmy\s+last\s+question\b", r"\bmy\s+previous\b",
    r"\bdo\s+you\s+remember\b", r"\bremember\s+when\s+i\b",
    r"\bearlier\s+i\s+(asked|said)\b", r"\bbefore\s+i\s+(asked|said)\b",
    r"\bour\s+conversation\b", r"\bour\s+chat\b",
    r"\bwhat\s+we\s+(talked|discussed)\b", r"\bwhat\s+was\s+my\b",
]
RAG_PATTERNS = [
    r"\bwhat\b", r"\bwho\b", r"\bwhen\b", r"\bwhere\b", r"\bwhy\b", r"\bhow\b",
    r"\bfind\b", r"\bsearch\b", r"\blook\s+for\b", r"\btell\s+me\s+about\b",
    r"\bexplain\b", r"\bdescribe\b", r"\banswer\b", r"\bquery\b",
    r"\bshow\s+me\b", r"\bget\s+info\b", r"\binformation\s+about\b",
    r"\bcan\s+you\s+tell\b", r"\bdo\s+you\s+know\b",
]
GENERATION_PATTERNS = [
    r"\bgenerate\b", r"\bcreate\b", r"\bsummarize\b", r"\bsummary\b",
    r"\bfaq\b", r"\bfaqs\b", r"\bquestions?\b", r"\bquiz\b",
    r"\bextract\b", r"\bproduce\b", r"\bmake\b", r"\bbuild\b",
    r"\bwrite\b", r"\bcompose\b", r"\bdraft\b",
    r"\bcomprehension\s+questions\b", r"\bstudy\s+questions\b",
]
LOAD_PATTERNS = [
    r"\bload\b", r"\bopen\b", r"\bread\b", r"\bfetch\b",
    r"\bget\s+document\b", r"\bget\s+file\b",
]
ALL_TOOLS = [
    "document_loader", "summary_generator", "faq_generator",
    "question_generator", "content_persist", "rag_search",
]
INTENT_TOOLS = {
    "rag_search": ["rag_search"],
    "content_generation": [
        "document_loader", "summary_generator", "faq_generator",
        "question_generator", "content_persist",
    ],
    "document_load": ["document_loader"],
    "conversational": [],
    "mixed": ALL_TOOLS,
}

# --- Fixed values: extraction ----------------------------------------------
ENTITY_ID_FIELDS = [
    "invoice_id", "invoice_number", "invoice_no",
    "order_id", "order_number", "order_no",
    "po_number", "po_id", "purchase_order_number",
    "contract_id", "contract_number", "contract_no",
    "receipt_id", "receipt_number", "receipt_no",
    "quote_id", "quote_number",
    "bill_id", "bill_number",
    "reference_number", "reference_id", "ref_number",
]
# schema type -> Spark SQL type (anything else is a string)
SCHEMA_TYPES = {
    "string": "string",
    "text": "string",
    "number": "decimal(12,2)",
    "currency": "decimal(12,2)",
    "integer": "int",
    "date": "date",
    "boolean": "boolean",
}
# field data type -> template type (anything else is "string")
TEMPLATE_TYPES = {
    "string": "string", "text": "string",
    "number": "number", "float": "number", "currency": "number",
    "integer": "integer",
    "date": "string", "datetime": "string",
    "boolean": "boolean", "bool": "boolean",
    "array": "array", "list": "array",
    "object": "object",
}

# --- Fixed values: spreadsheet questions -----------------------------------
FINANCIAL_TERMS = [
    "revenue", "sales", "income", "profit", "earnings",
    "cost", "expense", "total", "sum", "amount",
]
QUARTER_TERMS = ["q1", "q2", "q3", "q4", "quarter"]
FISCAL_YEAR = "25"
MAX_DISPLAY_ROWS = 100
MAX_SQL_ROWS = 10_000
WRITE_KEYWORDS = [
    "DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE",
    "TRUNCATE", "EXEC", "EXECUTE", "GRANT", "REVOKE",
]

# --- Fixed values: accepted file extensions, one set per entry point -------
SHEET_EXTENSIONS = [".xlsx", ".xls", ".csv", ".tsv"]
UPLOAD_EXTENSIONS = [
    ".pdf", ".docx", ".doc", ".pptx", ".ppt",
    ".xlsx", ".xls", ".txt", ".md", ".csv",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff",
]
FOLDER_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".ppt", ".pptx",
    ".txt", ".rtf", ".xlsx", ".xls", ".csv",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp",
    ".html", ".htm",
]
MAX_FOLDER_DOCUMENTS = 10
MAX_FILE_BYTES = 50 * 1024 * 1024
QUIET_SECONDS = 60
MAX_RETRIES = 3
CONCURRENT_DOCUMENTS = 3

# --- Fixed values: sessions, memory, cache ---------------------------------
SESSION_GAP_SECONDS = 30 * 60
ADMIT_MAX = 10
ADMIT_WINDOW_SECONDS = 60
HISTORY_MAX = 20
DIGEST_MESSAGES = 6
DIGEST_CHARS = 100
SIMILARITY_THRESHOLD = 0.85
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 100
TRUNCATE_AT = [8_000, 12_000, 15_000]
PREVIEW_CHARS = 500
CHARS_PER_PAGE = 3_000

# --- Fixed values: audit actions and activity wording ----------------------
DOWNLOAD_EVENTS = [
    "document_loaded", "document_agent_query", "cache_hit", "generation_cache_hit",
]
CREATE_EVENTS = [
    "summary_generated", "faqs_generated", "questions_generated",
    "content_generated", "generation_started", "generation_completed",
]
ACTIVITY_TITLES = {
    "generation_started": "Generation Started",
    "generation_completed": "Generation Completed",
    "generation_cache_hit": "Cache Hit",
    "parse_started": "Parsing Started",
    "parse_completed": "Parsing Completed",
    "document_loaded": "Document Loaded",
    "document_agent_query": "Document Query",
    "summary_generated": "Summary Generated",
    "faqs_generated": "FAQs Generated",
    "questions_generated": "Questions Generated",
    "content_generated": "Content Generated",
    "error": "Error Occurred",
    "cache_hit": "Cache Hit",
    "document_uploaded": "Document Uploaded",
    "document_parsed": "Document Parsed",
    "extraction_started": "Extraction Started",
    "extraction_completed": "Extraction Completed",
}
# {f} = file name or "document", {g} = generation type or "content",
# {e} = first 50 characters of the error
ACTIVITY_SENTENCES = {
    "generation_completed": "Generated {g} for {f}",
    "generation_cache_hit": "Retrieved cached {g} for {f}",
    "generation_started": "Started generating {g} for {f}",
    "parse_completed": "Parsed {f}",
    "parse_started": "Started parsing {f}",
    "document_loaded": "Loaded {f}",
    "document_agent_query": "Processed query on {f}",
    "summary_generated": "Generated summary for {f}",
    "faqs_generated": "Generated FAQs for {f}",
    "questions_generated": "Generated questions for {f}",
    "content_generated": "Generated all content for {f}",
    "error": "Error processing {f}: {e}",
    "cache_hit": "Cache hit for {f}",
    "document_uploaded": "Uploaded {f}",
    "extraction_completed": "Extracted data from {f}",
}

# --- Fixed values: bulk document states ------------------------------------
IN_PROGRESS_STATES = ["parsing", "parsed", "indexing", "indexed", "generating"]
CANCELLABLE_STATES = ["pending", *IN_PROGRESS_STATES]
