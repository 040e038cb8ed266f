"""Patterns and word lists that decide results."""

# Personal-data patterns, in the order in which they are listed and tried.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

# Standard column names and the spellings that map to them. The first standard name that
# lists a spelling wins.
COLUMN_SYNONYMS = {
    "id": ["id", "identifier", "uid", "key"],
    "name": ["name", "full_name", "fullname", "customer_name"],
    "email": ["email", "e_mail", "mail", "email_address"],
    "phone": ["phone", "telephone", "mobile", "phone_number"],
    "address": ["address", "street", "location"],
    "date": ["date", "timestamp", "created_at", "updated_at"],
    "price": ["price", "cost", "amount", "value"],
    "quantity": ["quantity", "qty", "count", "amount"],
}

# Words that may not be used bare as an SQL identifier.
RESERVED_WORDS = frozenset([
    "user", "order", "group", "select", "from", "where", "insert", "update", "delete", "create", "drop", "table",
    "index", "primary", "key", "foreign", "references", "constraint", "check", "unique", "not", "null", "default",
    "distinct", "count", "sum", "avg", "max", "min", "join", "inner", "outer", "left", "right", "on", "as", "and",
    "or", "in", "like", "between", "exists",
])

# Phrases that mark a question as one that needs a query.
QUERY_PHRASES = [
    "show me", "list", "find", "get", "select", "filter", "where",
    "top", "bottom", "highest", "lowest", "maximum", "minimum",
    "count", "sum", "average", "group by", "sort", "order",
]

# Patterns counted per text column. Letters and digits are meant in the Unicode sense.
HAS_DIGIT = r"\d"
HAS_SPECIAL = r"[^\p{L}\p{N}_\s]"
STARTS_WITH_DIGIT = r"^\d"
EMAIL_LIKE = r"@.*\."
URL_LIKE = r"http[s]?://"
PHONE_LIKE = r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"
DATE_LIKE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"
WHOLE_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

# Texts that a delimited file uses for a missing cell.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Control characters removed before text is shown.
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
