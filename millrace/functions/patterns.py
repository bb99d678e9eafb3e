"""Patterns, word lists and tables that decide results.

They are stated as they must be matched; nothing here is logic.
"""

# Formats of whole values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[\d\s\-\(\)]{10,}$"
EMAIL_LOOSE = r"^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE_DIGITS = r"^\+?1?\d{9,15}$"

VALUE_FORMATS = {
    "email": EMAIL,
    "phone": r"^\+?[1-9]\d{1,14}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
}

# Date texts, per type-inference rule.
DATE_SHARE = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"]
DATE_MAJORITY = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{2}-\d{2}-\d{4}"]
DATE_CLASS = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"]
DATE_SOURCE = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"]
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
]

# Words that mean "no value", per operator.
SOURCE_NULLS = ["null", "NULL", "None", "N/A", "n/a", "", "NaN", "nan"]
INVALID_WORDS = ["null", "none", "n/a", "na", "", "undefined", "nil"]
INVALID_WORDS_SIMPLE = ["null", "na", "n/a", "none", ""]

# Column names that suggest personal data.
PII_NAMES = ["email", "mail", "phone", "tel", "ssn", "social", "credit", "card", "passport", "license",
             "address", "name", "firstname", "lastname", "surname"]
TEMPORAL_NAMES = ["time", "date", "created", "updated"]

# Names bound to a validation rule.
RULE_FIELDS = {
    "email_format": ["email", "contact_email", "user_email"],
    "phone_format": ["phone", "telephone", "mobile"],
    "date_format": ["date", "created_at", "updated_at", "timestamp"],
    "non_empty": ["name", "title", "description"],
    "positive_number": ["amount", "price", "quantity", "count"],
}

# Personal data inside texts, with replacements, in this order.
PII = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
PII_MARKS = {
    "email": "[EMAIL_REDACTED]",
    "phone": "[PHONE_REDACTED]",
    "ssn": "[SSN_REDACTED]",
    "credit_card": "[CARD_REDACTED]",
}

# Secrets and identifiers that must not leak.
LEAKS = {
    "credit_card": r"(\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b)",
    "ssn": r"(\b\d{3}-?\d{2}-?\d{4}\b)",
    "email": r"(\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b)",
    "private_key": r"(BEGIN\s+(RSA\s+)?PRIVATE\s+KEY)",
    "password": r"""(password\s*[:=]\s*['"]?[^\s'"]+)""",
    "api_key": r"""(api[_-]?key\s*[:=]\s*['"]?[^\s'"]+)""",
    "secret_key": r"""(secret[_-]?key\s*[:=]\s*['"]?[^\s'"]+)""",
    "access_token": r"""(access[_-]?token\s*[:=]\s*['"]?[^\s'"]+)""",
    "bearer": r"(bearer\s+[a-zA-Z0-9_-]+)",
    "aws_key": r"(\bAKIA[0-9A-Z]{16}\b)",
    "uuid": r"(\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b)",
}

# A word every match of the pattern holds, in lower case.
LEAK_WORDS = {
    "email": "@",
    "private_key": "private",
    "password": "password",
    "api_key": "api",
    "secret_key": "secret",
    "access_token": "access",
    "bearer": "bearer",
    "aws_key": "akia",
}

# Threat patterns with type and severity.
THREATS = [
    ("sql_injection", "high", r"(?i)(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b.*\b(FROM|INTO|SET|WHERE)\b)"),
    ("sql_injection", "high", r"(?i)(--|/\*|\*/|;)"),
    ("script_injection", "high", r"(?i)(<script[^>]*>.*?</script>)"),
    ("script_injection", "medium", r"(?i)(javascript:|vbscript:|onload=|onerror=)"),
    ("path_traversal", "high", r"(?i)(\.\./|\.\.\\|%2e%2e%2f|%2e%2e%5c)"),
    ("command_injection", "critical", r"(?i)(\b(exec|eval|system|shell_exec|passthru|popen|proc_open)\b)"),
]

INJECTIONS = {
    "sql_injection": [
        r"(?i)(union\s+select)",
        r"(?i)(drop\s+table)",
        r"(?i)(delete\s+from)",
        r"(?i)(insert\s+into)",
        r"(?i)(update\s+.*\s+set)",
        r"(?i)(exec\s*\()",
        r"(?i)(execute\s*\()",
        r"(?i)(declare\s+@)",
        r"(?i)(sp_executesql)",
        r"(?i)(\bor\s+\d+\s*=\s*\d+)",
        r"(?i)(\band\s+\d+\s*=\s*\d+)",
        r"(?i)(;\s*drop\s)",
        r"(?i)(0x[0-9a-f]+)",
        r"(?i)(waitfor\s+delay)",
        r"(?i)(benchmark\s*\()",
    ],
    "xss": [
        r"(?i)(<script[^>]*>)",
        r"(?i)(</script>)",
        r"(?i)(javascript:)",
        r"(?i)(on\w+\s*=)",
        r"(?i)(<iframe[^>]*>)",
        r"(?i)(<object[^>]*>)",
        r"(?i)(<embed[^>]*>)",
        r"(?i)(<link[^>]*>)",
        r"(?i)(<meta[^>]*>)",
        r"(?i)(eval\s*\()",
        r"(?i)(document\.(write|writeln))",
        r"(?i)(window\.(open|location))",
        r"(?i)(<img[^>]*onerror)",
        r"(?i)(<svg[^>]*onload)",
    ],
    "path_traversal": [
        r"(\.\.[\\/])",
        r"(\.\.%2f)",
        r"(\.\.%5c)",
        r"(%2e%2e[\\/])",
        r"(%252e%252e)",
        r"(\\.\\.\\)",
        r"(\.\./.*etc/passwd)",
        r"(\.\./.*windows/system32)",
        r"(file://)",
        r"(\.\./.*\.\.)",
    ],
    "command_injection": [
        r"(;\s*\w+)",
        r"(\|\s*\w+)",
        r"(&\s*\w+)",
        r"(`[^`]*`)",
        r"(\$\([^)]*\))",
        r"(>\s*/dev/null)",
        r"(<\s*/dev/null)",
        r"(2>&1)",
        r"(&&\s*\w+)",
        r"(\|\|\s*\w+)",
        r"(rm\s+-rf)",
        r"(curl\s+)",
        r"(wget\s+)",
        r"(nc\s+)",
        r"(netcat\s+)",
    ],
}

# Words that decide the class of a row.
CLASS_WORDS = {
    "phi": ["ssn", "social_security", "medical", "health", "diagnosis", "treatment", "patient"],
    "pci": ["credit_card", "card_number", "cvv", "expiry", "cardholder"],
    "pii": ["email", "phone", "address", "name", "birthday", "birth_date", "personal"],
}
ANONYMIZED_FIELDS = ["email", "phone", "ssn", "social_security_number", "credit_card", "name", "address"]

# Class, days kept, deleted by itself.
RETENTION = [
    ("public", 2555, False),
    ("internal", 1825, True),
    ("confidential", 1095, True),
    ("restricted", 365, True),
    ("pii", 730, True),
    ("phi", 2190, True),
    ("pci", 365, True),
]

SENSITIVE_KEYS = ["password", "secret", "token", "key", "credential"]
# Matched without regard to case.
SENSITIVE_PAIRS = [r"password\s*[=:]\s*\S+", r"token\s*[=:]\s*\S+", r"secret\s*[=:]\s*\S+", r"key\s*[=:]\s*\S+"]

# Statements a guarded query must not hold; the second list counts in strict mode only.
FORBIDDEN_SQL = [
    r"\bdrop\s+table\b",
    r"\bdrop\s+database\b",
    r"\bdelete\s+from\b.*where.*1\s*=\s*1",
    r"\btruncate\s+table\b",
    r"\balter\s+table\b",
    r"\bcreate\s+table\b",
    r"\binsert\s+into\b",
    r"\bupdate\s+.*set\b",
    r";\s*drop\b",
    r";\s*delete\b",
    r"--.*drop\b",
    r"/\*.*\*/",
    r"\bunion\s+.*select\b.*\bfrom\b",
]
STRICT_SQL = [r"\bexec\b", r"\bexecute\b", r"\bsp_\w+", r"\bxp_\w+", r"@@\w+"]

# Message fragment and failure class, first hit wins.
FAILURE_WORDS = [
    ("connection reset", "network"),
    ("timeout", "timeout"),
    ("memory", "resource"),
    ("disk space", "resource"),
    ("authentication", "authentication"),
    ("authorization", "authentication"),
    ("rate limit", "transient"),
    ("temporary", "transient"),
    ("data quality", "data_quality"),
    ("validation", "data_quality"),
    ("permission", "permanent"),
    ("not found", "permanent"),
]

# File name endings per format.
FORMAT_SUFFIXES = {
    "csv": r"\.csv$|\.tsv$",
    "json": r"\.json$|\.jsonl$|\.ndjson$",
    "parquet": r"\.parquet$|\.pq$",
    "xml": r"\.xml$",
    "text": r"\.txt$|\.log$",
    "avro": r"\.avro$",
    "orc": r"\.orc$",
}
RECORDS_PER_FILE = [("csv", 1000), ("json", 500), ("parquet", 10000), ("avro", 5000), ("xml", 100), ("unknown", 100)]
VOLUME_CLASSES = [("small", 10_000), ("medium", 1_000_000), ("large", 100_000_000)]

# Parts of a source address.
API_PATHS = ["/api/", "/v1/", "/v2/", "/rest/", "/graphql"]
DATABASE_PREFIXES = ["postgresql://", "mysql://", "sqlite://", "oracle://", "mssql://", "mongodb://", "redis://", "jdbc:"]
FILE_ENDINGS = [".csv", ".json", ".xml", ".parquet", ".avro", ".orc", ".txt"]
STREAM_WORDS = ["kafka", "kinesis", "pubsub", "eventbridge", "rabbitmq", "activemq"]
QUEUE_WORDS = ["sqs", "sns", "servicebus", "queue"]

# Column-name patterns of a schema.
TIMESTAMP_NAMES = [
    r"\b\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}", r"\btimestamp\b", r"\bcreated_at\b", r"\bupdated_at\b", r"\bdate\b", r"\btime\b"]
INCREMENTAL_NAMES = [r"\bid\b", r"\bkey\b", r"\bsequence\b", r"\bversion\b", r"\bmodified\b"]
GEO_NAMES = [
    r"\blat(itude)?\b", r"\blon(gitude)?\b", r"\bcoordinates?\b", r"\blocation\b", r"\baddress\b", r"\bzip_?code\b",
    r"\bpostal_?code\b"]
