"""Enumerations, their order, and default limits."""

SEVERITIES = ("critical", "high", "medium", "low", "info")

CATEGORIES = (
    "sql-injection",
    "authentication",
    "secrets",
    "dependencies",
    "authorization",
    "dangerous-api",
)

CATEGORY_LABELS = {
    "sql-injection": "SQL Injection",
    "authentication": "Authentication",
    "secrets": "Secrets",
    "dependencies": "Dependencies",
    "authorization": "Authorization",
    "dangerous-api": "Dangerous APIs",
}

CONFIDENCES = ("high", "medium", "low")
VERDICTS = ("confirmed", "likely", "unclear", "refuted")
ECOSYSTEMS = ("npm", "pypi", "maven", "go", "rubygems", "composer")

# Gate strictness: a larger number blocks more merges.
STRICTNESS = {"never": 0, "critical": 1, "high": 2, "medium": 3, "low": 4, "info": 5}

WINDOW_CHOICES = (7, 14, 30, 90, 180)
DEFAULT_WINDOW_DAYS = 30

MAX_FINDINGS_PER_FILE = 25
MAX_FILE_BYTES = 400_000
MAX_FILES_PER_REVIEW = 300
MAX_RENDERED = 40
MAX_INLINE_COMMENTS = 15
SARIF_MAX_RESULTS = 25_000
SARIF_MAX_RESULTS_PER_RULE = 1_000
ADVISORY_CACHE_HOURS = 6
SNIPPET_CHARS = 200
FINGERPRINT_HEX = 20
STATUS_CHARS = 140

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
SARIF_SCORES = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "2.0"}

REVIEWABLE_ACTIONS = ("opened", "reopened", "synchronize", "ready_for_review")
