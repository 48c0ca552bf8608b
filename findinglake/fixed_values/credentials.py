"""Credential shapes that are removed from text."""

PROVIDER_TOKENS = (
    r"\b(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}\b",
    r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}\b",
    r"\bAIza[A-Za-z0-9_\-]{35}\b",
    r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}\b",
    r"\bnpm_[A-Za-z0-9]{30,}\b",
    r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{10,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)",
)

# A key word anywhere inside a name, then a quoted value of six or more.
ASSIGNED_SECRET = (
    r"((?:passwd|password|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?token"
    r"|client[_-]?secret|private[_-]?key|credential|bearer)(?:[A-Za-z0-9_]*)?\s*[:=]\s*)"
    r"([\"'`])([^\"'`\n]{6,})\2"
)

URL_PASSWORD = r"\b([a-z+]{2,12}:\/\/[^:\s'\"@/]+:)([^@\s'\"]{3,})(@)"

LOG_VALUES = (
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\b(?:A3T[A-Z0-9]|AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\bsk-[A-Za-z0-9_\-]{20,}\b",
    r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{10,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
)

LOG_KEY = r"token|secret|password|passwd|key|authorization|auth|credential|cookie|signature"

MASK = "[redacted]"
TOO_DEEP = "[truncated]"
LOG_DEPTH = 6
