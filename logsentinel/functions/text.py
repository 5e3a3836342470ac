"""Column functions on text: redaction, percent-decoding, excerpts, ISO timestamps, regex dialect."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE = 8192
MAX_EXCERPT = 500

#: Redaction patterns in order, with flags and replacement (fixed values).
REDACTIONS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "s", "[REDACTED]"),
    (r"([a-zA-Z][a-zA-Z0-9+.-]{0,32}://)[^\s/]+@", "", "$1[REDACTED]@"),
    (r"(authorization\s*[=:]\s*)(?:bearer\s+)?\S+", "i", "$1[REDACTED]"),
    (r"(\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|credential|private[_-]?key)\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|\S+)", "i", "$1[REDACTED]"),
    (r"\bgithub_pat_[A-Za-z0-9_]+", "", "[REDACTED]"),
    (r"\bgh[posur]_[A-Za-z0-9]+", "", "[REDACTED]"),
    (r"\bsk-ant-[A-Za-z0-9-]+", "", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9-]{16,}", "", "[REDACTED]"),
    (r"\bglpat-[A-Za-z0-9_-]+", "", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]+", "", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "", "[REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "", "[REDACTED_EMAIL]"),
)


#: What a text must hold, in lower case, for each pattern to match at all; letters that fold to ASCII ones stand for any.
MARKERS = (
    ("private key-----",), ("://",), ("authorization",), ("passw", "pwd", "secret", "token", "credential", *(f"{a}{b}key" for a in ("api", "access", "private") for b in ("", "_", "-"))),
    ("github_pat_",), ("ghp_", "gho_", "ghs_", "ghu_", "ghr_"), ("sk-ant-",), ("sk-",), ("glpat-",), ("xox",), ("akia",), ("@",),
)
FOLDING = ("\u017f", "\u0131", "\u212a", "\u0130")


def java_regex(pattern: str, flags: str = "") -> str:
    """A Python pattern for Java's engine: Unicode classes, only \\n ends a line, named groups respelled."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return f"(?Ud{flags}){out}"


def redact(text: Column) -> Column:
    """Secrets and e-mail addresses replaced by placeholders. A pattern only runs on texts that hold one of its markers:
    placeholders bring none, so the markers are looked for once, in the text as it comes.

    No secret that one pass finds is left for a second one, but a second pass may change more: of ``token = "x"###`` the
    quoted value goes and ``###`` stays, and then placeholder and rest stand together as one value without quotes, so that
    the rest goes too. Texts in which no quoted value runs into other characters stay as the first pass leaves them."""

    def bound(value: Column, then) -> Column:  # the value is computed once, however often then refers to it
        return F.element_at(F.transform(F.array(value), then), 1)

    def replaced(has: Column, pattern: str, new: str):
        return lambda t: F.when(has, F.regexp_replace(t, pattern, new)).otherwise(t)

    def run(seen: Column) -> Column:
        out = seen["text"]
        folds = reduce(Column.__or__, [seen["text"].contains(c) for c in FOLDING])
        for (pattern, flags, new), markers in zip(REDACTIONS, MARKERS, strict=True):
            has = reduce(Column.__or__, [seen["low"].contains(m) for m in markers])
            if "i" in flags:
                has = has | folds
            out = bound(out, replaced(has, java_regex(pattern, flags), new))
        return out

    return bound(F.struct(text.alias("text"), F.lower(text).alias("low")), run)


def redact_short(text: Column) -> Column:
    """The same without looking for markers first: for log lines, where a smaller plan is worth more."""
    for pattern, flags, new in REDACTIONS:
        text = F.regexp_replace(text, java_regex(pattern, flags), new)
    return text


def redact_text(text: object) -> str:
    """The same for driver-side strings (log records, errors)."""
    out = text if isinstance(text, str) else str(text)
    for pattern, flags, new in REDACTIONS:
        out = re.sub(f"(?{flags}){pattern}" if flags else pattern, new.replace("$1", r"\g<1>"), out)
    return out


def excerpt(raw: Column, message: Column) -> Column:
    return F.substring(redact_short(F.coalesce(F.when(raw != "", raw), message, F.lit(""))), 1, MAX_EXCERPT)


def unquote(text: Column) -> Column:
    """Percent-decoding in one pass: '+' stays, malformed escapes stay, bad UTF-8 becomes U+FFFD."""
    escaped = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(escaped)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; null text matches nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(java_regex(p))
    return F.coalesce(hit, F.lit(False))


def any_prefix(text: Column, prefixes: list[str]) -> Column:
    """Whether text starts with any prefix; no prefixes accept all; null text is empty."""
    if not prefixes:
        return F.lit(True)
    text, hit = F.coalesce(text, F.lit("")), F.lit(False)
    for p in prefixes:
        hit = hit | text.startswith(p)
    return hit
