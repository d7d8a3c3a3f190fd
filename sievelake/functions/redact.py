"""Redaction of credentials by patterns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What opens and closes a private key; a whole block, whatever it
# holds short of the next five hyphens; and a block cut short, of which runs of 16
# base64 letters or more go, parted by line breaks, written out or as backslash
# and n. Loops are possessive, so that the JVM does not recurse per line.
_OPEN, _CLOSE = (rf"-----{w}[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----" for w in ("BEGIN", "END"))
_WHOLE = r"[^-]*(?:-{1,4}[^-]+)*+"
_CUT = r"(?:[ \t]*[A-Za-z0-9+/=]{16,})?(?:(?:\\n|[\r\n])+[ \t]*[A-Za-z0-9+/=]{16,})*+"

# Credential classes and their patterns, in order.
CREDENTIALS = (
    ("private-key", f"{_OPEN}(?:{_WHOLE}{_CLOSE}|{_CUT})"),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("gcp-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("openai-key", r"\bsk-[A-Za-z0-9_\-]{20,}"),
    ("github-token", r"\bgh[posru]_[A-Za-z0-9]{20,}"),
    ("slack-token", r"\bxox[baprs]-[0-9A-Za-z\-]{10,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
)


def redact(text: Column, patterns=CREDENTIALS) -> Column:
    """Every match of every pattern, in order, replaced by its class's marker.
    Applying it again changes nothing."""
    for name, p in patterns:
        text = F.regexp_replace(text, p, f"[REDACTED:{name}]")
    return text


def user_patterns(spec: str) -> tuple[tuple[str, str], ...]:
    """Patterns of a text, one a line, named by their number; blank lines and
    comments go, invalid ones are skipped but keep their number."""
    import re

    out = []
    for i, p in enumerate([x.strip() for x in spec.splitlines() if x.strip() and not x.strip().startswith("#")], 1):
        try:
            re.compile(p)
        except re.error:
            continue
        out.append((str(i), "(?m)" + p))
    return tuple(out)
