"""Text safety scans as array columns of the labels that matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels a scan reports and what it looks for, in ASCII classes so that all engines agree.
INBOUND = (
    ("prompt-injection: ignore-previous", r"(?i)(ignore|disregard|forget|bypass)\s.{0,30}(previous|above|prior|earlier)\s.{0,30}(instructions?|prompt|rules?|constraints?|context)"),
    ("prompt-injection: you-are-now", r"(?i)\byou\s+are\s+now\b"),
    ("prompt-injection: system-prefix", r"(?im)^\s*system\s*:"),
    ("jailbreak: DAN-mode", r"(?i)\bDAN\b.*\bmode\b|\bdo\s+anything\s+now\b"),
    ("prompt-injection: role-play-exfiltration", r"(?i)(pretend|act|roleplay|role-play|imagine)\s.{0,30}(you\s+(are|were|have\s+no)|as\s+(an?\s+)?(ai|assistant|llm))"),
    ("prompt-injection: new-instructions", r"(?i)(new|updated?|different|alternative)\s+(instructions?|directives?|rules?|system\s+prompt)"),
    ("pii: SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("pii: credit-card", r"\b(4[0-9]{12}([0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|6(011|5[0-9]{2})[0-9]{12})\b"),
    ("pii: email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("pii: phone-US", r"\b(\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}\b"),
    ("pii: api-key-literal", r"(?i)\b(sk-[A-Za-z0-9]{32,}|AKIA[0-9A-Z]{16})\b"),
    ("pii: password-literal", r"(?i)\bpassword\s*[:=]\s*\S{6,}"),
)
OUTBOUND = (
    ("pii-leak: SSN", INBOUND[6][1]),
    ("pii-leak: credit-card", INBOUND[7][1]),
    ("pii-leak: api-key", INBOUND[10][1]),
    ("harm: explicit-violence-instruction", r"(?i)\b(how\s+to\s+(make|build|create|synthesize)\s+(a\s+)?(bomb|explosive|weapon|poison|malware|ransomware))\b"),
    ("harm: self-harm-instruction", r"(?i)(step[- ]by[- ]step|instructions?|how\s+to).{0,40}(suicide|self[- ]harm|overdose)"),
    ("harm: credential-exfiltration", r"(?i)(send|email|post|upload|transmit).{0,30}(password|credentials?|api[_\s]key|secret\s+key)"),
)


def _labels(text: Column, patterns: tuple) -> Column:
    return F.filter(F.array(*[F.when(F.regexp_like(text, F.lit(p)), label) for label, p in patterns]), lambda x: x.isNotNull())


def scan_inbound(text: Column) -> Column:
    """struct(verdict, reasons): safe, or blocked with all labels that matched."""
    return _verdict(_labels(F.coalesce(text, F.lit("")), INBOUND))


def scan_outbound(text: Column, n_hits: Column) -> Column:
    """As scan_inbound, for answers; every citation [n] has to name one of n_hits sources."""
    text = F.coalesce(text, F.lit(""))
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1), lambda n: F.try_to_number(n, F.lit("9" * 18)).cast("long"))
    wrong = F.filter(cited, lambda n: n.isNull() | (n < 1) | (n > n_hits))
    return _verdict(F.concat(_labels(text, OUTBOUND), F.transform(wrong, lambda n: F.concat(F.lit("citation: "), n.cast("string")))))


def _verdict(reasons: Column) -> Column:
    return F.struct(F.when(F.size(reasons) > 0, "blocked").otherwise("safe").alias("verdict"), reasons.alias("reasons"))
