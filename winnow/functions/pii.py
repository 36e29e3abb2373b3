"""Personal-data patterns and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import strip

# Name, pattern, risk, advice.
PATTERNS = (
    ("Credit Card", r"\b(?:\d[ -]?){13,16}\b", "high", "Mask credit card numbers before export"),
    ("CNIC Pakistan", r"[0-9]{5}-[0-9]{7}-[0-9]", "high", "Mask CNIC numbers before export"),
    ("National ID", r"\b[A-Z]{1,2}[0-9]{6,9}\b", "high", "Mask National ID values before export"),
    ("Email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "medium", "Mask email addresses"),
    ("Phone Pakistan", r"(\+92|0)?[0-9]{10,11}", "medium", "Mask phone numbers"),
    ("Phone International", r"\+?[1-9]\d{1,14}", "medium", "Mask phone numbers"),
    ("IP Address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "low", "Mask IP address data"),
    ("URL", r"https?://[^\s]+", "low", "Review URLs for sensitive query parameters"),
)

# The smaller pattern set, over text columns only.
BASIC_PATTERNS = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "medium"),
    ("phone_pk", r"(\+92|0)?[0-9]{10,11}", "medium"),
    ("cnic", r"[0-9]{5}-[0-9]{7}-[0-9]", "high"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b", "high"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "medium"),
)

# The patterns that addresses and numbers are validated by.
EMAIL_RULE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_QUALITY = r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE_RULE = r"^\+?[0-9\s-]{10,14}$"


def mask_kind(pii_type: str) -> str:
    t = pii_type.lower()
    if t in ("email", "email address"):
        return "email"
    for k in ("phone", "cnic"):
        if k in t:
            return k
    if "credit" in t or "card" in t:
        return "card"
    if t == "ip address":
        return "ip"
    return "other"


def mask(value: Column, kind: str) -> Column:
    v = strip(value)
    last4 = F.right(v, F.lit(4))
    if kind == "email":
        at = F.split(v, "@")
        return F.when(F.size(at) == 2, F.concat(F.substring(at[0], 1, 2), F.lit("***@"), at[1])) \
                .otherwise(F.concat(F.substring(v, 1, 2), F.lit("***")))
    if kind == "phone":
        return F.when(F.length(v) >= 4, F.concat(F.lit("****-****-"), last4)).otherwise("****")
    if kind == "cnic":
        return F.concat(F.substring(v, 1, 5), F.lit("-***-*"))
    if kind == "card":
        d = F.regexp_replace(v, r"\D", "")
        return F.when(F.length(d) >= 4, F.concat(F.lit("**** **** **** "), F.right(d, F.lit(4)))).otherwise("****")
    if kind == "ip":
        q = F.split(v, r"\.")
        return F.when(F.size(q) == 4, F.concat_ws(".", q[0], q[1], F.lit("***"), F.lit("***"))).otherwise(v)
    return F.concat(F.substring(v, 1, 2), F.lit("***"), F.right(v, F.lit(2)))
