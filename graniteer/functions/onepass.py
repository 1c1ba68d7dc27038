"""All critical detectors in one pass over a text's bytes: what one match covers is closed to the others.

The default mode runs each detector by itself, in built-ins. This mode differs where matches of several types
overlap, where a run of digits covers a later number, and in that limits decide what is tried: a type
at its limit leaves its text to the others.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import CRITICAL

LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9.\-]+")
ADDRESS_END = re.compile(rb"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
#: In order of precedence; an @ and a run of digits need a closer look.
STARTS = {
    "aws_access_key": rb"AKIA[A-Z0-9]{16}",
    "jwt_token": rb"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "email": rb"@",
    "api_key": rb'(?i:api_key|api-secret|access-token)[ \t]*[:=][ \t]*(?:"[A-Za-z0-9_-]+"?|[A-Za-z0-9_-]+)',
    "ssn": rb"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "credit_card": rb"[0-9](?:[ -]*[0-9]){0,15}",
}
MORE_DIGITS = re.compile(rb"[ -]*[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _address(text: bytes, at: int) -> tuple[int, int] | None:
    start = at
    while start and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain and start < at and ADDRESS_END.fullmatch(domain[0]) else None


def _machine(names: tuple[str, ...]) -> re.Pattern[bytes]:
    return re.compile(b"|".join(b"(?P<%s>%s)" % (n.encode(), STARTS[n]) for n in STARTS if n in names))


def scan_bytes(text: bytes, names: tuple[str, ...], per_type: int = 0, total: int = 0) -> list[tuple[str, str, int, int]]:
    """(type, value, start, end) in text order; api_key values once each. 0: no limit."""
    open_names, counts, keys, out, at = tuple(names), dict.fromkeys(names, 0), set(), [], 0
    machine = _machine(open_names) if open_names else None
    while machine and (m := machine.search(text, at)):
        name, (start, end) = m.lastgroup, m.span()
        at, good = end, True
        if name == "email":
            span = _address(text, start)
            good = span is not None
            start, end = span or (start, end)
            at = end
        elif name == "credit_card":
            digits = re.sub(rb"[ -]", b"", m[0])
            good = not MORE_DIGITS.match(text, end) and len(digits) >= 13 and luhn(digits)
        elif name == "api_key":
            good = m[0] not in keys
            keys.add(m[0])
        if not good:
            continue
        out.append((name, text[start:end].decode(), start, end))
        counts[name] += 1
        if total and len(out) >= total:
            break
        if per_type and counts[name] >= per_type:
            open_names = tuple(n for n in open_names if n != name)
            machine = _machine(open_names) if open_names else None
    return out


def critical(text: Column, names: list[str], per_type: int = 0, total: int = 0) -> dict[str, Column]:
    """For each critical type of names, its values in text order; texts without an @, a digit or a key's first letters stay in the JVM."""
    wanted = tuple(n for n in CRITICAL if n in names)
    if not wanted:
        return {}

    @F.pandas_udf(", ".join(f"{n} array<string>" for n in wanted))
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            held = {n: [] for n in wanted}
            for name, value, _, _ in scan_bytes(v.encode("utf-8", "replace"), wanted, per_type, total) if v else ():
                held[name].append(value)
            rows.append(held)
        return pd.DataFrame(rows, columns=list(wanted))

    t = F.coalesce(text, F.lit(""))
    found = run(F.when(t.rlike("[@0-9]|AKIA|eyJ|(?i:api[_-]|access-)"), t))
    return {n: F.coalesce(found[n], F.array().cast("array<string>")) for n in wanted}
