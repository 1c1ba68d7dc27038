"""Detectors of sensitive values, as expressions over a text column; each gives an array of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .content import let

# The patterns and words below must be what the contract of each type says.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
SPACE = r"[\t\n\f\r ]"
CRITICAL = ("email", "credit_card", "ssn", "api_key", "aws_access_key", "jwt_token")
LONG_TAIL = {
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone_number": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "street_address": r"\b\d{1,5}\s+[A-Za-z0-9]+(?:\s+[A-Za-z0-9]+)*\s+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr)\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "uk_nin": r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b",
    "eu_vat": r"\b[A-Z]{2}[0-9A-Z]{8,12}\b",
    "india_aadhaar": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "china_id": r"\b\d{17}[0-9Xx]\b",
}
#: What a match can begin with; looked at before the dearer word edge.
FIRST = {"ip_address": r"(?=\d)", "phone_number": r"(?=[(\d])", "iban": "(?=[A-Z])", "uk_nin": "(?=[A-Z])", "eu_vat": "(?=[A-Z])", "india_aadhaar": r"(?=\d)", "china_id": r"(?=\d)"}
STREET_WORDS = ("street", "avenue", "road", "lane", "drive")
STREET_ENDS = re.search(r"\(\?:(Street[^)]*)\)", LONG_TAIL["street_address"])[1]


WORDY = r"(?:\\d|(?<!\\)\[[A-Za-z0-9-]+\])"
WORDY_NEXT = re.compile(rf"{WORDY}(?![?*]|\{{0)")
WORDY_BEFORE = re.compile(rf"(?<!\\){WORDY}(?:\+|\{{[1-9]\d*(?:,\d*)?\}})?$")


def _edge(before: str, after: str) -> str:
    """A word edge; one look-around is enough where the neighbour in the pattern is a word character for sure."""
    if WORDY_NEXT.match(after):
        return "(?<![0-9A-Za-z_])"
    return "(?![0-9A-Za-z_])" if WORDY_BEFORE.search(before) else EDGE


def to_java(pattern: str) -> str:
    """A linear-time regex's dialect in Java's: ASCII word edges and spaces, named groups. Raises ValueError for what cannot be said."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\b", r"\B") and not in_class:
            out.append(_edge(pattern[:i], pattern[i + 2 :]) if two == r"\b" else f"(?!{EDGE})")
        elif two == r"\s":
            out.append(SPACE[1:-1] if in_class else SPACE)
        elif two == r"\S" and not in_class:
            out.append("[^" + SPACE[1:])
        elif two in (r"\C", r"\S", r"\B", r"\b"):
            raise ValueError(f"cannot be translated: {pattern}")
        elif two.startswith("\\"):
            out.append(two)
        elif pattern.startswith("(?P<", i) and not in_class:
            out.append("(?<")
            i += 2
        elif re.match(r"\(\?(?:[=!]|<[=!])", pattern[i:]) and not in_class:
            raise ValueError("look-around is not part of the dialect")
        else:
            c = pattern[i]
            in_class = c == "[" or in_class and c != "]"
            out.append(c)
            i -= 1
        i += 2
    return "".join(out)


def at_least(text: Column, chars: str, n: int) -> Column:
    """Whether so many characters of a class occur; reading ends with the n-th."""
    return text.rlike(rf"\A(?:[^{chars}]*+[{chars}]){{{n}}}")


def gate(name: str, text: Column) -> Column:
    """Whether a long-tail pattern is tried at all; part of the result's definition."""
    digits, letters, both = "0-9", "A-Za-z", "0-9A-Za-z"
    low = F.lower(text)
    return {
        "ip_address": at_least(text, digits, 4) & text.contains("."),
        "phone_number": at_least(text, digits, 10),
        "street_address": at_least(text, digits, 1) & text.rlike("[ \t]") & F.greatest(*[low.contains(w) for w in STREET_WORDS]),
        "iban": at_least(text, letters, 2) & at_least(text, digits, 2) & at_least(text, both, 15),
        "uk_nin": at_least(text, letters, 2) & at_least(text, digits, 6),
        "eu_vat": at_least(text, letters, 2) & at_least(text, both, 8),
        "india_aadhaar": at_least(text, digits, 12),
        "china_id": at_least(text, digits, 17),
    }.get(name, F.lit(True))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def email(text: Column) -> Column:
    """Around every @: the longest local part and domain, whose last label has letters only, two or more."""
    p = F.split(text, "@", -1)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
        lambda k: F.concat(F.regexp_extract(F.element_at(p, k), r"[A-Za-z0-9._%+\-]+\z", 0), F.lit("@"), F.regexp_extract(F.coalesce(F.try_element_at(p, k + 1), F.lit("")), r"^[A-Za-z0-9.\-]+", 0)),
    )
    found = F.filter(each, lambda x: x.rlike(r"^[^@]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"))
    return F.when(text.contains("@"), found).otherwise(_none())


def credit_card(text: Column) -> Column:
    """Runs of digits with spaces and dashes, in steps of 16; 13 to 16 at the end that pass the Luhn check."""
    run = r"(\d(?:[ -]*+\d){0,15}+)(?=([ -]*\d)?)"
    both = F.arrays_zip(_all(text, run, 1).alias("v"), _all(text, run, 2).alias("more"))
    digits = lambda z: F.regexp_replace(z["v"], "[ -]", "")
    kept = F.filter(both, lambda z: (z["more"] == "") & (F.length(digits(z)) >= 13) & F.call_function("luhn_check", digits(z)))
    return F.transform(kept, lambda z: z["v"])


def street(text: Column) -> Column:
    """In two steps, so that no long run of words is matched by recursion."""
    run = rf"(?=\d){EDGE}\d{{1,5}}{SPACE}++[A-Za-z0-9]++(?:{SPACE}++[A-Za-z0-9]++)*+_?"
    inner = rf"^\d{{1,5}}{SPACE}+[A-Za-z0-9][\s\S]*{SPACE}(?:{STREET_ENDS}){EDGE}"
    return F.filter(F.transform(_all(text, run), lambda r: F.regexp_extract(r, inner, 0)), lambda x: x != "")


def matches(name: str, text: Column, custom: dict[str, str] | None = None) -> Column:
    """All matches of one type in text order; null texts have none."""
    t = F.coalesce(text, F.lit(""))
    if name == "email":
        return email(t)
    if name == "credit_card":
        return credit_card(t)
    if name == "ssn":
        return _all(t, r"\d{3}-\d{2}-\d{4}")
    if name == "api_key":
        return F.array_distinct(_all(t, r'(?i)(?:api_key|api-secret|access-token)[ \t]*[:=][ \t]*(?:"[A-Za-z0-9_-]+"?|[A-Za-z0-9_-]+)'))
    if name == "aws_access_key":
        return _all(t, r"AKIA[A-Z0-9]{16}")
    if name == "jwt_token":
        return _all(t, r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
    return F.when(gate(name, t), found_in(name, t, custom)).otherwise(_none())


def slices(text: Column, window: int) -> Column:
    """Head, middle and tail of a text in windows of so many bytes, touching ones joined; characters cut at an edge are dropped. For texts over three windows."""
    n, raw = F.octet_length(text), F.encode(text, "UTF-8")
    middle = F.floor((n - window) / 2).cast("int")
    parts = F.array(F.substring(raw, 1, window), F.substring(raw, middle + 1, F.lit(window)), F.substring(raw, n - window + 1, F.lit(window)))
    joined = F.array(F.substring(raw, 1, 2 * window), F.substring(raw, n - window + 1, F.lit(window)))
    # Over three windows, the middle touches neither the head nor the tail but by a byte of rounding.
    return F.transform(F.when(middle <= window, joined).otherwise(parts), lambda p: F.regexp_replace(F.make_valid_utf8(p.cast("string")), "\\A\ufffd+|\ufffd+\\z", ""))


def found_in(name: str, text: Column, custom: dict[str, str] | None = None) -> Column:
    """All matches of a long-tail or custom type, whatever the gate says."""
    body = (custom or {}).get(name)
    if body:
        return _all(text, to_java(body))
    return street(text) if name == "street_address" else _all(text, FIRST[name] + to_java(LONG_TAIL[name]))


def sampled(name: str, text: Column, window: int, custom: dict[str, str] | None = None) -> Column:
    """Texts over three windows of bytes: head, middle and tail only, distinct values; shorter ones whole."""
    t = F.coalesce(text, F.lit(""))
    long = F.octet_length(t) > 3 * window
    parts = F.when(long, slices(t, window)).otherwise(F.array(t))
    values = let(F.flatten(F.transform(parts, lambda s: found_in(name, s, custom))), lambda v: F.when(long, F.array_distinct(v)).otherwise(v))
    return F.when(gate(name, t), values).otherwise(_none())


def selected(include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), custom: dict[str, str] | None = None) -> list[str]:
    """Types of a scan, the critical first, others by name. Unknown names and invalid patterns are left out.

    An empty list, or one with `all`, takes every type; otherwise a custom type runs only if it is listed.
    """
    own = {}
    for k, v in (custom or {}).items():
        try:
            re.compile(v)
            to_java(v)
            own[k] = v
        except (re.error, ValueError):
            continue
    known = list(dict.fromkeys([*CRITICAL, *LONG_TAIL, *own]))
    wanted = known if not include or "all" in include else [k for k in known if k in include]
    names = [k for k in wanted if k not in exclude]
    return [k for k in CRITICAL if k in names] + sorted(k for k in names if k not in CRITICAL)


def limited(values: Column, per_type: int) -> Column:
    return F.slice(values, 1, per_type) if per_type else values


def mask(value: Column) -> Column:
    """All but the last four bytes starred; four bytes or fewer give ****. What is left of a character cut at its start is dropped."""
    n = F.octet_length(value)
    tail = F.regexp_replace(F.decode(F.substring(F.encode(value, "UTF-8"), -4, 4), "ISO-8859-1"), "^[\\x80-\\xBF]+", "")
    return F.when(n <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.encode(tail, "ISO-8859-1").cast("string")))


def redact(values: Column, how: str) -> Column:
    if how == "mask":
        return F.transform(values, mask)
    return F.transform(values, lambda v: F.sha2(v, 256)) if how == "hash" else values


def sensitive(text: Column, names: list[str], per_type: int = 100, total: int = 1_000, how: str = "mask", custom: dict[str, str] | None = None, longtail: str = "full", window: int = 4_096, given: dict[str, Column] | None = None) -> Column:
    """struct<data map, counts map, truncated>: stored matches by type under both limits (0: no limit). `given` holds types already matched."""
    names = [k for k in names if k in CRITICAL or longtail != "off"]
    if not names:
        return F.lit(None).cast("struct<data:map<string,array<string>>,counts:map<string,int>,truncated:boolean>")
    given = given or {}
    each = [limited(given[k] if k in given else sampled(k, text, window, custom) if longtail == "sampled" and k not in CRITICAL else matches(k, text, custom), per_type) for k in names]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in zip(names, each, strict=True)])
    found = F.filter(pairs, lambda p: F.size(p["v"]) > 0)
    return let(found, lambda full: _stored(full, per_type, total, how))


def _stored(full: Column, per_type: int, total: int, how: str) -> Column:
    if total:  # what is left of the total limit goes down the list
        zero = F.struct(F.lit(total).alias("left"), F.array().cast("array<struct<k:string,v:array<string>>>").alias("out"))
        full = F.aggregate(
            full,
            zero,
            lambda a, p: F.struct((a["left"] - F.least(a["left"], F.size(p["v"]))).alias("left"), F.concat(a["out"], F.array(F.struct(p["k"].alias("k"), F.slice(p["v"], F.lit(1), F.least(a["left"], F.size(p["v"]))).alias("v")))).alias("out")),
        )["out"]
        full = F.filter(full, lambda p: F.size(p["v"]) > 0)
    return let(full, lambda kept: _summary(kept, per_type, total, how))


def truncated(sizes: Column, per_type: int, total: int) -> Column:
    """Whether stored counts reach a limit (0: none)."""
    over = F.lit(False)
    if per_type:
        over = over | F.exists(sizes, lambda x: x >= per_type)
    if total:
        over = over | (F.aggregate(sizes, F.lit(0), lambda a, x: a + x) >= total)
    return over


def _summary(full: Column, per_type: int, total: int, how: str) -> Column:
    data = F.map_from_entries(F.transform(full, lambda p: F.struct(p["k"], redact(p["v"], how))))
    counts = F.map_from_entries(F.transform(full, lambda p: F.struct(p["k"], F.size(p["v"]))))
    over = truncated(F.transform(full, lambda p: F.size(p["v"])), per_type, total)
    return F.when(F.size(full) > 0, F.struct(data.alias("data"), counts.alias("counts"), over.alias("truncated")))
