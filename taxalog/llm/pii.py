"""Personal data in texts (operator 2).

Patterns propose spans, checks (Luhn, modulo 97, country lengths, ranges, entropy)
confirm them, and words close by raise or lower their score. The kinds email, ip,
card and phone are found by pattern and check alone, their score only tells; the
others need it.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "id", "secret")
BASE = KINDS[:4]
LEAST_SCORE = 0.7
NEAR = 40

# Each run of digits or letters is tried from its start only: a later start in the
# same run cannot match what the first did not. Possessive runs never backtrack, so
# the time is linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_HELPS = {"email": re.compile(r"mail|contact|kontakt|write to", re.I), "ip": re.compile(r"\bip\b|host|server|addr|client", re.I),
          "card": re.compile(r"card|visa|amex|karte|carte|tarjeta", re.I), "phone": re.compile(r"phone|\btel|call|mobile|fax|handy", re.I),
          "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
          "id": re.compile(r"\bssn\b|social security|tax id|national id", re.I)}
_HINDERS = re.compile(r"order|invoice|part|serial|isbn|version|bestell|commande|pedido", re.I)
_SCORES = {"email": 0.8, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.8, "id": 0.4}

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20, "YE": 30}

# Beginnings that providers give their keys, and the least length of what follows.
KEY_PREFIXES = {"AKIA": 16, "ASIA": 16, "AIza": 35, "ghp_": 36, "gho_": 36, "ghu_": 36, "ghs_": 36, "ghr_": 36,
                "github_pat_": 40, "glpat-": 20, "xoxb-": 20, "xoxp-": 20, "sk_live_": 20, "rk_live_": 20, "npm_": 36, "hf_": 30}
_KEY_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+=*+")
_PASSWORD = re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|passwort|pwd)[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?([^\s\"'<>]{8,64})(?![^\s\"'<>])", re.I)
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END \1PRIVATE KEY-----)?")
_ASSIGNED = re.compile(r"([A-Za-z0-9_.-]{1,40})[\"'`]?[ \t]*(?:[:=]|=>|:=)[ \t]*[\"'`]?$")
_BEARER = re.compile(r"\b(?:bearer|basic)[ \t]+$", re.I)
_SECRET_NAME = re.compile(r"token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|auth|credential|private[ _-]?key|bearer", re.I)
_PLAIN_NAME = re.compile(r"public|sha|checksum|commit|hash|digest|etag|uuid|revision", re.I)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = (ord(d) - 48) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where an IBAN that begins at ``start`` ends by its country's length, if that is inside a word's end and the check holds."""
    length, seen = IBAN_LENGTHS.get(text[start:start + 2]), 0
    for at in range(start, end):
        seen += text[at] != " "
        if seen == length:
            whole = not text[at + 1:at + 2].isalnum()
            return at + 1 if whole and mod97(text[start:at + 1].replace(" ", "")) else None
    return None


def id_ranges(number: str) -> bool:
    """Area, group and serial that are given out at all."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def entropy(value: str) -> float:
    """Bits per character."""
    return sum(n / len(value) * math.log2(len(value) / n) for n in Counter(value).values())


def is_signed_token(value: str) -> bool:
    """Three parts, the first one a JSON object that names an algorithm."""
    head, *rest = value.split(".")
    if len(rest) != 2 or not head.startswith("eyJ"):
        return False
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False


def looks_random(value: str) -> bool:
    """Letters and digits mixed, spread as in random text: 3 bits a character in hexadecimal, else 3.5."""
    digits = sum(c.isdigit() for c in value)
    if not 0 < digits < len(value):
        return False
    return entropy(value[:512]) >= (3.0 if re.fullmatch("[0-9a-fA-F-]+", value) else 3.5)


def secrets(text: str):
    """(start, end, score) of keys, tokens, passwords and private keys; may overlap.

    A known beginning or a signed token is enough. Another random-looking run needs
    the name it is assigned to, or a word close before it; a name like ``commit`` or
    ``checksum`` speaks against it.
    """
    for m in _PEM.finditer(text):
        yield m.start(), m.end(), 1.0
    for m in _PASSWORD.finditer(text):
        value = m[1].rstrip(",;.)")
        classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        if len(value) >= 8 and classes > 1 and entropy(value) >= 2.5:
            yield m.start(1), m.start(1) + len(value), 0.8
    for m in _KEY_RUN.finditer(text):
        value, end = m[0].rstrip("."), m.start() + len(m[0].rstrip("."))
        if any(value.startswith(p) and len(value) >= len(p) + n for p, n in KEY_PREFIXES.items()) or is_signed_token(value):
            yield m.start(), end, 1.0
            continue
        before = text[max(0, m.start() - NEAR):m.start()]
        named = _ASSIGNED.search(before)
        score = 0.4
        if named and _PLAIN_NAME.search(named[1]):
            score -= 0.3
        elif named and _SECRET_NAME.search(named[1]) or _BEARER.search(before):
            score += 0.5
        elif _SECRET_NAME.search(before) and not _PLAIN_NAME.search(before):
            score += 0.3
        if score >= LEAST_SCORE and looks_random(value):
            yield m.start(), end, score


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Spans of local part, @ and domain, leftmost and without overlap.

    The local part is the run of allowed characters before an @, cut off at the
    end of the last match; no start further right is tried where a run matches.
    """
    last, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        floor = max(last, text.rfind("@", last, at) + 1)
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        if found and start < at:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def ip_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def near_words(text: str, start: int, end: int) -> str:
    return f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}"


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind as in ``KINDS``, then start; code points, end exclusive. Null: none."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(ip_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    found += [("iban", m.start(), end) for m in _IBAN.finditer(text) if (end := iban_end(text, *m.span()))]
    found += [("id", m.start(), m.end()) for m in _ID.finditer(text) if id_ranges(m[0])]
    out = []
    for kind, start, end in found:
        near = near_words(text, start, end)
        score = _SCORES[kind] + 0.4 * bool(_HELPS[kind].search(near)) - 0.3 * bool(_HINDERS.search(near))
        if kind in BASE or score >= LEAST_SCORE:
            out.append(Span(kind, start, end, min(1.0, score)))
    last = 0
    for start, end, score in sorted(secrets(text), key=lambda s: (s[0], -s[1])):
        if start >= last:
            out.append(Span("secret", start, end, score))
            last = end
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score), by kind as in ``KINDS``, then start.

    Whole texts are read, in one narrow stage. A null or empty text has no span;
    repeated rows get the same spans; an existing column ``pii`` is replaced.
    """
    @F.arrow_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        return pa.array([[vars(s) for s in find_spans(t.as_py())] for t in texts], pa.list_(kind))

    return docs.select(*[c for c in docs.columns if c != "pii"], spans("text").alias("pii"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text, parts, last = t.as_py(), [], 0
            for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
                if s.start >= last:
                    parts += [text[last:s.start], f"[{s.kind}]"]
                last = max(last, s.end)
            out.append(text if text is None else "".join(parts) + text[last:])
        return pa.array(out, pa.string())

    return docs.withColumn("text", masked("text"))
