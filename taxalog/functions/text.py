"""Text functions as column expressions. All of them stay in the JVM.

Java's ``.`` and ``$`` treat more characters as line ends than a plain newline,
and ``\\s`` has no Unicode meaning by default, so the patterns below spell out
``[^\\n]``, ``\\z`` and ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_LENGTH = 120
TOKENS_PER_WORD = 1.3
TAIL_FRAMES = 2


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(raw) -> Column:
    return F.col(raw).rlike(r"(?U)^\s*\z") if isinstance(raw, str) else raw.rlike(r"(?U)^\s*\z")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("...")))


def summarize(raw: Column) -> Column:
    """First line, cut at the last space within 120 code points."""
    def cut(line):
        head = F.substring(line, 1, SUMMARY_LENGTH)
        return F.when(F.length(line) <= SUMMARY_LENGTH, line).otherwise(
            F.concat(F.regexp_replace(head, r"(?s) [^ ]*\z", ""), F.lit("...")))
    return let(trim_space(F.substring_index(raw, "\n", 1)), cut)


def estimate_tokens(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.ceil(words * F.lit(TOKENS_PER_WORD)).cast("long")


# --- stack traces -----------------------------------------------------------

_FRAME = r"^[\t\n\f\r ]+at |^[\t\n\f\r ]+[^\n]+\.go:[0-9]|^goroutine [0-9]"


def is_frame(line: Column) -> Column:
    return line.rlike(_FRAME)


def shorten_trace(raw: Column, keep: int) -> Column:
    """Keep the first ``keep`` and the last two frames; cut all lines between."""
    def cut(parts):
        lines, frames = parts["lines"], parts["frames"]
        n = F.size(frames)
        last_of_head = F.element_at(frames, keep)
        first_of_tail = F.element_at(frames, -TAIL_FRAMES)
        note = F.concat(F.lit("\t... ("), (n - (keep + TAIL_FRAMES)).cast("string"), F.lit(" frames omitted) ..."))
        return F.when(n <= keep + TAIL_FRAMES, raw).otherwise(F.concat_ws(
            "\n",
            F.array_join(F.slice(lines, 1, last_of_head), "\n"),
            note,
            F.array_join(F.slice(lines, first_of_tail, F.size(lines) - first_of_tail + 1), "\n")))

    def with_frames(lines):
        numbered = F.transform(lines, lambda line, i: F.when(is_frame(line), i + 1))
        return F.struct(lines.alias("lines"), F.filter(numbered, lambda i: i.isNotNull()).alias("frames"))

    trace = let(let(F.split(raw, "\n", -1), with_frames), cut)
    # Most rows hold no frame at all; do not split those.
    return F.when(raw.rlike(r"(?m)" + _FRAME), trace).otherwise(raw)


# --- tokens -----------------------------------------------------------------

# The ideograph ranges that become tokens of their own.
IDEOGRAPHS = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
# Unicode punctuation plus the ASCII symbols that count as punctuation.
PUNCTUATION = r"\p{P}$+<=>^`|~"
SEPARATORS = r" \x{2028}\x{2029}"


# Any character that needs more than a one-to-one mapping lies in here; two plain
# ranges, because wider classes make the regex engine many times slower.
_SPECIAL = r"[\x{9CB}-\x{1BFF}\x{2E80}-\x{10FFFF}]"


@lru_cache(maxsize=1)
def _character_maps():
    """One-to-one rules from the Unicode tables, as dictionaries.

    ``clean``: control characters vanish, white space becomes a space.
    ``accents``: canonical decomposition without the non-spacing marks, where at
    most one character is left. ``several``: where more are left, without the
    Hangul syllables, which follow a formula.
    """
    clean = {"\ufffd": "", "\t": " ", "\n": " ", "\r": " "}
    accents, several = {}, {}
    # Ideographs of the main block, Hangul, surrogates and the empty planes have no rule.
    for code in chain(range(0x4E00), range(0xA000, 0xAC00), range(0xE000, 0x20000),
                      range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs":
            clean[char] = " "
        elif kind == "Cc":
            clean.setdefault(char, "")
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if bare != char:
            (accents if len(bare) < 2 else several)[char] = bare
    return clean, accents, several


def _map_characters(text: Column, rules: dict[str, str]) -> Column:
    # translate() drops the characters beyond the end of its second list
    ordered = sorted(rules, key=lambda c: rules[c] == "")
    return F.translate(text, "".join(ordered), "".join(rules[c] for c in ordered))


def clean_text(text: Column) -> Column:
    return _map_characters(text, _character_maps()[0])


def pad_ideographs(text: Column) -> Column:
    return F.when(text.rlike(_SPECIAL), F.regexp_replace(text, f"([{IDEOGRAPHS}])", " $1 ")).otherwise(text)


def _code_unit(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _split_hangul(text: Column) -> Column:
    def jamo(char):
        code = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
        tail = code % 28
        letters = F.concat(
            _code_unit(F.floor(code / 588) + 0x1100),
            _code_unit(F.floor(code % 588 / 28) + 0x1161),
            F.when(tail > 0, _code_unit(tail.cast("long") + 0x11A7)).otherwise(F.lit("")))
        return F.when(char.rlike(r"[\x{AC00}-\x{D7A3}]"), letters).otherwise(char)
    return F.array_join(F.transform(F.split(text, ""), jamo), "")


def _expand(text: Column) -> Column:
    """Decompositions that leave more than one character."""
    expanded = text
    for char, parts in _character_maps()[2].items():
        expanded = F.replace(expanded, F.lit(char), F.lit(parts))
    return let(expanded, lambda t: F.when(t.rlike(r"[\x{AC00}-\x{D7A3}]"), _split_hangul(t)).otherwise(t))


def strip_accents(text: Column) -> Column:
    accents = _character_maps()[1]
    return F.when(text.rlike(_SPECIAL), _map_characters(_expand(text), accents)).otherwise(
        _map_characters(text, accents))


def fold_text(text: Column) -> Column:
    """Cleaned, ideographs padded, lower case, no accents.

    Dropping the accents first lets one character map do the cleaning as well.
    A final sigma is mapped here because Java lower-cases it by context.
    """
    clean, accents, _ = _character_maps()
    rules = {**accents, **clean, "Σ": "σ"}
    special = _map_characters(_expand(pad_ideographs(text)), rules)
    return F.lower(F.when(text.rlike(_SPECIAL), special).otherwise(_map_characters(text, rules)))


def split_on_punctuation(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{PUNCTUATION}]|[^{SEPARATORS}{PUNCTUATION}]+"), 0)


def basic_tokens(text: Column) -> Column:
    return split_on_punctuation(fold_text(text))


def words(text: Column) -> Column:
    """The basic tokens without the punctuation."""
    return F.array_remove(F.split(fold_text(text), f"[{SEPARATORS}{PUNCTUATION}]+"), "")


# --- durations, times, names ------------------------------------------------

def format_duration(micros: Column) -> Column:
    seconds = F.floor(micros / F.lit(1_000_000))
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return (F.when(micros < 1_000_000, F.concat(F.floor(micros / 1000).cast("string"), F.lit("ms")))
            .when(micros < 60_000_000,
                  F.concat(F.bround(micros / F.lit(1e6), 0).cast("long").cast("string"), F.lit("s")))
            .when(rest == 0, F.concat(minutes.cast("string"), F.lit("m")))
            .otherwise(F.concat(minutes.cast("string"), F.lit("m"), rest.cast("string"), F.lit("s"))))


# Date, time, optional fraction (any number of digits), offset or Z.
_RFC3339 = (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})"
            r"(?:[.,]([0-9]{1,6})[0-9]*)?(Z|[+-][0-9]{2}:[0-9]{2})\z")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL when it is not one."""
    def part(i):
        return F.regexp_extract(text, _RFC3339, i)
    stamp = F.concat(part(1), F.lit(" "), part(2), F.lit("."), F.rpad(part(3), 6, "0"),
                     F.when(part(4) == "Z", F.lit("+00:00")).otherwise(part(4)))
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# --- URLs -------------------------------------------------------------------

INVALID_URL = "(invalid URL)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_PATH_UNSAFE = r"[^A-Za-z0-9\-_.~$&+,/:;=@%!'()*\[\]]"


def _escape_path(path: Column) -> Column:
    def one(char):
        return F.when(char.rlike(_PATH_UNSAFE), F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))).otherwise(char)
    return F.when(path.rlike(_PATH_UNSAFE), F.array_join(F.transform(F.split(path, ""), one), "")).otherwise(path)


def redact_url(url: Column) -> Column:
    """Hide user info and query; a text that is no URL gives a placeholder."""
    def parts(u):
        body = F.substring_index(u, "#", 1)
        target = F.substring_index(body, "?", 1)
        scheme = F.lower(F.regexp_extract(target, _SCHEME, 0))
        rest = F.substring(target, F.length(scheme) + 1, 2_000_000_000)
        return F.struct(
            scheme.alias("scheme"), rest.alias("rest"),
            F.regexp_extract(rest, r"^//([^/]*)", 1).alias("authority"),
            F.substring(body, F.length(target) + 1, 2_000_000_000).alias("query"),
            F.substring(u, F.length(body) + 1, 2_000_000_000).alias("fragment"))

    def build(p):
        has_authority = p["rest"].startswith("//")
        host = F.regexp_replace(p["authority"], r"^.*@", "")
        path = F.when(has_authority, F.regexp_replace(p["rest"], r"^//[^/]*", "")).otherwise(p["rest"])
        opaque = (p["scheme"] != "") & ~p["rest"].startswith("/")
        invalid = (
            F.concat(p["scheme"], p["rest"], p["query"], p["fragment"]).rlike(r"[\x00-\x1f\x7f]")
            | p["rest"].startswith(":") & (p["scheme"] == "")
            | (p["scheme"] == "") & p["rest"].rlike(r"^[^/]*:")
            | ~opaque & (path.rlike(_BAD_ESCAPE) | p["authority"].rlike(_BAD_ESCAPE))
            | p["fragment"].rlike(_BAD_ESCAPE)
            | host.rlike(r"[ <>\"\\^`{|}]")
            | host.rlike(r"^[^\[\]]*:[^:]*[^0-9:][^:]*\z")
            | ~host.startswith("[") & host.rlike(r":.*:"))
        shown = F.concat(
            p["scheme"],
            F.when(has_authority, F.concat(
                F.lit("//"), F.when(p["authority"].contains("@"), F.lit("REDACTED@")).otherwise(F.lit("")), host,
            )).otherwise(F.lit("")),
            F.when(opaque, path).otherwise(_escape_path(path)),
            F.when(F.length(p["query"]) > 1, F.lit("?REDACTED")).otherwise(p["query"]),
            F.when(F.length(p["fragment"]) > 1, p["fragment"]).otherwise(F.lit("")))
        return F.when(invalid, F.lit(INVALID_URL)).otherwise(shown)

    return let(let(url, parts), build)
