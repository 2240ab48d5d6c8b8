import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from taxalog.functions import text as X
from taxalog.functions.jsonfields import DEFAULT_STRIP_FIELDS, strip_fields
from taxalog.operators.compact import compact, compaction_report


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


JAVA = "java.lang.NullPointerException: oops\n" + "\n".join(f"\tat com.example.Service.method{i}(Service.java:{i})" for i in range(30))
GO = "goroutine 1 [running]:\n" + "\n".join(f"main.f{i}()\n\t/app/main.go:{i} +0x1d" for i in range(20))


def trace_model(raw, keep):
    import re
    lines = raw.split("\n")
    frames = [i for i, l in enumerate(lines) if re.match(r"[\t\n\f\r ]+at |[\t\n\f\r ]+[^\n]+\.go:[0-9]|goroutine [0-9]", l)]
    if len(frames) <= keep + 2:
        return raw
    note = f"\t... ({len(frames) - keep - 2} frames omitted) ..."
    return "\n".join(lines[:frames[keep - 1] + 1] + [note] + lines[frames[-2]:])


@pytest.mark.parametrize("text, n, want", [
    ("日本語" * 100, 10, ("日本語" * 4)[:10] + "..."), ("🔥" * 50, 5, "🔥" * 5 + "..."),
    ("hello world this is a test", 11, "hello world..."), ("short", 100, "short"), ("exact", 5, "exact"), ("", 3, ""),
])
def test_truncate(spark, text, n, want):
    assert apply(spark, [text], lambda c: X.truncate(c, n)) == [want]


def test_summarize(spark):
    def model(raw):
        line = raw.split("\n")[0].strip("\t\n\v\f\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200b))))
        if len(line) <= 120:
            return line
        cut = line[:120].rfind(" ")
        return line[:cut if cut > 0 else 120] + "..."
    cases = ["ERROR: connection refused\n\tat a\n\tat b", " ".join(["word"] * 30), "x" * 200, "y" * 120, "", "\nsecond", "  padded\xa0 ",
             "é" * 119 + " tail", "a " + "b" * 130, "tab\tonly " + "c" * 130, "one\r\ntwo"]
    assert apply(spark, cases, X.summarize) == [model(c) for c in cases]


def test_traces(spark):
    cases = [JAVA, GO, "x\n\tat a\n\tat b\n\tat c", "plain", "", "a\n" + GO + "\n" + JAVA + "\ntail\n", "goroutine x", JAVA.replace("\t", " ")]
    for keep in (5, 10):
        assert apply(spark, cases, lambda c: X.shorten_trace(c, keep)) == [trace_model(c, keep) for c in cases]
    short = apply(spark, [JAVA], lambda c: X.shorten_trace(c, 5))[0]
    assert len(short.split("\n")) == 9 and "(23 frames omitted)" in short


@pytest.mark.parametrize("raw, want", [
    ('{"level":"error","msg":"timeout","trace_id":"abc123","request_id":"req456","service":"api"}',
     '{"level":"error","msg":"timeout","service":"api"}'),
    ("ERROR connection refused trace_id=abc123", None), ('{"level":"info","msg":"ok"}', None),
    ('{"trace_id": "x"} trailing', None), ('["trace_id"]', None), ('{"a": {"trace_id": 1}}', None),
    ('  {"b":1, "a":[1,2.50,null,true], "trace_id":0}\n', '{"a":[1,2.5,null,true],"b":1}'),
    ('{"trace\\u005fid":1,"n":12345678901234567890,"e":1e3}', '{"e":1000,"n":12345678901234567000}'),
    ('{"span_id":1,"a":"<b>&","u":"é\\u2028"}', '{"a":"\\u003cb\\u003e\\u0026","u":"é\\u2028"}'),
    ('{"span_id":1,"a":1,"a":2}', '{"a":2}'), ('{"span_id":1,"a":NaN}', None), ('{"span_id":1', None), ("", None), (None, None),
    ('{"span_id":1}', "{}"), ('{"span_id":1,"t":"a\tb"}', None), ('{"span_id":1,"x":1e400}', None),
])
def test_strip_fields(spark, raw, want):
    assert apply(spark, [raw], strip_fields) == [raw if want is None else want]


def test_strip_field_choice(spark):
    raw = '{"custom_field":"val","msg":"test","trace_id":"abc"}'
    assert apply(spark, [raw], lambda c: strip_fields(c, ["custom_field"])) == ['{"msg":"test","trace_id":"abc"}']
    assert apply(spark, [raw], lambda c: strip_fields(c, [])) == [raw]


def test_compact(spark):
    long_json = '{"level":"error","msg":"' + "x" * 3000 + '"}'
    structured = json.dumps({"level": "error", "msg": "db", "status_code": 500, **{k: "v" for k in DEFAULT_STRIP_FIELDS}})
    cases = [JAVA, GO, long_json, structured, "e" * 500, "short"]

    def run(kind, verbosity):
        return apply(spark, cases, lambda c: compact(c, F.lit(kind), verbosity))
    minimal, standard = run("ERROR", "minimal"), run("ERROR", "standard")
    assert minimal[0] == trace_model(JAVA, 5) and standard[1] == trace_model(GO, 10)
    assert len(minimal[0]) > 203
    assert standard[2] == long_json[:2000] + "..."
    assert set(json.loads(standard[3])) == {"level", "msg", "status_code"}
    assert minimal[4] == "e" * 200 + "..." and minimal[5] == "short"
    assert run("REQUEST", "minimal")[0] == JAVA[:200] + "..."
    assert run("ERROR", "full") == cases
    rows = spark.createDataFrame([(JAVA, minimal[0])], "raw string, compacted string").withColumn("k", F.lit(1))
    assert compaction_report(rows, ["k"]).first()["saved_pct"] > 60


def test_token_estimate(spark):
    assert apply(spark, ["", "hello world", "hello", " ".join(["word"] * 500), "   \t\n  ", "a\xa0b c"], X.estimate_tokens) == [0, 3, 2, 650, 0, 4]


def token_model(text):
    ideographs = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
                  (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
    out = ""
    for c in text:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            out += " "
        elif kind != "Cc" and c != "�":
            out += f" {c} " if any(a <= ord(c) <= b for a, b in ideographs) else c
    out = "".join(c.lower() for c in out)
    out = "".join(c for c in unicodedata.normalize("NFD", out) if unicodedata.category(c) != "Mn")
    tokens = []
    for word in out.split():
        current = ""
        for c in word:
            if 33 <= ord(c) < 127 and not c.isalnum() or unicodedata.category(c)[0] == "P":
                tokens += [current, c] if current else [c]
                current = ""
            else:
                current += c
        tokens += [current] if current else []
    return tokens


def test_tokens(spark):
    texts = ["Hello, World! a]b[c", "Été À LA ÇA", "日本語text中", "한국어 각", "ΟΔΟΣ Σ", "a\x00b\x07c�", "x y z　w", "ﬁ İstanbul",
             "क़ো", "é", "$5+3=8 <tag> `q` ~ ^ |", "", "  ", "🔥fire🔥", "«quoted» ¿qué?", "K Å Ω"]
    assert apply(spark, texts, X.basic_tokens) == [token_model(t) for t in texts]
    marks = {c for t in texts for c in t if unicodedata.category(c)[0] == "P"} | set("$+<=>^`|~")
    assert apply(spark, texts, X.words) == [[w for w in token_model(t) if w not in marks] for t in texts]


def test_every_letter_of_the_basic_plane(spark):
    chars = [chr(c) for c in (*range(1, 0x4E00, 1), *range(0xAC00, 0xD7A4, 97), *range(0xF900, 0xFFFE)) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["a" + "b".join(chars[i:i + 50]) + "z" for i in range(0, len(chars), 50)]
    got = apply(spark, texts, X.basic_tokens)
    # Java knows an older Unicode version: allow the few newer punctuation marks and letters.
    wrong = [i for i, t in enumerate(texts) if got[i] != token_model(t)]
    assert len(wrong) <= 8, [hex(ord(texts[i][1])) for i in wrong]


@pytest.mark.parametrize("url, want", [
    ("https://user:pw@host.com/a?token=1#f", "https://REDACTED@host.com/a?REDACTED#f"),
    ("http://h.com/a", "http://h.com/a"), ("http://h.com/?", "http://h.com/?"), ("/path?q=1", "/path?REDACTED"),
    ("HTTP://h.com:80/x", "http://h.com:80/x"), ("http://h.com:8a/x", "(invalid URL)"), ("://x", "(invalid URL)"),
    ("http://h.com/%zz", "(invalid URL)"), ("http://h.com/\x01", "(invalid URL)"), ("1http://x", "(invalid URL)"),
    ("http://h.com/a b", "http://h.com/a%20b"), ("http://h.com/é", "http://h.com/%C3%A9"), ("mailto:a@b?x=1", "mailto:a@b?REDACTED"),
    ("http://[::1]:80/?a#", "http://[::1]:80/?REDACTED"), ("", ""), ("http://a b/", "(invalid URL)"), ("http://u@v@h/", "http://REDACTED@h/"),
])
def test_redact_url(spark, url, want):
    assert apply(spark, [url], X.redact_url) == [want]


def test_rfc3339(spark):
    good = ["2026-02-23T10:30:00.123Z", "2026-02-23T10:30:00.123456789+02:00", "2026-02-23T10:30:00Z"]
    bad = ["2026-02-23 10:30:00Z", "yesterday", "", "2026-13-01T00:00:00Z", "2026-02-23T10:30:00"]
    got = apply(spark, good + bad, lambda c: F.unix_micros(X.parse_rfc3339(c)))
    noon = 1771842600000000
    assert got == [noon + 123000, noon + 123456 - 7_200_000_000, noon] + [None] * 5


def test_blank(spark):
    assert apply(spark, ["", "  \n\t ", "\xa0　", "a", "\x00", "​"], X.is_blank) == [True, True, True, False, False, False]
