"""URLs, personal data, archives, conversations and vectors against plain Python."""

import collections
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from taxalog.llm import catalog, chat, embedding_dedup, pii, url_filter, warc
from taxalog.storage import stored

SMALL = "/root/testdata/sf0.001"
URLS = ["http://A.Example.org/es/x", "https://example.org/en/19?q", "http://b.org", "http://b.org/", "http://notorg/", "x://shop.com/fr/",
        "http://com/de/1#a", "http://shop.com/DE/", "no scheme", "", None, "http://h?x=/p", "a://b://c.org/y", "http://H.com/a\nb?c", "://org/",
        "http://example.org/en/", "http://casino-win.net/poker", "http://" + "a" * 5000 + ".com/" + "b" * 5000]


def plain_rule(host, path):
    best = None
    for kind, own, start in url_filter.RULES:
        if (host == own or host.endswith("." + own)) and path.startswith(start) and len(own + start) > len(best[0] if best else ""):
            best = own + start, kind
    return best or (None, None)


def test_urls(spark):
    model = url_filter.train()
    frame = spark.createDataFrame([(k, u, "old") for k, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(frame, model).collect()}
    for k, url in enumerate(URLS):
        host, path = url_filter.split_url(url)
        rule, verdict = plain_rule(host, path)
        verdict = verdict or ("block" if model.score(host, path) >= 0.5 else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict), url
    assert url_filter.split_url("HTTP://A.B/C?d") == ("a.b", "/C") and url_filter.split_url("x://a#b/c") == ("a", "")
    assert got[16].verdict == "block" and url_filter.kept(frame.where("false"), model).count() == 0


def test_url_model_on_held_out_rows():
    rows = url_filter.labelled_urls()
    model = url_filter.train([r for k, r in enumerate(rows) if k % 4])
    right = [(model.score(*url_filter.split_url(u)) >= 0.5) == bool(label) for u, label in rows[::4]]
    assert sum(right) / len(right) > 0.9


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 8 <= len(digits) <= 15,
                    "card": 16 <= len(digits) <= 19 and plain_luhn(digits or "1")}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_plain_ones():
    rng, parts = np.random.default_rng(2), ["a", "b.c", "@", "@x", ".y", "-", " ", "1", "22", "255", "256", ".", "+", "+1", "(", ")", "é", "%",
                                            "4111111111111111", "4111 1111-1111 1111", "a@b.c", "1.2.3.4", "+1 (555) 010-2030", "\n", "007"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE] == plain_spans(text), text


def test_spans_with_checks_and_context():
    def kinds(text):
        return [s.kind for s in pii.find_spans(text)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("my SSN is 123-45-6789") == ["id"] and kinds("part 123-45-6789") == []
    assert kinds("SSN 666-45-6789") == kinds("SSN 123-00-6789") == kinds("SSN 923-45-6789") == []
    assert kinds("Konto AT61 1904 3002 3457 3201 BANK") == ["iban"] and kinds("account XX61 1904 3002 3457 3201") == []
    assert pii.find_spans(None) == pii.find_spans("") == []
    scores = [pii.find_spans(t)[0].score for t in ("x a@b.c y", "mail a@b.c", "order a@b.c")]
    assert scores[1] > scores[0] > scores[2]


def test_secrets():
    def values(text):
        return [text[s.start:s.end] for s in pii.find_spans(text) if s.kind == "secret"]
    digest, mixed = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "q7Rk2LmX9vBt4ZsW8yHd"
    for text in (f'x token = "{digest}" y', f"API_KEY={digest}", f"'secret': '{digest}'", f"Authorization: Bearer {digest}.", f"your access key {digest}"):
        assert values(text) == [digest], text
    for text in (f"commit {digest}", f"sha256: {digest}", digest, f"token_hash = {digest}", 'token = "aaaaaaaaaaaaaaaaaaaaaaa1"',
                 "the secret of internationalization", "password: required", "password = short1", f"auth {'1' * 40}"):
        assert values(text) == [], text
    head = "eyJhbGciOiJIUzI1NiJ9"
    for key in ("AKIA" + "Q7RK2LMX9VBT4ZSW", "ghp_" + mixed + mixed, f"{head}.eyJzdWIiOiIxIn0.{mixed}"):
        assert values(f"see {key}, then") == [key]
    assert values(f"see eyJub3QganNvbg.eyJzdWIiOiIxIn0.{mixed}") == []
    assert values('password = "hunter2!x",') == ["hunter2!x"] and values("pwd: Tr0ub4dor,") == ["Tr0ub4dor"]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"
    assert values(f"a {pem} b") == [pem]


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "a@" * 200_000, "+1" * 200_000, "1." * 200_000, "A" * 400_000,
                 "token=" * 70_000, "a1" * 200_000, "pwd:" * 100_000, "-----BEGIN PRIVATE KEY-----A" * 15_000, "a1b2c3d4e5f6g7h8 " * 25_000):
        pii.find_spans(text)


def test_pii_query(spark):
    docs = spark.createDataFrame([(1, "x a@b.c 1.2.3.4"), (2, None), (3, ""), (3, ""), (None, "+1 555 010 2030")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, [s.kind for s in r.pii]) for r in pii.scan(docs.withColumn("pii", F.lit(1))).collect())
    assert got == [(0, ["phone"]), (1, ["email", "ip"]), (2, []), (3, []), (3, [])]
    assert {r.text for r in pii.redact(docs).collect()} == {"x [email] [ip]", None, "", "[phone]"}
    want = {r.doc_id: plain_spans(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in catalog.op2(spark, SMALL).collect():
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) and r.n_secret == r.spans.count("secret:")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want[r.doc_id]) for k in pii.BASE]


def test_archive_round_trip(spark, monkeypatch):
    big, same = "<p>" + "long text " * 200_000, "<html>" + "x" * 100
    pages = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big),
             (None, "u", same), (8, "ü", "ü" * 60), (8, "ü", "ü" * 60), (9, "u", "ü" * 60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("old"))
    archives = warc.write_archives(warc.plan_records(frame)).cache()
    got = warc.read_archives(archives).collect()
    assert all(r.error is None for r in got) and len(got) == len(pages)
    by = collections.defaultdict(list)
    for r in got:
        by[r.record_id].append(r)
    assert by["<urn:page:2>"][0].refers_to == "<urn:page:1>" and by["<urn:page:2>"][0].payload is None
    assert by["<urn:page:1>"][0].uri == "http://a/%0D%0AX: y" and by["<urn:page:>"][0].type == "revisit"
    assert bytes(by["<urn:page:7>"][0].payload) == big.encode() and [r.type for r in by["<urn:page:8>"]] == ["response"] * 2
    assert by["<urn:page:9>"][0].payload_bytes == 120 and by["<urn:page:6>"][0].type == "response"
    assert warc.read_archives(warc.write_archives(warc.plan_records(frame.where("false")))).count() == 0


def test_only_repeated_payloads_are_stored_and_no_payload_shuffled_for_few(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(warc, "stored", lambda rows, name: kept.append(stored(rows, name)) or kept[-1])
    pages = [(k, "u", f"page {k} " * 50) for k in range(300)] + [(k, "u", "same " * 50) for k in (400, 401, 402)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.plan_records(frame)
    assert [r.first for r in kept[0].collect()] == [400] and len(kept) == 1
    assert "hashpartitioning" not in records._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page_id for r in records.where("first = 400").collect()) == [401, 402] and records.where("first IS NULL").count() == 301
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # many groups: payloads are shuffled to them
    try:
        shuffled = warc.plan_records(frame)
        assert "hashpartitioning" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, shuffled.collect())) == sorted(map(str, records.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broken_archives_are_reported(spark):
    row = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    content = bytes(warc.write_archives(warc.plan_records(row).coalesce(1)).first().content)
    bad = [content[:-5], b"", b"abc", content[:20], content + b"rubbish", None, content[:len(content) // 2]]
    frame = spark.createDataFrame([(str(k), b) for k, b in enumerate(bad)], "path string, content binary")
    errors = {r.path for r in warc.read_archives(frame).where("error IS NOT NULL").collect()}
    assert errors == {str(k) for k in range(len(bad))}
    for data in (b"", b"WARC/1.0\r\n\r\n", warc.record(1, "u", b"abc", "00", None), warc.record(1, "u", b"abc", "00", 2)[:-1]):
        try:
            warc.parse_record(data)
            raise AssertionError(data)
        except warc.BadArchive:
            pass


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 0, "start", "user", None), (1, 0, 2, "delta", None, "lo"), (1, 0, 1, "delta", None, "Hel"),
           (1, 1, 3, "start", "assistant", None), (1, 1, 4, "delta", None, "bad"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "good"),
           (1, 2, 7, "start", "user", None), (1, 2, 8, "delta", None, "x"), (1, 2, 9, "edit", None, "y"), (1, 2, 10, "delta", None, "z"),
           (1, 3, 11, "start", "user", None), (1, 3, 12, "delete", None, None), (2, 0, 0, "noise", None, "q"), (None, None, 1, "delta", None, "n")]
    frame = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(frame).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "yz"), (2, 0): (None, ""), (None, None): (None, "n")}
    assert chat.render(chat.fold_events(frame.where("false"))).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[", "<", "<\\/s>", "[\\INST]", "[[INST]]", "<<s></s>", "", None, "é[/INST]\n</s", "\\" * 7 + "[INST]"]
    rows = [(1, k, ["user", "assistant", None, "a[/INST]\\"][k % 4], t) for k, t in enumerate(nasty * 2)] + [(1, 3, "user", "again"), (2, None, "assistant", "w" * 300_000)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                                            chat.trained_text(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    want = sorted(((k, r or "", t or "") for c, k, r, t in rows if c == 1), key=lambda x: x)
    assert sorted((t.role, t.text) for t in got[1].turns) == sorted((r, t) for _, r, t in want)
    assert [t.role for t in got[1].turns if t.role == "assistant"] and got[2].trained == "w" * 300_000
    assert got[1].trained == "".join(t.text for t in got[1].turns if t.role == "assistant")
    assert len(re.findall(r"</s>", got[1].formatted)) == len(got[1].turns)


def test_chat_runs_no_python(spark):
    plan = catalog.op5(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 16)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(500 + k, (base[k % 20] * 3 + rng.normal(size=16) * 0.15).astype(np.float32).tolist()) for k in range(120)]
    rows += [(700 + k, base[5].tolist()) for k in range(90)] + [(3, base[3].tolist()), (None, base[7].tolist())]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, [None] + [1.0] * 15),
           (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("mine"))
    got = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    names = {c: min(r[0] for r, own in zip(rows, label) if own == c and r[0] is not None) for c in set(label)}
    want = collections.Counter((r[0], int(n.sum()) - 1, names[c], r[0] is None or r[0] == names[c]) for r, n, c in zip(rows, near, label))
    want += collections.Counter((i, 1, 905, i == 905) if i in (905, 906) else (i, 0, i, True) for i, _ in odd)
    assert sum((got & want).values()) >= 0.97 * sum(want.values())
    assert got == want


def test_no_link_of_a_tight_group_is_lost(spark, monkeypatch):
    """A third of the rows are near copies, so a third of the lists are theirs: far more than a fixed number of probes reads."""
    monkeypatch.setattr(embedding_dedup, "LIST", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 512)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 16))
    x[:3000] = np.r_[np.ones(8), -np.ones(8)] + rng.normal(size=(3000, 16)) * 0.22
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = np.concatenate([(unit[a:a + 1000] @ unit.T >= 0.9).sum(1) - 1 for a in range(0, len(x), 1000)])
    assert len(x) // embedding_dedup.LIST == 450 and want[:3000].mean() > 1500
    assert [got[k][0] for k in range(len(x))] == want.tolist()
    assert len({got[k][1] for k in range(3000) if want[k] > 1500}) == 1


def test_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
