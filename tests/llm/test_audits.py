"""Operators 11 to 13 against brute force over small tables with odd rows, and through their queries."""

import collections
import gc
import hashlib
import itertools
import re

import numpy as np
import pytest

import __spark_entry__ as entry_points
from compare import database, rows_of, sql_rows
from taxalog.llm import divergence, filter_audit, repeats

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n, pool=10**6):
    return " ".join(f"w{k}" for k in rng.integers(0, pool, n))


def odd_rows():
    rng = np.random.default_rng(5)
    passage, base = words(rng, 90), words(rng, 300)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", None, "a"), (4, None, "en", None), (5, "", "de", "b"),
            (6, " \t\n", None, "b"), (7, "x", "fr", "c"), (7, "x", "fr", "c"), (8, passage, "en", "c"), (8, passage, "en", "c"),
            (None, base, "en", "a"), (None, None, None, None), (None, passage + " own", "en", "a"), (9, "word " * 30_000, "en", "c"),
            (10, "ÀÉ Straße " * 30, "de", "b"), (11, "A$ B C " * 40, "de", "b"), (12, "a" * 900 + " b", "en", "")]
    for k in range(40):  # a passage in different surroundings, and copies with one other word
        own = base.split()
        own[int(rng.integers(300))] = f"z{k % 7}"
        rows.append((100 + k, " ".join(own), "en", "hot"))
        rows.append((200 + k, words(rng, int(rng.integers(1, 60))) + " " + passage + " " + words(rng, 5), "fr", f"s{k % 9}"))
    return rows


def brute_repeats(rows, n, keep_first):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or ""))
    texts, places = [(r[1] or "").encode() for r in rows], collections.defaultdict(list)
    for k in order:
        for p in range(len(texts[k]) - n + 1):
            places[texts[k][p:p + n]].append((k, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        first = found[0]
        for k, p in found if len(found) > 1 else ():
            # Rows with one doc_id and text are alike: with keep_first all of them are first copies.
            if not keep_first or (rows[k][:2], p) != (rows[first[0]][:2], first[1]):
                gone[k][p:p + n] = True
    out = []
    for (doc_id, *_), text, g in zip(rows, texts, gone):
        kept = bytes(np.frombuffer(text, np.uint8)[~g])
        out.append((str(doc_id), len(text), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats_of(frame, **options):
    rows = repeats.remove_repeats(frame, **options).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


def named(rows):
    """Without unnamed rows: their order is by a hash of the text."""
    return [r for r in rows if r[0] is not None]


@pytest.mark.parametrize("pieces", [repeats.PIECES, 3])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(repeats, "PIECES", pieces)  # few: hashes that many pieces share are cut again with longer grams
    rows = [r if r[0] != 9 else (9, "word " * 600, "en", "c") for r in odd_rows()]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert repeats_of(frame, keep_first=False) == brute_repeats(rows, 400, False)
    frame = spark.createDataFrame(named(rows), SCHEMA).repartition(3)
    assert repeats_of(frame, keep_first=True) == brute_repeats(named(rows), 400, True)


def test_repeats_in_few_letters_and_short_strings(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "".join(rng.choice(list("abé"), int(rng.integers(0, 90)))), "en", "s") for k in range(60)]
    for length in (1, 7, 12, 33):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert repeats_of(frame, min_bytes=length, keep_first=False) == brute_repeats(rows, length, False), length
        assert repeats_of(frame, min_bytes=length, keep_first=True) == brute_repeats(rows, length, True), length


def test_slices_cut_long_texts_without_losing_repeats(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 1 << 10)
    rng = np.random.default_rng(4)
    block = rng.integers(97, 123, 700, dtype=np.uint8)
    text = np.concatenate([rng.integers(97, 123, 2600, dtype=np.uint8), block, rng.integers(97, 123, 900, dtype=np.uint8), block])
    at, strings, hashes = repeats.cut(text, np.array([len(text)]), 100, 400)
    assert strings.sum() == len(text) - 399 and (at[1:] == (at + strings)[:-1]).all()
    of = np.repeat(hashes, strings)
    assert (of[2600:2901] == of[4200:4501]).all() and len(set(of[:2000].tolist())) > 5


def test_previous_factors():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    ranks = repeats.suffix_ranks(text, 300 - np.arange(300), 32)
    starts = np.arange(300 - 31)
    order = starts[np.lexsort((starts, ranks[-1][1][starts]))]
    found = dict(zip(order.tolist(), repeats.previous_factors(ranks, order, order).tolist()))
    data = bytes(text)
    for p in starts.tolist():
        best = max((next((h for h in range(32, 0, -1) if data[q:q + h] == data[p:p + h]), 0) for q in range(p)), default=0)
        assert found[p] == (32 if best == 32 else best // 8 * 8), p
    position = rng.permutation(50)
    near = repeats.smaller_before(position)
    assert near.tolist() == [max((j for j in range(k) if position[j] < position[k]), default=-1) for k in range(50)]


def test_repeats_keep_clashing_columns_and_empty_tables(spark):
    text = words(np.random.default_rng(3), 120)
    frame = spark.createDataFrame([(1, text, "o", "d", "s", 5), (2, text, "o", "d", "s", 6)],
                                  "doc_id long, text string, own string, _own string, base string, n_bytes int")
    out = repeats.remove_repeats(frame)
    assert out.columns == ["doc_id", "text", "own", "_own", "base", "kept", "n_bytes", "n_removed", "n_spans"]
    rows = sorted(out.collect())
    assert [(r.own, r._own, r.base, r.n_bytes, r.n_removed) for r in rows] == [("o", "d", "s", len(text), 0), ("o", "d", "s", len(text), len(text))]
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_keep_one_python_worker_a_task(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = repeats.remove_repeats(frame, keep_first=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, python = [], 0  # the nodes above a line of the tree, with their depths
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+-]*", line)[0])
        above = [x for x in above if x[0] < depth]
        if "ArrowEvalPython" in line:
            stage = [node for _, node in above]
            last = max((k for k, node in enumerate(stage) if "Exchange" in node), default=-1)
            assert not any("ArrowEvalPython" in node for node in stage[last + 1:]), plan
            python += 1
        above.append((depth, line))
    assert python == 3, plan


def test_op11_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = entry_points.queries()["op11_repeats"](spark, SMALL).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400, False)


def brute_divergence(rows, min_docs, top):
    rows = [(r[2] or "", r[3] or "", [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)
                                      for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        seen = collections.Counter(t for l, _, ts in rows if l == lang for t in set(ts))
        kept = sorted((t for t, n in seen.items() if n >= min_docs), key=str.encode)
        counts = {s: collections.Counter(t for l, o, ts in rows if (l, o) == (lang, s) for t in ts if seen[t] >= min_docs)
                  for s in {r[1] for r in rows if r[0] == lang}}

        def shares(own):
            total = sum(own.values())
            return {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole, p = shares(sum(counts.values(), collections.Counter())), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - whole[t], t) for t in kept if counts[s][t] and p[s][t] > whole[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, part, item, value, rank) for part, found in (("pair", pairs), ("term", terms[:top]))
                    for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, small):
    if small:  # many transducers, a pass for each, blocks of few ordinals and sources
        for name, value in (("SHARD_TERMS", 3), ("PASS_BYTES", 1), ("ORDINALS", 4), ("SOURCES", 2)):
            monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(6)
    rows = odd_rows() + [(300 + k, " ".join(rng.choice(["Ab", "aB", "É", "é", "日本", "x-y", "q_1"], 6)), "it", f"s{k % 5}") for k in range(60)]
    rows += [(400, "", "it", "none"), (401, "...", "pt", "p"), (402, None, "pt", "q")]
    names = ["doc_id", "text", "lang", "source", "term", "ordinal"]  # the last two clash with the operator's own
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], f"{SCHEMA}, term string, ordinal int").select(*names).repartition(3)
    got = sorted(map(tuple, divergence.audit(frame, 8, 10).collect()))
    assert got == brute_divergence(rows, 8, 10)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_transducer_numbers_terms_and_is_minimal():
    rng = np.random.default_rng(9)
    terms = sorted({"".join(rng.choice(list("abcé"), int(rng.integers(1, 7)))).encode() for _ in range(600)})
    machine = divergence.Transducer.load(divergence.Transducer(terms).dump())
    assert machine.ordinals(terms).tolist() == list(range(len(terms)))
    other = [b"zz", b"", terms[5] + b"q", b"a" * 50]
    assert machine.ordinals([t for t in other if t not in terms]).max() == -1
    assert divergence.Transducer([]).ordinals([b"a"]).tolist() == [-1]
    endings = sorted(a + b for a in (b"tap", b"top", b"step") for b in (b"", b"s", b"ped"))
    assert len(divergence.Transducer(endings).final) == 9  # the three endings are one part of the machine
    assert divergence.Transducer([b"abc", b"abd"]).ordinals([b"abd", b"ab"]).tolist() == [1, -1]


def test_shares_are_exact_beyond_long(spark):
    rows = spark.createDataFrame([(10**17 + 1, 3 * 10**17, 12345), (0, 0, 1)], "count long, total long, terms long")
    got = [r[0] for r in rows.select(divergence.share(*map(divergence.F.col, rows.columns))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in ((10**17 + 1, 3 * 10**17, 12345), (0, 0, 1))]


def brute_audit(rows, labels):
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    out = []
    failed = []
    for doc_id, text, *_ in rows:
        text = text or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        copied = doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, *_ in rows)
        failed.append({"A": len(own) < 100, "B": 100 * len(set(own)) < 80 * len(own), "D": bool(re.search("[#$%&*|]", text)),
                       "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "E": copied})
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total, lines = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for step, name in enumerate(order, 1):
                hit = {k for k in own if failed[k][name]}
                removed = hit & left
                left -= removed
                total[name] += len(removed)
                lines.append((name, part, order, step, len(left), len(removed), len(hit) - len(removed),
                              sum(sum(failed[k].values()) == 1 for k in hit), sum(rows[k][0] in good for k in removed),
                              sum(rows[k][0] in toxic for k in removed)))
        out += [(*line[1:], total[line[0]]) for line in lines]
    return sorted(out)


def test_filter_audit_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_ROWS", 7)
    rows = odd_rows() + [(500, "Ab ab AB " * 50, "en", "s"), (501, " ".join("abc"), "en", "s"), (502, "CAPS", "en", "s")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (None, 1, 1), (7, 1, None), (9999, 1, 1), (101, 1, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, part string, failed int").repartition(3)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, found)) == brute_audit(rows, labels)
    empty = filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))
    assert empty.count() == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_audit"])
def test_queries_equal_sql(spark, name):
    out = entry_points.queries()[name](spark, SMALL)
    names, want = sql_rows(database(SMALL), entry_points.oracle_sql()[name])
    assert sorted(out.columns) == names and rows_of(out.columns, out.collect()) == want


def test_filter_audit_shards_come_in_pieces(spark):
    rng = np.random.default_rng(6)
    rows = [(k, words(rng, 9000), "en", "a") for k in range(60)] + [(60, None, "en", "a")]
    parts = filter_audit.shards(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    blocks = [p for p in parts if p["block"] is not None]
    assert {p["shard"] for p in parts} == {0} and [p["block"] for p in blocks] == list(range(len(blocks)))
    assert len(blocks) == 5 and max(len(p["columns"]) for p in blocks) < filter_audit.BLOCK_CELLS + 9000
    names = [w for p in sorted((p for p in parts if p["words"] is not None), key=lambda p: p["first"]) for w in p["words"]]
    assert len(names) == len(set(names)) and max(len(p["words"] or ()) for p in parts) <= filter_audit.BLOCK_WORDS
    cells = [(i, collections.Counter({names[c].decode(): n for c, n in zip(np.cumsum(p["columns"])[a:b], p["counts"][a:b])}))
             for p in blocks for i, a, b in zip(p["doc_id"], p["starts"], p["starts"][1:])]
    assert cells == [(i, collections.Counter((text or "").split())) for i, text, _, _ in rows]
    found = filter_audit.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["n_words"], r["n_distinct"]) for r in found} == {(i, c.total(), len(c)) for i, c in cells}


def test_a_shard_is_freed_without_the_cyclic_collector():
    gc.collect()
    gc.disable()
    try:
        shard = filter_audit.Shard(0)
        shard.add(1, "en", b"one two one")
        list(shard.rest())
        del shard
        assert gc.collect() == 0
    finally:
        gc.enable()
