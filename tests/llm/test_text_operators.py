"""Operators on documents against brute force over small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from taxalog.llm import catalog, decontaminate, graph, language, line_dedup, mixing, simhash_dedup
from taxalog.llm.words import fingerprint

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls, blanks, repeats, a long text, groups of copies and near copies."""
    words = [f"w{k}" for k in range(400)]
    base = " ".join(words)
    rows = [(1, base, "en", "a", 1), (2, base.upper(), "en", "a", 1), (3, base + " tail", None, "a", 1),
            (4, None, "en", None, 1), (5, "", "de", "b", 1), (6, " \t\n", None, "b", 1), (7, "x", "fr", "c", 1),
            (7, "x", "fr", "c", 1), (None, base, "en", "a", 1), (None, None, None, None, None),
            (8, "word " * 60_000, "en", "c", 1), (9, "ÀÉ Straße " * 30, "de", "b", 1), (10, "one two three", "en", "a", 1)]
    rng = np.random.default_rng(7)
    for k in range(60):  # near copies: one word of many replaced
        own = list(words)
        own[int(rng.integers(400))] = f"z{k % 9}"
        rows.append((100 + k, " ".join(own), "en", "hot", 1))
    return rows


def brute_components(rows, width, radius):
    prints = [fingerprint((r[1] or "").encode(), width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)].append(r[0])
    return [(r[0], prints[k], min(ids[find(k)], default=None)) for k, r in enumerate(rows)]


def as_signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprint_is_the_plain_one():
    for text in ["", None, "a", "a b c", "A b\vc\fd\re", "é x y z É", "one two three four five six one two three four"]:
        assert fingerprint((text or "").encode(), 4) == plain_fingerprint(text, 4)


@pytest.mark.parametrize("piece", [4096, 7])
def test_simhash_components(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash_dedup, "PIECE", piece)  # 7: runs are cut into pieces
    rows = odd_rows()
    got = simhash_dedup.assign_components(documents(spark, rows)).collect()
    want = [(i, as_signed(p), c) for i, p, c in brute_components(rows, 4, 4)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_close_pair_is_linked(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(as_signed(p), k) for k, p in enumerate(prints)], "fp long, node long")
    found = {tuple(r) for r in graph.components(simhash_dedup.near_links(frame, 4, blocks)).collect()}
    want = brute_links(prints, 4)
    assert found == want


def brute_links(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    groups = collections.Counter(label)
    return {(k, x) for k, x in enumerate(label) if groups[x] > 1}


def test_components_of_a_chain_and_odd_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(60, 60), (61, 60)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_one_of_each_group(spark):
    rows = odd_rows()
    kept = simhash_dedup.keep_first(documents(spark, rows).withColumn("component_id", mixing.F.lit("mine")))
    assert kept.columns == [*SCHEMA.replace(",", "").split()[::2], "component_id"]
    assert sorted(map(tuple, kept.drop("component_id").collect()), key=repr) == sorted(brute_firsts(rows), key=repr)
    # Rows without doc_id belong to groups like others: here both have a component with names.
    base, other = rows[0][1], " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (None, base), (None, base + " tail"), (None, other), (None, other), (None, None), (2, ""), (7, "x"), (7, "x"), (7, "y " * 9)]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    names = "doc_id long, text string, _own string, _o string, _row long"  # names that the operator uses itself
    kept = simhash_dedup.keep_first(documents(spark, rows, names))
    assert kept.columns == names.replace(",", "").split()[::2]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(brute_firsts(rows), key=repr)
    assert simhash_dedup.keep_first(documents(spark, [])).count() == 0


def brute_firsts(rows):
    """A row of each component: the smallest doc_id, of those without one the only text."""
    prints, best = [fingerprint((r[1] or "").encode(), 4) for r in rows], {}
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            one = rows[a][0] is not None and rows[a][0] == rows[b][0]  # rows of one doc_id are one document
            if label[a] != label[b] and (one or (prints[a] ^ prints[b]).bit_count() <= 4):
                label = [label[b] if x == label[a] else x for x in label]
    for row, group in zip(rows, label):
        best[group] = min(best.get(group, row), row, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return list(best.values())


def duck(tables, sql):
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame)
    return sorted(db.execute(sql).fetchall(), key=repr)


def test_lines_against_plain_python(spark):
    shared = "  This Line is shared by many documents, is it not?\t"
    other = "another line that is long enough to count but rare"
    rows = [(k, f"{shared}\nown {k}\n{shared.upper()}\n\n{other if k < 4 else ''}", "en", "s", 1) for k in range(9)]
    rows += [(20, None, None, None, None), (21, "", "", "", 0), (22, shared, "en", "s", 1), (22, shared, "en", "s", 1),
             (None, shared + "\nx", "en", "s", 1), (None, "y\n" + shared, "en", "s", 1), (None, None, "en", "s", 1), (23, "é" * 39 + "\n" + "é" * 40, "fr", "s", 1)]
    docs = documents(spark, rows).withColumn("n_lines", mixing.F.lit("old"))
    got = line_dedup.drop_shared_lines(docs)
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "n_lines", "n_dropped"]
    holders = collections.defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\v\f\r").lower()
            if len(key) >= 40 and i is not None:
                holders[key].add(i)
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders[x.strip(" \t\n\v\f\r").lower()]) < 5 or max(h) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.drop_shared_lines(documents(spark, [])).count() == 0


def test_mix_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 700, None: 300, "é": 0, "z": 64}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [k for k in names if k not in full]
        rest = left - sum(2 * sizes[k] for k in full)
        target = {k: 2 * sizes[k] if k in full else rest * weight[k] / sum(weight[x] for x in free) for k in names}
        over = {k for k in free if target[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(target)


def test_mix_takes_what_it_should(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(0, 200)), "en", f"s{k % 5}" if k % 3 else "hot", 1) for k in range(900)]
    rows += [(None, "a b", None, None, None), (5, None, "en", "s0", 1), (6, "x y", "en", "s1", 1), (6, "x y", "en", "s1", 1)]
    docs = documents(spark, rows).withColumn("target", mixing.F.lit("old"))
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(int)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.times) == r.copies and all(0 <= t <= 1 for t in r.times)
        by[r.source, r.target] += r.taken
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 200
    again = mixing.plan(documents(spark, rows).repartition(7)).collect()
    assert sorted((repr((r.doc_id, r.source, r.taken, r.times)) for r in got)) == sorted(repr((r.doc_id, r.source, r.taken, r.times)) for r in again)
    ordered = mixing.arrange(documents(spark, rows)).collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert len(ordered) == sum(r.copies for r in got)
    early = [r.source for r in ordered[:200]], [r.source for r in ordered[-200:]]
    assert early[0].count("hot") > early[1].count("hot")  # the first source's schedule falls
    assert mixing.arrange(documents(spark, [])).count() == 0
    assert mixing.plan(documents(spark, [(1, None, None, None, None)])).first().taken == 0


def brute_contaminated(docs, items):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def grams(w):
        return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    out = {}
    for i, text, *_ in docs:
        w = words(text)
        for j, item in items:
            x = words(item)
            own = grams(x)
            if len(x) < 5 and w != x:
                continue  # so few words match nothing but a whole text
            for at in range(max(1, len(w) - len(x) + 1)) if own and w else []:
                have = grams(w[at:at + len(x)])
                both = sum((have & own).values())
                s = both / (sum(have.values()) + sum(own.values()) - both)
                if s >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), s)
    return out


def test_contamination_against_all_windows(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))
    items = [(k, prose(20 + 7 * k)) for k in range(8)] + [(8, "too short"), (9, None), (10, ""), (11, "a a a a a a a a b"),
                                                          (None, prose(30)), (0, prose(25))]
    docs = []
    for k in range(60):
        item = items[k % len(items)][1] or ""
        leak = item.split()
        if k % 4 == 1 and len(leak) > 15:
            leak[len(leak) // 2] = "changed"
        if k % 4 == 2:
            leak = [x.upper() + "," for x in leak]
        if k % 4 == 3:
            leak = leak[:len(leak) // 2]
        docs.append((k, f"{prose(80)} {' '.join(leak)} {prose(40)}", "en", "s", 1))
    docs += [(100, items[3][1], "en", "s", 1), (100, items[4][1], "en", "s", 1), (101, None, None, None, None), (102, "", "", "", 0),
             (103, "Too SHORT!", "en", "s", 1), (None, prose(9) + " " + items[2][1], "en", "s", 1),
             (None, prose(60), "en", "s", 1), (None, None, "en", "s", 1), (104, "b a a a a a a a a a b", "en", "s", 1)]
    frame, bench = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}
    want = brute_contaminated(docs, items)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != pytest.approx(want.get(k))} == {}
    kept = [r.doc_id for r in decontaminate.clean(frame, bench).collect()]
    bad = {i for i, _ in got} - {None}
    clean = [d[0] for d in docs if d[0] not in bad and not (d[0] is None and brute_contaminated([d], items))]
    assert clean.count(None) == 2 and sorted(kept, key=repr) == sorted(clean, key=repr)
    assert decontaminate.contaminated(frame, bench.where("false")).count() == 0
    assert decontaminate.contaminated(frame.where("false"), bench).count() == 0


def test_contamination_in_blocks_of_the_benchmark(spark, monkeypatch):
    items = [(k, " ".join(f"t{k}x{j}" for j in range(12))) for k in range(6)]
    docs = [(k, items[k % 6][1], "en", "s", 1) for k in range(20)]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 9)
    got = decontaminate.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(k, k % 6, 1.0) for k in range(20)}


def test_simhash_index_finds_every_print_in_the_radius(spark):
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(400):
        a = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        flips = rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        pairs.append((as_signed(a), as_signed(a ^ sum(1 << int(f) for f in flips))))
    frame = spark.createDataFrame(pairs, "a long, b long")
    exact, near = (decontaminate.block_keys(mixing.F.col(c), k) for c, k in (("a", 0), ("b", decontaminate.RADIUS // decontaminate.BLOCKS)))
    assert frame.where(mixing.F.arrays_overlap(exact, near)).count() == len(pairs)


def test_decontamination_runs_no_python(spark):
    frame = decontaminate.doc_shingles(decontaminate.named(spark.read.parquet(f"{SMALL}/documents.parquet")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("split(") == 1


def test_language_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = documents(spark, [(10_001, None, None, None, None), (10_002, " 123 %%", "en", "s", 1), (None, "der und die", "de", "s", 1),
                            (10_003, "the and of in " * 100_000, None, "s", 1)])
    both = docs.unionByName(odd).withColumn("score", mixing.F.lit("old"))
    model = language.train(both)
    rows = language.identify(both, model).collect()
    assert len(rows) == docs.count() + 4
    by = {r.doc_id: r for r in rows}
    assert by[10_001].lang_pred == by[10_002].lang_pred == "und" and by[10_001].score == 0
    assert by[10_003].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang and r.lang_pred != "und"]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert sorted(r.doc_id for r in both.where(language.held_out() & both.doc_id.isNotNull()).collect()) == sorted(
        r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = language.known(both, model)
    assert kept.columns == both.columns[:-1] and kept.count() >= 0.95 * docs.count()
    assert language.train(both.where("false")) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


def test_language_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", mixing.F.when(language.held_out(), "xx").otherwise(mixing.F.col("lang")))
    a, b = language.train(docs), language.train(other)
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_long_texts_are_counted_whole():
    text = "abc déf " * 300_000
    assert language.gram_counts(text).sum() == sum(len(text) - n + 1 for n in language.ORDERS)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert out.columns == columns, name
        assert out.count() <= before.count(), name
        before = corpus_pipeline.stored(out, name)
    ids = {r.doc_id for r in before.collect()}
    last = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in last} <= ids and len(ids) > 50
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_queries_against_sql(spark, name):
    from compare import database, rows_of, sql_rows
    out = catalog.queries()[name](spark, SMALL)
    names, want = sql_rows(database(SMALL), catalog.oracle_sql()[name])
    assert sorted(out.columns) == names
    assert rows_of(out.columns, out.collect()) == want


def test_kept_text_digest(spark):
    row = catalog.op7(spark, SMALL).where("n_dropped = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
