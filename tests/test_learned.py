import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxalog.operators import learned as L
from taxalog.operators.normalize import normalize
from taxalog.operators.taxonomy import rows as labels_of
from taxalog.operators.taxonomy import taxonomy
from taxalog.plans import catalog
from labelled_lines import FOREIGN_LINES, LINES

DESCRIPTIONS = [(row[3], row[6]) for row in labels_of()]


def flat(lines):
    return [(label, text) for label, texts in lines.items() for text in texts]


def nearest(vector_of, texts):
    """Label and cosine by plain loops over labels."""
    names, rows = [n for n, _ in DESCRIPTIONS], [vector_of(d) for _, d in DESCRIPTIONS]
    out = []
    for text in texts:
        v = vector_of(text)
        size = np.sqrt(v @ v)
        sims = [float(v @ r / (size * np.sqrt(r @ r))) if size else 0.0 for r in rows]
        out.append((names[int(np.argmax(sims))], max(sims)))
    return out


def accuracy(model, lines, threshold=L.LearnedEmbedder.threshold):
    found = nearest(lambda t: model.embed([t])[0].astype(float), [text for _, text in lines])
    return np.mean([name == label and sim >= threshold for (label, _), (name, sim) in zip(lines, found)])


def plain_features(text):
    """Every hashed feature of a text with its weight, written out one by one."""
    humps = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    humps = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", humps)
    words = [w.lower()[:64] for w in re.findall(r"[^\W\d_]+|(?<![\d.:/-])[1-5]\d\d(?![\d.:/-])", humps)]
    bag = Counter()

    def add(name, weight):
        bag[zlib.crc32(name.encode()) % 65536] += weight
    for word in set(words):
        if word.isdigit():
            add(f"n:{word}", 1), add(f"n:{word[0]}xx", 1)
            continue
        grams = [f"<{word}>"[i:i + n] for n in (3, 4, 5) for i in range(len(word) + 3 - n)]
        add(f"w:{word}", 1)
        for gram in grams:
            add(f"c:{gram}", len(grams) ** -0.5)
    for pair in set(zip(words, words[1:])):
        add(f"b:{pair[0]} {pair[1]}", 1)
    return bag


def plain_model(lines):
    """Primal ridge regression on the features that occur."""
    bags = [plain_features(text) for _, text in lines]
    seen = Counter(f for bag in bags for f in bag)
    used, names = sorted(seen), sorted({label for label, _ in lines})
    idf = {f: np.log((1 + len(lines)) / (1 + seen[f])) for f in used}

    def row(bag):
        return np.array([bag.get(f, 0) * idf[f] for f in used])
    x = np.array([row(b) / np.linalg.norm(row(b)) for b in bags])
    y = np.array([[float(label == n) for n in names] for label, _ in lines])
    per = Counter(label for label, _ in lines)
    w = np.array([len(lines) / (len(names) * per[label]) for label, _ in lines])[:, None]
    table = np.linalg.solve(x.T @ (w * x) + L.RIDGE * np.eye(len(used)), x.T @ (w * y))
    return lambda text: row(plain_features(text)) @ table


def test_vectors_are_those_of_the_plain_fit():
    lines = [("A.x", "Connection refused by 404 host"), ("A.x", "connectionReset on HTTPServer"), ("A.y", "user logged in"), ("A.y", "HTTP 200 ok")]
    model, plain = L.LearnedModel(lines), plain_model(lines)
    for text in ("connection refused", "HTTP 404", "a user logged in in", "nothing shared zzz", "", "12.404.3 404", "ünïcode Wörter"):
        np.testing.assert_allclose(model.embed([text])[0], plain(text), atol=1e-5)


def test_accuracy_on_lines_of_other_software():
    model = L.LearnedModel(L.labelled())
    assert accuracy(model, flat(FOREIGN_LINES)) >= 0.8
    assert accuracy(model, flat(LINES)) >= 0.95
    assert not {text for _, _, text in L.read_lines()} & {text for _, text in flat(FOREIGN_LINES) + flat(LINES)}


def test_accuracy_with_whole_software_left_out():
    lines = L.read_lines()
    software, right = sorted({s for _, s, _ in lines}), []
    for part in range(8):
        out = set(software[part::8])
        model = L.LearnedModel([(label, text) for label, s, text in lines if s not in out] + DESCRIPTIONS)
        held = [(label, text) for label, s, text in lines if s in out]
        right += [accuracy(model, held)] * len(held)
    assert np.mean(right) >= 0.78


def test_every_label_has_lines():
    count = defaultdict(int)
    for label, _, _ in L.read_lines():
        count[label] += 1
    assert set(count) == {name for name, _ in DESCRIPTIONS} and min(count.values()) >= 3


def test_normalization_with_the_learned_vector(spark):
    rows = [(1, "redis: Could not connect, connection refused"), (2, "   "), (3, None), (4, "==== 17 ===="), (5, "x" * 200_000),
            (6, "Cron job cleanup failed with nonzero exit"), (6, "Cron job cleanup failed with nonzero exit")]
    logs = spark.createDataFrame(rows, "seq long, raw string").withColumn("ts", F.timestamp_seconds("seq"))
    out = sorted((r["seq"], f"{r['type']}.{r['category']}") for r in normalize(logs, taxonomy(spark), L.LearnedEmbedder()).collect())
    assert out[0] == (1, "ERROR.connection_failure") and out[-1] == out[-2] == (6, "SCHEDULED.cron_failed")
    assert {kind for _, kind in out[1:3]} == {"UNCLASSIFIED.empty_log"} or out[1][1].startswith("UNCLASSIFIED.")
    assert out[3][1].startswith("UNCLASSIFIED") and len(out) == 7
    assert normalize(logs.limit(0), taxonomy(spark), L.LearnedEmbedder()).count() == 0


@pytest.mark.parametrize("cache", [3])
def test_memory_of_words_is_bounded(monkeypatch, cache):
    model = L.LearnedModel(L.labelled())
    want = model.embed(["connection refused by host after retry"])
    monkeypatch.setattr(L, "MAX_KNOWN", cache)
    model.known.clear()
    assert np.array_equal(model.embed(["connection refused by host after retry"]), want) and len(model.known) <= cache


def test_query_equals_plain_search(spark):
    table = "/root/testdata/sf0.001"
    model = L.LearnedModel(L.labelled())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{table}/documents.parquet").collect()}
    got = catalog.queries()["classify_learned"](spark, table).collect()
    assert len(got) == len(texts)
    want = nearest(lambda t: model.embed([t])[0].astype(float), [texts[r["doc_id"]] for r in got])
    for r, (name, sim) in zip(got, want):
        assert r["confidence"] == pytest.approx(sim, abs=2e-4)
        assert f"{r['type']}.{r['category']}" == name or sim < L.LearnedEmbedder.threshold


ODD_TEXTS = ["", " ", "HTTPServer 404 parseXMLFile9Abc iPhone aB ABc Ab a A", "İstanbul ÀÉ Straße ΑΣ σίγμαΣ", "𝔘nicode 𐐀bc 漢字kanjiX", "²x 12.404.3 404 x404y 4045",
             "x" * 70 + "Y" * 70 + "İ" * 70 + "𝔘" * 70, "one two one two one", "a_b-c/d 500:x 501 a501B", "retry " * 300]


def test_words_are_those_of_the_text_with_humps_parted():
    hump = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    for text in ODD_TEXTS + [text for _, text in flat(LINES)]:
        assert L.line_words(text) == [w[:64].lower() for w in L._WORD.findall(hump.sub(" ", text))]


def test_vectors_are_sums_over_plain_features(monkeypatch):
    model = L.LearnedModel(L.labelled() + [("A.x", text) for text in ODD_TEXTS])
    texts, rng = ODD_TEXTS + [text for _, text in flat(LINES)], np.random.default_rng(4)
    texts += [" ".join("".join(map(chr, rng.choice([*range(97, 123), 228, 1086, 28450, 120120], rng.integers(1, 9)))) for _ in range(60)) for _ in range(40)]

    def plain(text):
        rows = [(model.place[f], weight) for f, weight in plain_features(text).items() if model.place[f] >= 0]
        return sum((weight * model.table[place].astype(float) for place, weight in rows), np.zeros(len(model.names)))
    want = np.array([plain(t) for t in texts])
    for slice_size, cache in ((1, 3), (200, 200_000), (1 << 19, 50)):
        monkeypatch.setattr(L, "SLICE", slice_size), monkeypatch.setattr(L, "MAX_KNOWN", cache)
        model.known.clear()
        np.testing.assert_allclose(model.embed(texts), want, atol=1e-4)
        assert np.array_equal(model.embed(texts[::-1])[::-1], model.embed(texts))
    assert model.embed([]).shape == (0, len(model.names))


def test_pairs_and_words_met_first_cost_little():
    """Time in units of that for the words alone, which was 18 when every new pair was a lookup with a vector of its own."""
    rng = np.random.default_rng(8)
    parts = ["an", "ber", "co", "de", "er", "ing", "lo", "mo", "re", "st", "ta", "un"]
    words = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words, 500)) for _ in range(200)]

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began
    alone = min(seconds(lambda: [L.line_words(t) for t in texts]) for _ in range(3))
    models = [L.LearnedModel(L.labelled()) for _ in range(3)]
    assert min(seconds(lambda: m.embed(texts)) for m in models) < 10 * alone
