import random
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelled_lines import FOREIGN_LINES, LINES
from taxalog.functions.vectors import cosine, masked_mean, project
from taxalog.operators import classify, embed, evaluate, taxonomy
from taxalog.operators.normalize import classify as label_logs
from taxalog.operators.normalize import Normalizer, normalize, split_rejects
from taxalog.options import Options, check_range, parse_verbosity

LABEL_SCHEMA = "ord int, path string, severity string, vector array<float>"
AXES = [(0, "A.x", "error", [1., 0., 0.]), (1, "B.y", "info", [0., 1., 0.]), (2, "C.z", "info", [0., 0., 1.])]


@pytest.mark.parametrize("match", [classify.dense_match, classify.dense_match_native])
@pytest.mark.parametrize("vector, labels, threshold, want", [
    ([.9, .1, 0.], AXES, .5, ("A.x", .9939)),
    ([.7, .7, 0.], [(0, "A.x", "error", [1., 0., 0.])], .99, ("UNCLASSIFIED", .7071)),
    ([1., 0., 0.], [], .5, ("UNCLASSIFIED", 0.)),
    ([0., 0., 0.], AXES[:1], .5, ("UNCLASSIFIED", 0.)),
    ([1., 0.], [(0, "A", "info", [1., 0.]), (1, "B", "info", [1., 0.])], 0., ("A", 1.)),
    ([.5, .5], [(0, "A", "info", [1., 0.])], 0., ("A", .7071)),
    ([1., 0.], [(0, "A", "info", [-1., 0.]), (1, "B", "info", [1., 0., 0.])], 0., ("B", 0.)),
    ([], AXES, 0., ("A.x", 0.)),
])
def test_nearest_label(spark, match, vector, labels, threshold, want):
    labels = spark.createDataFrame(labels, LABEL_SCHEMA)
    rows = spark.createDataFrame([(vector,)], "v array<float>")
    found = classify.resolve(F.col("m"), labels, threshold)
    row = rows.withColumn("m", match(F.col("v"), labels)).select(found.alias("f")).first()["f"]
    assert (row["path"], round(row["confidence"], 4)) == want


@pytest.mark.parametrize("a, b, want", [
    ([1., 0.], [0., 1.], 0), ([1., 2.], [1., 2.], 1), ([1., 0.], [-1., 0.], -1), ([1., 2.], [1., 2., 3.], 0),
    ([], [], 0), ([0., 0.], [1., 2.], 0),
])
def test_cosine(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(want)


def test_batch_and_native_form_agree(spark):
    rnd = np.random.default_rng(1)
    labels = spark.createDataFrame([(i, f"L.{i}", "info", v.tolist()) for i, v in enumerate(rnd.normal(size=(20, 8)))], LABEL_SCHEMA)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(300, 8)))], "id int, v array<float>")
    v = F.col("v")
    out = rows.select(classify.dense_match(v, labels).alias("a"), classify.dense_match_native(v, labels).alias("b")).collect()
    assert all(r["a"]["ord"] == r["b"]["ord"] and abs(r["a"]["similarity"] - r["b"]["similarity"]) < 1e-9 for r in out)


def test_lexical_against_model(spark):
    rnd = random.Random(2)
    pool = " ".join(r[6] for r in taxonomy.rows()).replace(":", "").split() + ["zebra", "quux", "Été"]
    texts = [" ".join(rnd.choices(pool, k=rnd.randrange(1, 15))) for _ in range(200)] + ["zebra quux", "..."]
    labels = taxonomy.taxonomy(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["m"] for r in rows.select("id", classify.lexical_match(F.col("text"), labels).alias("m")).collect()}

    def bag(text):
        return {w for w in text.lower().replace(":", " ").replace("été", "ete").replace(".", " ").replace("_", " ").split()}
    sets = [bag(r[6]) for r in taxonomy.rows()]
    weight = classify.importance(list(enumerate(sets)))

    def norm(words):
        return sum(weight.get(w, 0) ** 2 for w in words)
    for i, text in enumerate(texts):
        words = bag(text)
        sims = [norm(words & s) / (norm(words) * norm(s)) ** .5 if norm(words) else 0 for s in sets]
        assert got[i]["similarity"] == pytest.approx(max(sims)), text
        assert got[i]["ord"] == sims.index(max(sims))


def test_term_join_by_hand(spark):
    rows = spark.createDataFrame([(1, "dial dial tcp"), (2, "zebra"), (3, None), (4, ""), (5, "cron tcp cron"), (6, "b a b")], "id int, text string")
    label_terms = spark.createDataFrame([(0, "dial", 1), (0, "tcp", 2), (1, "cron", 3), (2, "a", 1), (3, "a", 1)], "ord int, token string, weight long")
    got = {r["id"]: (r["match"]["ord"], r["match"]["similarity"]) for r in
           classify.nearest_label_sparse(rows, "id", "text", label_terms).collect()}
    assert got == {1: (0, pytest.approx(4 / 25 ** .5)), 2: (0, 0.), 3: (0, 0.), 4: (0, 0.), 5: (1, pytest.approx(6 / 45 ** .5)), 6: (2, pytest.approx(1 / 5 ** .5))}
    none = classify.nearest_label_sparse(rows, "id", "text", label_terms.limit(0)).collect()
    assert len(none) == 6 and all(r["match"] is None for r in none)


def labelled(spark, lines):
    rows = spark.createDataFrame([(path, line) for path, own in lines.items() for line in own], "want string, raw string")
    found = label_logs(rows, taxonomy.taxonomy(spark))
    return [(r["want"], f"{r['type']}.{r['category']}") for r in found.collect()]


def test_own_lines_at_the_default_threshold(spark):
    assert set(LINES) == {r[3] for r in taxonomy.rows()} and min(map(len, LINES.values())) >= 2
    found = labelled(spark, LINES)
    assert sum(want == got for want, got in found) >= .95 * len(found)


def test_lines_of_other_software_at_the_default_threshold(spark):
    """Written without regard to the label words; half of them is what a bag of words does here."""
    found = labelled(spark, FOREIGN_LINES)
    assert sum(want == got for want, got in found) >= .5 * len(found)


def test_events_do_not_depend_on_partitioning(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["connection refused", "", " \t\n ", "deploy failed", "x" * 300, "\x00\x01 binary", "login failed"] * 20)], "seq long, raw string")
    logs = texts.withColumn("ts", F.timestamp_seconds("seq"))
    results = [sorted(normalize(logs.repartition(n), options=Options(threshold=.2)).collect()) for n in (1, 8)]
    assert results[0] == results[1]
    blank = [r for r in results[0] if r["category"] == "empty_input"]
    assert len(blank) == 40 and {(r["severity"], r["confidence"], r["summary"]) for r in blank} == {("warning", 0.0, "")}
    assert {r["raw"] for r in blank} == {"", " \t\n "}


# Executors cannot import this module, so its model travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class OnlyWords:
    def embed(self, texts):
        if any(not t.strip() for t in texts):
            raise AssertionError("blank text reached the model")
        if any("BAD" in t for t in texts):
            raise RuntimeError("bad row")
        return np.array([[t.count("a"), t.count("b"), 1] for t in texts], dtype=np.float32)


def test_bad_rows_stay_alone_and_blank_rows_skip_the_model(spark):
    logs = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "BAD", "good again", "", " "])], "seq long, raw string") \
        .withColumn("ts", F.timestamp_seconds("seq")).coalesce(1)
    good, rejected = split_rejects(normalize(logs, embedder=classify.ModelEmbedder(OnlyWords), options=Options(threshold=0.)))
    assert sorted(r["seq"] for r in good.collect()) == [0, 2, 3, 4]
    assert [(r["seq"], r["error"]) for r in rejected.collect()] == [(1, "RuntimeError: bad row")]


def test_label_failure_fails_the_run(spark):
    roots = {"R": [taxonomy.Leaf("l", "info", "BAD label")]}
    with pytest.raises(Exception, match="bad row"):
        embed.embed_labels(taxonomy.taxonomy(spark, roots), OnlyWords).collect()


def test_no_labels(spark):
    row = Normalizer(spark, roots={}).classify_texts(spark.createDataFrame([("hello",)], "text string")).first()
    assert (row["type"], row["category"], row["severity"], row["confidence"]) == ("UNCLASSIFIED", "", "warning", 0.0)


def test_embed_once_with_hot_texts(spark):
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    out = embed.embed_once(rows, "text", lambda d: d.withColumn("n", F.length("text")), salt_rows=100)
    assert out.count() == 5000 and sorted(out.columns) == ["n", "seq", "text"]
    assert out.filter("n <> length(text) or n is null").count() == 0
    blank = embed.embed_once(rows.withColumn("text", F.lit(None).cast("string")), "text", lambda d: d.withColumn("n", F.length("text")))
    assert blank.filter("n is null").count() == 5000


def test_word_pieces(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##ed", "a", "]", "[", "b", "日"])}
    texts = ["playing a]b[", "", None, "plays", "a " * 300, "日 PLAYED", "a" * 201]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = {r["id"]: r["r"] for r in rows.select("id", embed.word_piece_ids(F.col("text"), vocab).alias("r")).collect()}
    assert got[0]["ids"] == [2, 4, 5, 7, 8, 10, 9, 3]
    assert got[1]["ids"] == [2, 3] and got[2]["ids"] == [2, 3]
    assert got[3]["ids"] == [2, 1, 3] and got[3]["n_unk"] == 1
    assert got[4]["n_tokens"] == 128 and got[4]["truncated"] and got[4]["ids"][-1] == 3
    assert got[5]["ids"] == [2, 11, 4, 6, 3]
    assert got[6]["ids"] == [2, 1, 3]
    ids, mask = embed.pad_ids([[2, 3], [2, 4, 3]])
    assert ids.tolist() == [[2, 3, 0], [2, 4, 3]] and mask.tolist() == [[1, 1, 0], [1, 1, 1]]
    with pytest.raises(ValueError, match="SEP"):
        embed.check_vocab({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2})


def toy_network():
    return lambda ids, mask: np.stack([ids == 4, ids == 5, ids * 0 + 1], axis=2).astype(np.float32)


def test_transformer_embedder(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "alpha", "beta"])}
    weights = np.array([[1, 0, 0], [0, 1, 0]], dtype=np.float32)
    embedder = classify.TransformerEmbedder(vocab, toy_network, weights)
    roots = {"R": [taxonomy.Leaf("a", "info", "alpha"), taxonomy.Leaf("b", "error", "beta")]}
    texts = ["alpha alpha", "beta", "", "alpha beta beta beta", "nothing"]
    logs = spark.createDataFrame(list(enumerate(texts)), "seq long, raw string").withColumn("ts", F.timestamp_seconds("seq"))
    out = normalize(logs, taxonomy.taxonomy(spark, roots), embedder).orderBy("seq").collect()
    assert [r["category"] for r in out] == ["a", "b", "empty_input", "b", ""]
    vector = logs.filter("seq = 3").select(embedder.encode(F.col("raw"))["vector"].alias("v")).first()["v"]
    assert vector == pytest.approx([1 / 6, 3 / 6])


def test_pooling_and_projection(spark):
    hidden = np.array([[[1., 2.], [3., 4.], [9., 9.]], [[5., 5.], [7., 7.], [1., 1.]]])
    assert embed.mean_pool(hidden, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2., 3.], [0., 0.]]
    rows = spark.createDataFrame([(1, [1., 2.], 1), (1, [3., 4.], 1), (1, [9., 9.], 0), (2, [5., 5.], 0)], "k int, v array<float>, m int")
    means = {r["k"]: r["mean"] for r in masked_mean(rows, ["k"], "v", 2, "m").collect()}
    assert means == {1: [2., 3.], 2: [0., 0.]}
    out = spark.createDataFrame([([1., 2., 3.],), ([1.],)], "v array<float>").select(
        project(F.col("v"), np.array([[1, 1], [0, 2]]))).collect()
    assert [r[0] for r in out] == [[3., 4.], [0., 0.]]


def test_reports(spark):
    judged = evaluate.judge(
        spark.createDataFrame([(1, "A.x", "error", .9), (2, "A.x", "info", .8), (3, "B.y", "info", .6), (4, "UNCLASSIFIED", "warning", .2)],
                              "id int, path string, severity string, confidence double"),
        spark.createDataFrame([(1, "A.x", "error"), (2, "A.x", "error"), (3, "A.x", "error"), (4, "B.y", "info")],
                              "id int, expected_path string, expected_severity string"), "id")
    assert evaluate.accuracy(judged).first().asDict() == {
        "total": 4, "correct": 2, "incorrect": 1, "unclassified": 1, "accuracy_pct": 50.0}
    assert evaluate.severity_consistency(judged).first().asDict() == {"checked": 2, "mismatches": 1}
    sweep = {r["threshold"]: (r["correct"], r["incorrect"], r["net_accuracy_pct"]) for r in evaluate.threshold_sweep(judged).collect()}
    assert sweep[.5] == (2, 1, pytest.approx(200 / 3)) and sweep[.85] == (1, 0, 100.) and len(sweep) == 8
    tip = evaluate.threshold_suggestion(judged).first()
    assert tip["gap"] == pytest.approx(.4) and not tip["overlap"] and tip["suggested"] == pytest.approx(.6)
    labels = spark.createDataFrame([(0, "A.x"), (1, "B.y"), (2, "C.z")], "ord int, path string")
    cover = evaluate.leaf_coverage(labels, judged.select("expected_path")).orderBy("ord").collect()
    assert [(r["n_rows"], r["missing"], r["too_few"]) for r in cover] == [(3, False, False), (1, False, True), (0, True, True)]


def test_taxonomy(spark):
    labels = taxonomy.taxonomy(spark)
    assert labels.count() == 42
    roots = {r["root"]: r for r in taxonomy.by_root(labels).collect()}
    assert {k: v["n_leaves"] for k, v in roots.items()} == {
        "ERROR": 9, "REQUEST": 5, "DEPLOY": 7, "SYSTEM": 5, "ACCESS": 5, "PERFORMANCE": 5, "DATA": 3, "SCHEDULED": 3}
    assert roots["DATA"]["labels"][0].asDict() == {"name": "query_executed", "path": "DATA.query_executed", "severity": "info"}
    for _, root, leaf, path, severity, desc, text in taxonomy.rows():
        assert path == f"{root}.{leaf}" and text == f"{root}: {desc}" and severity in evaluate.SEVERITIES


@pytest.mark.parametrize("bad", [dict(threshold=float("nan")), dict(threshold=1.5), dict(verbosity="loud"), dict(limit=-1),
                                 dict(dedup_window_s=-1), dict(limit=-5)])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Options(**bad).validate()


def test_ranges_and_verbosity():
    assert [parse_verbosity(v) for v in ("minimal", "full", "loud", None)] == ["minimal", "full", "standard", "standard"]
    with pytest.raises(ValueError):
        check_range(None, datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        check_range(datetime(2026, 1, 2), datetime(2026, 1, 2))
