"""Language identification: n-grams and learning against plain forms, held-out accuracy, edge cases."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from steerframe.llm import catalog, language_id as li


def grams_by_hand(text):
    """Counts of the character n-grams, as tuples of code points."""
    points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    points = [32, *points, 32]
    points = [c for i, c in enumerate(points) if not (i and c == 32 == points[i - 1])]
    out = Counter(tuple(points[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(points) - n + 1))
    del out[(32,)]
    return out


def test_grams_against_a_plain_count():
    for text in ["Straße 12, né!", "a", "x" * 5000, "один два", "İstanbul"]:
        by_bucket = Counter()
        for gram, count in grams_by_hand(text).items():
            rolled = np.uint32(gram[0])
            with np.errstate(over="ignore"):
                for point in gram[1:]:
                    rolled = rolled * np.uint32(0x01000193) ^ np.uint32(point)
            by_bucket[int(li._bucket(np.array([rolled], np.uint32), len(gram))[0])] += count
        buckets, counts = li.grams(text)
        assert dict(zip(buckets.tolist(), counts.tolist())) == dict(by_bucket)
    for text in (None, "", " 12 !", "\n"):
        assert not len(li.grams(text)[0])


def test_leader_separates_and_stays_sparse():
    rng = np.random.default_rng(2)
    rows, classes = [], []
    for _ in range(300):
        k = int(rng.integers(0, 3))
        buckets = np.unique(np.append(rng.choice(np.arange(100, 2000), 30), [k, k + 3]))
        x = np.ones(len(buckets))
        x[np.isin(buckets, [k, k + 3])] = 3.0
        rows.append((buckets, x / np.linalg.norm(x)))
        classes.append(k)
    weights, bias = li.follow_the_leader(rows, classes, 3)
    assert all(np.argmax(x @ weights[b] + bias) == k for (b, x), k in zip(rows, classes))
    assert (weights.any(axis=1)).sum() < 500  # the L1 penalty keeps most weights at zero


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(3)
    z = rng.standard_normal((400, 3)) * 6
    classes = np.array([rng.choice(3, p=li.softmax(row / 5)) for row in z])

    def loss(t):
        return -np.log(li.softmax(z / t)[np.arange(400), classes]).mean()

    t = li.fit_temperature(z, classes)
    assert 3.5 < t < 7 and all(loss(t) <= loss(other) + 1e-9 for other in np.linspace(1, 15, 57))


def test_document_frequencies_cover_all_documents(spark):
    texts = ["ab", "abc", "zz 1", None, "", "9", "ab ab ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    holding = Counter(b for t in texts for b in li.grams(t)[0].tolist())
    docs = sum(len(li.grams(t)[0]) > 0 for t in texts)
    want = np.array([np.log((1 + docs) / (1 + holding[b])) + 1 for b in range(li.DIM)])
    assert np.allclose(li.inverse_frequencies(df), want)


def test_edge_cases(spark, docs, no_docs):
    model = li.train(docs)
    rows = li.predict(docs, model).collect()
    assert len(rows) == docs.count() and model.langs == ["en"]
    text = {(r.doc_id, r.text) for r in docs.collect()}
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)
    unknown = {i for i, t in text if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == unknown
    assert li.predict(no_docs, li.train(no_docs)).count() == 0
    assert {r.lang_pred for r in li.predict(docs, li.train(no_docs)).collect()} == {"und"}


def test_held_out_accuracy_and_order(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    predicted = catalog.QUERIES["op11_language_id"](spark, sf).join(lang, "doc_id").filter("held_out")
    right, n = predicted.agg(
        F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")
    ).first()
    assert n > 200 and right >= 0.98 * n
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = li.train(docs), li.train(docs.repartition(7))
    assert np.array_equal(one.weights, other.weights) and one.temperature == other.temperature
    # labels of documents that are held out teach nothing
    changed = docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert np.array_equal(one.weights, li.train(changed).weights)


@pytest.mark.parametrize("rows", [4, 40])
def test_sample_is_bounded_and_even(spark, rows):
    data = [(i, f"text {i}", "de" if i < 5 else "en") for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    counts = Counter(r.lang for r in li.training_sample(df, rows).collect())
    assert counts == {"de": min(5, rows // 2), "en": rows // 2}
