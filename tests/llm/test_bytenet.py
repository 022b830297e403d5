import zlib

import numpy as np
from tests.llm.conftest import SF

from quarry.llm import bytenet, queries


def _area(scores, labels):
    rank = np.empty(len(scores))
    rank[np.argsort(scores)] = np.arange(len(scores))
    return (rank[labels == 1].mean() - rank[labels == 0].mean()) / len(scores) + 0.5


def test_held_out_documents_are_told_apart(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = bytenet.train(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"), spark.read.parquet(f"{sf}/labels.parquet"), per_class=400)
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 0")
    got = {r.doc_id: r.score for r in bytenet.score(held, model).collect()}
    known = [k for k in got if k in labels]
    scores, truth = np.array([got[k] for k in known]), np.array([labels[k] for k in known])
    assert _area(scores, truth) > 0.99
    assert ((scores >= 0.3) == truth).mean() > 0.97 and (scores[truth == 1] >= 0.3).mean() > 0.98


def test_the_query_and_defined_cases(spark, documents, no_documents):
    rows = queries.op11_quality(spark, SF).collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = bytenet.train(documents, labels, per_class=20)
    got = {r.doc_id: r.score for r in bytenet.score(documents.selectExpr("*", "1 as id", "2 as score"), model).collect()}
    assert len(got) == documents.count() and got[0] == got[1] and got[5] == got[6]
    assert bytenet.train(documents, labels.where("quality = 1")) is None and bytenet.train(no_documents, labels) is None
    assert {r.score for r in bytenet.score(documents, None).collect()} == {0.5}
    assert bytenet.score(no_documents, model).count() == 0


def test_scores_do_not_depend_on_the_texts_beside(spark):
    net = bytenet.Net.fresh(np.random.default_rng(1))
    texts = [b"", b"a", b"one two three", b"ab" * 7000, bytes(range(256)) * 40, b"one two three"]
    together = net.score(texts)
    np.testing.assert_allclose(together, [net.score([t])[0] for t in texts], atol=2e-6)
    assert together[2] == together[5]


def test_chunks_cover_every_window_and_pool_like_a_plain_loop():
    net = bytenet.Net.fresh(np.random.default_rng(2))
    texts = [b"x", b"y" * 511, bytes(np.random.default_rng(3).integers(0, 256, 5000, dtype=np.uint8))]
    data, begin, end = bytenet.padded(texts)
    first, stop, text = bytenet.spans(begin, end)
    for k in range(len(texts)):
        seen = {w for a, b in zip(first[text == k], stop[text == k], strict=True) for w in range(a, b)}
        assert seen == set(range(begin[k], end[k]))
    got = net.maxima(data, first, stop)
    plain = np.stack([(net.windows(data, int(a), int(b)) @ net.filters).max(0) for a, b in zip(first, stop, strict=True)])
    np.testing.assert_allclose(got, plain, atol=1e-5)


def test_training_follows_the_slope_of_the_loss():
    rng = np.random.default_rng(5)
    good = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma"], 40)) for _ in range(60)]
    bad = [b" ".join(rng.choice([b"alpha##", b"beta##", b"gamma##"], 40)) for _ in range(60)]
    net = bytenet.fit(good + bad, np.array([1.0] * 60 + [0.0] * 60, dtype=np.float32), epochs=6)
    assert net.score(good).min() > 0.9 and net.score(bad).max() < 0.1
