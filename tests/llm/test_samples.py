"""The bounded sample that the quality network is fitted on."""

from tablewell.llm import quality


def test_an_oversize_text_leaves_the_sample_alone(spark):
    texts = {k: "x" * (500 if k % 8 == 3 else 20) for k in range(40)}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, label int")
    got = quality.sampled(docs, known, 100, 400).collect()
    assert len(got) == 20 and {len(r.text) for r in got} == {20}
    assert quality.sampled(docs, known, 100, 1000).count() >= 26
    assert quality.sampled(docs, known, 7, 10**6).count() == 7
    assert {(r.doc_id, r.label) for r in quality.sampled(docs, known, 100, 10**6).collect()} == {(k, k % 2) for k in texts}
    assert quality.sampled(docs, known, 100, 10).count() == 0


def test_labels_of_one_class_give_their_share(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    for label, kept in ((1, 6), (0, 0)):
        assert quality.good_documents(docs, spark.createDataFrame([(k, label) for k in range(6)], "doc_id long, quality int")).count() == kept
