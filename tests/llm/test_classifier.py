"""Co-training on documents with known quality."""
import numpy as np

from peakgrid.llm import classifier

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=300):
    rng = np.random.default_rng(2)
    good, bad = [f"word{i}" for i in range(200)], [f"W{i}!!" for i in range(200)]
    rows = []
    for i in range(n):
        words = rng.choice(bad if i % 3 == 0 else good, 60)
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = corpus(spark)
    model = classifier.train(classifier.vectors(docs), classifier.vectors(docs), labels)
    got = {r.doc_id: r for r in classifier.score(classifier.vectors(docs), model).collect()}
    assert len(got) == 300
    unseen = [i for i in got if i % 2]
    assert np.mean([(got[i].score >= 0.5) == (i % 3 != 0) for i in unseen]) > 0.98
    for view in ("p_content", "p_metadata"):
        assert np.mean([(got[i][view] >= 0.5) == (i % 3 != 0) for i in unseen]) > 0.9
    kept = classifier.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].score >= 0.5}


def test_views_move_rows_to_each_other(spark):
    """A view without labels of its own kind profits from the other: more unlabelled rows, same answers twice."""
    docs, labels = corpus(spark)
    few = labels.filter("doc_id < 40")
    models = [classifier.train(classifier.vectors(docs), classifier.vectors(docs), few, rounds=r, quota=30, sure=0.6) for r in (0, 2, 2)]
    assert not np.allclose(models[0].content, models[1].content)
    assert np.array_equal(models[1].content, models[2].content)
    got = {r.doc_id: r.score for r in classifier.score(classifier.vectors(docs), models[1]).collect()}
    assert np.mean([(s >= 0.5) == (i % 3 != 0) for i, s in got.items()]) > 0.97


def test_one_class_no_labels_nulls_and_clashing_columns(spark):
    docs, labels = corpus(spark, 60)
    assert classifier.train(classifier.vectors(docs), classifier.vectors(docs), labels.filter("quality = 1")) == 1.0
    assert classifier.train(classifier.vectors(docs), classifier.vectors(docs), labels.limit(0)) == 1.0
    assert classifier.keep_good(docs, 1.0).count() == 60
    model = classifier.train(classifier.vectors(docs), classifier.vectors(docs), labels)
    odd = spark.createDataFrame([(None, None, None, None, None, "a", 1.0), (5, "", "xx", "new", -3, "b", 2.0), (5, "word1 " * 100_000, None, "s1", 600_000, None, 3.0),
                                 (5, "", "xx", "new", -3, "b", 2.0)], KIND + ", row string, score double")
    assert classifier.score(classifier.vectors(odd), model).count() == 4
    assert classifier.keep_good(odd, model, 0.0).schema == odd.schema
    assert classifier.keep_good(odd, model, 0.0).count() == 4
    assert classifier.score(classifier.vectors(docs.limit(0)), model).count() == 0
    assert classifier.keep_good(docs.drop("lang", "n_chars"), model).columns == ["doc_id", "text", "source"]


def test_contradictory_labels_do_not_count(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1), (3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in classifier.clean_labels(labels).collect()] == [(2, 1)]


def test_shape_covers_the_whole_word():
    assert classifier._shape("字" * 30 + "12") == "a0" and classifier._shape("字" * 32) == "a"
    assert classifier._shape("a1" * 40 + "=") == "a0=" and classifier._shape("Ab-1") == "Aa-0"
