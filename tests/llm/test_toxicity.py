import numpy as np
from odd import check_shapes, clashing, documents, sentence

from pricetrail.llm import toxicity
from pricetrail.llm.common import WorkFolder, table

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    """Learnt from labels of even ids; judged on odd ids. Some labels have no basis in their text."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), WorkFolder(spark, "test"))
    scored = toxicity.score(docs, chain).withColumnRenamed("toxic", "called")
    rows = scored.join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    toxic = np.array([r.toxic for r in rows], bool)
    called = np.array([r.called for r in rows], bool)
    assert called[toxic].mean() >= 0.85
    assert called[~toxic].mean() <= 0.02


def test_long_clean_texts(spark):
    """Clean texts in other languages that were held out, joined to very long ones, stay clean."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), WorkFolder(spark, "test"))
    clean = docs.join(labels.where("toxic = 0 AND doc_id % 2 = 1"), "doc_id", "left_semi")
    rows = clean.where("lang IN ('de', 'fr', 'es')").orderBy("lang", "doc_id").collect()
    joined, lang, parts, size = [], None, [], 0
    for row in rows:
        if row.lang != lang:
            lang, parts, size = row.lang, [], 0
        parts.append(row.text or "")
        size += len(parts[-1])
        if size >= 100_000:
            joined.append((len(joined), "\n".join(parts)))
            parts, size = [], 0
    assert len(joined) >= 12
    called = toxicity.score(spark.createDataFrame(joined, "doc_id long, text string"), chain)
    assert called.where("toxic").count() <= 0.05 * len(joined)


def test_passages_cover_the_text():
    chain = toxicity.Chain(["a"], ["bad", "worse"], [], 0.5, [1.0, 3.0])
    search = chain.automaton()
    for n in (0, 1, 1990, 2010, 3000, 50_000):
        text = "x " * (n // 2) + "bad worse"
        found, passages = chain.present(text, search)
        assert sorted(found) == [0, 1]
        assert (passages + 1) * toxicity.PASSAGE // 2 >= len(text)
    assert chain.present("bad " + "x " * 5000 + "worse", search) == ([1], 10)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 4)) < 0.3).astype(float)
    first = x[:, 0] * 1.0
    second = np.maximum(first, x[:, 1])
    folds = np.arange(600) % toxicity.FOLDS
    weights, out = toxicity.train(x, {"a": first, "b": second}, folds)
    assert [len(w) for w in weights] == [5, 6]
    assert weights[1][4] > 0.5  # the first category's probability speaks for the second
    assert ((out >= 0.5) == (second == 1)).mean() > 0.98
    chain = toxicity.Chain(["a", "b"], list("wxyz"), weights, 0.5)
    p = chain.probabilities(x)
    assert p.shape == (600, 2) and ((p[:, 1] >= 0.5) == (second == 1)).all()


def test_threshold():
    p = np.array([0.9, 0.8, 0.8, 0.3, 0.2])
    toxic = np.array([1, 1, 1, 0, 0], bool)
    assert toxicity.best_threshold(p, toxic, np.ones(5)) == 0.55


def rows_and_labels():
    rows = [(k, sentence(k, 20) + (" idiot scum" if k % 3 == 0 else "")) for k in range(90)]
    odd = [(200, None), (201, ""), (202, "IDIOT! Scum."), (203, "scums idiotic"), (None, "idiot scum"),
           (204, sentence(4, 9000) + " idiot, scum"), (205, "nonidiot unscum " * 9)]
    labels = [(k, int(k % 3 == 0)) for k in range(90)] + [(0, 0), (None, 1), (5, None), (999, 1)]
    return rows + odd + rows[:2], labels


def test_odd_documents(spark):
    rows, labels = rows_and_labels()
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = check_shapes(documents(spark, rows), lambda df: toxicity.toxicity(df, clashing(given)))
    called = {r[0]: r[-1] for r in got}
    want = {k: "idiot" in (t or "").lower() for k, t in rows} | {205: False}
    want[None] = True
    assert called == want
    kept = toxicity.without_toxic(
        documents(spark, rows), toxicity.fit(documents(spark, rows), given, WorkFolder(spark, "t"))
    )
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(
        repr(k) for k, _ in rows if not want[k]
    )


def test_without_labels(spark):
    rows, labels = rows_and_labels()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    elsewhere = spark.createDataFrame([(7001, 1), (7002, 0)], "doc_id long, toxic int")
    for given in (none, one_class, elsewhere):
        got = toxicity.toxicity(documents(spark, rows), given).collect()
        assert len(got) == len(rows)
        assert not any(r.toxic for r in got) and all(r.p_toxic is None for r in got)
