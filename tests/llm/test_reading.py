import numpy as np

from lexmill.llm import reading

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Fitted on three quarters of the ratings, the model agrees with the others, whose ratings hold some errors."""
    passages, labels = spark.read.parquet(f"{DATA}/passages.parquet"), spark.read.parquet(f"{DATA}/reading_labels.parquet").filter("reading_level IS NOT NULL")
    fitted_on, held_out = labels.filter("row_id % 4 <> 0"), labels.filter("row_id % 4 = 0")
    got = reading.reading_levels(passages, fitted_on).join(held_out.withColumnRenamed("reading_level", "rated"), "row_id").collect()
    agree = [(r["reading_level"] >= 4) == (r["rated"] >= 4) for r in got]
    assert len(agree) > 40 and sum(agree) / len(agree) > 0.95
    assert sum(abs(r["reading_level"] - r["rated"]) <= 1 for r in got) / len(got) > 0.95


def test_cases(spark):
    easy, hard = "the cat sat on a red mat and saw my dog " * 4, "notwithstanding epistemic ontology whose hermeneutics attenuate discursive normativity insofar as praxis " * 4
    rows = [(i, easy) for i in range(10)] + [(10 + i, hard) for i in range(10)] + [(30, None), (31, ""), (32, "too short"), (33, hard * 3000), (34, hard), (34, hard)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "row_id bigint, content string, reading_level int, slots int")
    labels = spark.createDataFrame([(0, 1, "a"), (1, 2, "a"), (1, 1, "b"), (10, 5, "a"), (11, 4, "b"), (12, None, "b"), (999, 3, "c")], "row_id bigint, reading_level int, rater string")
    got = reading.reading_levels(df, labels)
    assert sorted(r["row_id"] for r in reading.found(df, labels).collect()) == [*range(10, 20), 33, 34, 34]
    assert got.filter("row_id < 10 AND reading_level < 3").count() == 10
    unrated = reading.reading_levels(df, labels.limit(0))
    assert unrated.filter("difficulty IS NULL").count() == 23 and reading.found(df, labels.limit(0)).count() == 0
    assert reading.reading_levels(df.limit(0), labels).count() == 0
    # with equal ratings only, nothing or everything is hard
    assert reading.found(df, spark.createDataFrame([(0, 1), (10, 1)], "row_id bigint, reading_level int")).count() == 0


def test_words_and_levels_are_recovered():
    """From occurrences drawn by the model itself, Newton steps find the words, and the words the levels."""
    rng = np.random.default_rng(3)
    n_docs, n_words = 3000, 400
    level, lengths = rng.normal(0, 1, n_docs).clip(-2.5, 2.5), rng.integers(2, 7, n_docs)
    true = np.stack([rng.normal(-2, 1, n_words), rng.normal(0, 1, n_words), -np.abs(rng.normal(0, 0.3, n_words))])
    chance = 1 / (1 + np.exp(-(np.stack([np.ones(n_docs), level, level**2]).T @ true + reading.LENGTHS[lengths][:, None])))
    occurs = rng.random((n_docs, n_words)) < chance
    flat = np.nonzero(occurs)[1]
    offsets = np.concatenate([[0], np.cumsum(occurs.sum(axis=1))])
    by_word, cells = reading._sums(flat, offsets, level, lengths, n_words)
    assert by_word[0].sum() == occurs.sum() and abs(cells.sum() - n_docs) < 1e-6
    found = reading.newton(by_word, cells)
    assert np.corrcoef(found[0], true[0])[0, 1] > 0.97 and np.corrcoef(found[1], true[1])[0, 1] > 0.95
    model = reading.Model(found, reading.absent(found))
    got, _ = reading._levels(model, flat, offsets, lengths, np.full(n_docs, np.nan))
    assert np.corrcoef(got, level)[0, 1] > 0.97 and np.abs(got - level).mean() < 0.25
    # what is summed in tables is the likelihood of all words, those that don't occur included
    one = np.stack([np.ones_like(reading.GRID), reading.GRID, reading.GRID**2]).T @ found + reading.LENGTHS[lengths[0]]
    by_hand = (one * occurs[0]).sum(axis=1) - np.logaddexp(0, one).sum(axis=1)
    assert np.allclose(model.likelihood(flat[: offsets[1]], offsets[:2], lengths[:1])[0], by_hand)


def test_the_likelihood_rises_to_its_top(spark):
    passages, labels = spark.read.parquet(f"{DATA}/passages.parquet"), spark.read.parquet(f"{DATA}/reading_labels.parquet")
    fitted = reading.fit(reading.documents(passages, "row_id", "content", 30, 3, 1e-5), labels, 1e-4, 5000)
    assert len(fitted.likelihoods) > 2 and all(b > a for a, b in zip(fitted.likelihoods[:-2], fitted.likelihoods[1:-1]))
    assert fitted.likelihoods[-1] - fitted.likelihoods[-2] <= 1e-4 * abs(fitted.likelihoods[-2])
    # hundreds of thousands of distinct rare words change nothing: none shares its place with another
    filler = spark.range(20_000).selectExpr("id + 10000000 AS row_id", "array_join(transform(sequence(1, 30), i -> concat('zz', id, 'q', i)), ' ') AS content")
    want = {r["row_id"]: r["reading_level"] for r in reading.reading_levels(passages, labels).collect()}
    more = reading.reading_levels(passages.select("row_id", "content").unionByName(filler), labels).filter("row_id < 10000000")
    got = {r["row_id"]: r["reading_level"] for r in more.collect()}
    assert sum((got[k] >= 4) == (want[k] >= 4) for k in want) >= 0.98 * len(want)


def test_words_are_fitted_alike_in_workers(spark):
    rng = np.random.default_rng(5)
    cells = np.zeros((len(reading.LENGTHS), len(reading.GRID)))
    cells[3:6] = rng.integers(0, 50, (3, len(reading.GRID)))
    n = rng.integers(3, 500, 900).astype(float)
    centre = rng.normal(0, 0.5, 900)
    by_word = np.stack([n, n * centre, n * (centre**2 + 0.3 + rng.random(900))])
    here = reading.fit_words(spark, by_word, cells, None)
    there = reading.fit_words(spark, by_word, cells, None, driver_words=10)
    # steps end for a whole batch at once, so a word may take one more
    assert np.allclose(here.words, there.words, atol=5e-3) and np.allclose(here.absent, there.absent, rtol=1e-3)
    again = reading.fit_words(spark, by_word, cells, here.words, driver_words=10)
    assert np.allclose(again.words, here.words, atol=5e-3)
