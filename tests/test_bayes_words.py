import random

from tidewire.operators import bayes


def table(articles):
    rng = random.Random(3)
    words = ["the", "up", "down", "flat", "gain", "loss", "calm", "odd"]
    rows = [("A" if i % 3 else "B", i, "2024-01-02", rng.choice(words), "s", " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(60)]
    rows.append(("A", 1, "2024-01-02", "up up", "s", "the"))    # a key that comes twice
    return articles(rows)


def test_words_are_counted_without_a_shuffle(spark, articles):
    """Before, every word of every article was shuffled to be counted, three times beyond the broadcast."""
    from pyspark.sql import functions as F

    news = table(articles)
    rows = bayes.labelled_rows(news.filter("ord % 2 = 0").withColumn("directional_sentiment", (F.col("ord") % 3 - 1).cast("int")))
    small, large = bayes.predict(news, rows), bayes.predict(news, rows, broadcast_bytes=-1)
    assert sorted(small.collect()) == sorted(large.collect())
    for found in (small, large):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        keys = [line.split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
        assert not [k for k in keys if "ord#" in k and "word#" in k]
