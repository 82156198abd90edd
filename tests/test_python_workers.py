from pyspark.sql import functions as F

from tidewire.operators import relevance
from tidewire.schemas import RULES


def test_all_word_lists_of_a_row_share_one_python_worker(spark):
    """Before, each of the four lists took a worker of its own in every task."""
    rules = spark.createDataFrame([("A", ["x", None], ["p"], ["d"], [], ["low"]), ("B", [], [], [], [], [])], RULES)
    patterns = relevance.rule_patterns(rules)
    plan = patterns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    found = {r["ticker"]: r for r in patterns.orderBy(F.col("ticker")).collect()}
    assert found["A"]["direct_re"] == "(?iu)(?:d|p)" or found["A"]["direct_re"].startswith("(?iu)")
    assert found["B"]["target_re"] == relevance.NEVER and found["B"]["low_re"] == relevance.NO_LIST
