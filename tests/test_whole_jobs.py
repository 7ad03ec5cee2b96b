from umbraframe.plans import more as M
from umbraframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_every_conversation_is_augmented(spark):
    convs = lambda df: {r.conv_id for r in df.select("conv_id").distinct().collect()}
    got = convs(Q.augment_map(spark, SF))
    assert got == convs(Q._mentions(spark, SF)) and max(got) >= 10


def test_all_records_by_recency(spark):
    got = Q.vault_recency(spark, SF).collect()
    assert len(got) == Q.vault_records(spark, SF).count() > 25
    assert got == sorted(got, key=lambda r: (-r.last_seq, r.placeholder))


def _filtered_below(spark, query):
    """How often the optimised plan filters below a generator: such a filter holds the whole of detection once more for each use."""
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Generate explode") :].count("Filter (")


def test_feedback_is_not_detected_twice(spark):
    assert _filtered_below(spark, M.feedback_emitted) == 0


def test_counts_are_not_detected_twice(spark):
    assert _filtered_below(spark, M.enabled_counts) == 0
