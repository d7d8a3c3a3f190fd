"""Profiles of cells that are dealt out once."""

from sievelake.operators import profile as P
from sievelake.plans import profile_queries as Q


def test_cells_are_not_shuffled_again(spark, sf):
    c, stats = Q.profiled(spark, sf)
    for d in (P.field_stats(c), P.temporal(c, stats), P.sequential(c), P.change_points(c), P._with_anomalies(c)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(user_id") + plan.count("Exchange hashpartitioning(coll") <= 3 and "Exchange hashpartitioning(coll#" not in plan.split("Generate")[-1]


def test_flags_are_those_of_the_rows(spark, sf):
    c = Q.event_cells(spark, sf)
    colls = lambda d: {r.coll for r in d.select("coll").distinct().collect()}
    assert colls(P._with_outliers(c)) == colls(P.structural_outliers(c)) != set()
    assert colls(P._with_anomalies(c)) == colls(P.anomalies(c)) != set()
