"""Whole jobs of the queries without SQL."""

from rimfold.plans import analysis

DATA = "/root/testdata/sf0.001"


def test_the_seeded_order_has_every_row(spark):
    got = analysis.smp1_seeded_order(spark, DATA).collect()
    every = [r["seq"] for r in analysis.scored(spark, DATA).select("seq").collect()]
    assert sorted(r["seq"] for r in got) == sorted(every) and len(got) > 100
    assert [r["place"] for r in got] == sorted(r["place"] for r in got)
