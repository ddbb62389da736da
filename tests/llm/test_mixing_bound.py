"""Rates have no upper bound: a scarce domain still reaches its target."""

from rivulet.llm import common, mixing


def test_scarce_domain_reaches_its_target(spark):
    rows = [(100, [0.98, 0.02] if k < 20 else [0.0, 1.0]) for k in range(1000)]
    table = common.materialise(spark.createDataFrame(rows, "mix_tokens long, mix_p array<double>"), "mix-test")
    rates, report = mixing.fit(table, ["high", "low"], targets={"high": 0.6, "low": 0.4})
    assert all(abs(report["reached"][d] - report["target"][d]) < 1e-3 * 100_000 for d in ("high", "low")), report
    bounded = mixing.fit(table, ["high", "low"], targets={"high": 0.6, "low": 0.4}, most=16.0)[1]
    print("unbounded", report, "bounded", bounded)
    assert bounded["reached"]["high"] < 0.35 * 100_000
