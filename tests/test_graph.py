from mnemoframe.operators import graph


def test_components_of_long_chains(spark):
    """Chains take many rounds; what the planner holds of a round does not grow with the rounds before it."""
    edges = [(k, k + 1) for k in range(0, 300) if k % 100] + [(500, 501), (501, 500), (7, 7)]
    found = graph.components(spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in edges], "a string, b string"))
    least = {k: 1 if k <= 100 else 101 if k <= 200 else 201 for k in range(1, 301)} | {500: 500, 501: 500}
    assert {int(r.node): int(r.component) for r in found.collect()} == least
    plan = found._jdf.queryExecution().optimizedPlan()
    assert int(str(plan.stats().sizeInBytes())) < 1 << 63 and str(plan.constraints()).count("#") < 20
