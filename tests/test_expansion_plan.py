import duckdb
import pytest

from mnemoframe.operators import expansion
from mnemoframe.plans import catalog
from mnemoframe.plans import expansion as _  # noqa: F401


def test_the_last_plan_of_an_expansion_is_small(spark):
    """What several sources read is found once, not written out again wherever it is read."""
    make = spark.createDataFrame
    queries = make([(1, "red", 1), (1, "blue", 2)], "query_id long, word string, place int")
    pairs, df = make([("green", "red", 3.0)], "w1 string, w2 string, pmi double"), make([("green", 5), ("red", 5)], "term string, df long")
    synonyms, clusters = make([("blue", "azure", 1)], "key string, synonym string, ord long"), make([("red", "a"), ("rose", "a")], "word string, cluster string")
    got = expansion.expand(queries, pairs, df, 200, synonyms, clusters, make([("azure", "navy")], "parent string, child string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert {(r.word, round(r.weight, 6)) for r in got.collect()} == {("red", 1.0), ("blue", 1.0), ("green", 0.6), ("azure", 0.9), ("rose", 0.85), ("navy", 0.5)}


@pytest.mark.parametrize("name", ["r14_field_terms", "r15_expansion"])
def test_clusters_of_all_words(spark, tmp_path, name):
    """Words of any letter are in clusters: amber and coral meet over beryl only, as ruby and topaz over slate."""
    texts = ["amber beryl", "beryl coral", "ruby slate", "slate topaz"] * 2 + [f"w{chr(97 + k)}x z{chr(97 + k)}y" for k in range(24)] * 2
    spark.createDataFrame([(k // 8, k % 8, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "amber"), (2, "ruby")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    for table in ("conversations", "benchmark"):
        db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall())
    assert {(1, "coral"), (2, "topaz")} <= {(q, w) for q, w, _ in got}
