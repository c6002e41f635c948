"""Edges and traces keep to joins by key where tables grow."""

from loamline.operators import graph
from loamline.operators import trace as T
from loamline.sources import bridge as B


def test_edges_meet_files_by_key(spark, sf_dir):
    for relation in (B.edges, B.coverage_lines, B.symbols):
        plan = relation(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan, relation.__name__


def test_walk_is_the_same_by_key(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("a", "b", "*"), ("a", "b", "f"), ("b", "c", "*"), ("c", "d", "@import"), ("d", "e", "*"), ("a", "a", "*"), ("x", "b", "*")], "src string, dst string, symbol string").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    seeds = spark.createDataFrame([("s", "a"), ("t", "x")], "seed string, path string")
    want = sorted([("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("s", "d", 3), ("t", "x", 0), ("t", "b", 1), ("t", "c", 2), ("t", "d", 3)])
    for few in (100, 0):
        monkeypatch.setattr(graph, "FEW", few)
        found, followed = T.walk(edges, seeds)
        assert sorted(tuple(r) for r in found.collect()) == want and followed.count() == 6
        assert sorted(tuple(r) for r in T.walk(edges, seeds, most=2)[0].collect()) == [r for r in want if r[2] < 2]
