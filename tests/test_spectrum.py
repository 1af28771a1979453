from siftwork import queries


def test_all_pairs_of_graphs_are_compared(spark, monkeypatch):
    e = spark.createDataFrame([(1, "a", "b"), (4, "a", "b"), (4, "b", "c"), (9, "x", "y")], "graph_id int, src string, dst string")
    monkeypatch.setattr(queries, "event_edges", lambda spark, d: e)
    got = {(r.a, r.b): round(r.distance, 6) for r in queries.spectrum_distance(spark, "").collect()}
    assert got == {(1, 4): 1.0, (1, 9): 0.0, (4, 9): 1.0}
