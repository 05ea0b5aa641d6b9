"""Pairs of person and concept are counted in small pieces of the events."""

from mirrorcheck.operators import sequences as sq

SIZE, MOST = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_pairs_are_counted_in_small_pieces(spark, monkeypatch):
    a = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (None, 5), (3, 6), (4, None)], "person_id long, x int")
    b = spark.createDataFrame([(1, 5), (3, 5), (1, 7), (2, 7), (4, None)], "person_id long, y long")
    seen, before, stable = [], (spark.conf.get(SIZE), spark.conf.get(MOST, None)), sq.stable
    monkeypatch.setattr(sq, "stable", lambda df: (seen.append((spark.conf.get(SIZE), spark.conf.get(MOST))), stable(df))[1])
    assert {tuple(r) for r in sq.qualified_concepts([(a, "x"), (b, "y")], 2).collect()} == {(5, 4), (7, 2)}
    assert seen == [("16MB", "1000")]
    assert (spark.conf.get(SIZE), spark.conf.get(MOST, None)) == before
