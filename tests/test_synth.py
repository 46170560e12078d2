import pytest
from pyspark.sql import functions as F

from hopline.functions.epoch import epoch_ms, third_window
from hopline.operators import synth


def test_nodes_do_not_depend_on_partitioning(spark):
    one = synth.nodes_for(spark.range(500).coalesce(1)).collect()
    many = synth.nodes_for(spark.range(500).repartition(7)).orderBy("id").collect()
    assert one == many


def test_node_domains(spark):
    nodes = synth.generate_nodes(spark, 20_000)
    shares = {r.category: r["count"] for r in nodes.groupBy("category").count().collect()}
    assert set(shares) == set(synth.CATEGORIES)
    assert all(2_200 < n < 2_800 for n in shares.values())
    low, high, mean, t0, t1 = nodes.agg(
        F.min("value"), F.max("value"), F.avg("value"), F.min("ts"), F.max("ts")
    ).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.02
    assert synth.TS_BASE <= t0 and t1 < synth.TS_BASE + synth.TS_SPAN


def test_edges(spark):
    edges = synth.generate_edges(spark, 50, 20_000)
    assert edges.where("src = dst").count() == 0
    assert edges.where("src < 0 or src >= 50 or dst < 0 or dst >= 50").count() == 0
    assert edges.select("dst").distinct().count() == 50
    assert {r[0] for r in edges.select("edge_type").distinct().collect()} == set(synth.EDGE_TYPES)
    with pytest.raises(ValueError):
        synth.generate_edges(spark, 1, 5)


def test_vectors(spark):
    nodes = synth.generate_vector_nodes(spark, 300, dim=15)
    rows = nodes.collect()
    assert all(len(r.embedding) == 15 for r in rows)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
    mean = sum(sum(r.embedding) for r in rows) / (300 * 15)
    assert abs(mean) < 0.02


def test_window_thirds():
    assert third_window(10, 100) == (43, 76)


def test_epoch_does_not_depend_on_the_session_zone(spark):
    df = spark.sql(
        "select timestamp_ntz'2024-03-31 02:30:00.123456' as t,"
        " timestamp_ntz'1969-12-31 23:59:59.9995' as u"
    )
    try:
        for zone in ("UTC", "Europe/Paris"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(epoch_ms(df, "t"), epoch_ms(df, "u")).first() == (1711852200123, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
