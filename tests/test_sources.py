"""File loaders, writers and streams."""

import pytest
from pyspark.sql import functions as F

from lamella.packaging import ship
from lamella.sources import graphs, sinks
from lamella.streaming import coactivity


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,layer\na,b,work\nb,a,work\nb,c,lunch\nc,c,lunch\n")
    (tmp_path / "n.csv").write_text("node,group,role\nb,G2,x\na,G1,y\nc,NA,z\n")
    e, n = graphs.read_edge_list(spark, str(tmp_path / "e.csv"), str(tmp_path / "n.csv"))
    assert sorted(map(tuple, e.collect())) == [("lunch", 1, 2, 1.0), ("lunch", 2, 1, 1.0), ("work", 0, 1, 1.0), ("work", 1, 0, 1.0)]
    assert {(r.name, r.label) for r in n.collect()} == {("a", 1), ("b", 2), ("c", None)}
    (tmp_path / "bad.csv").write_text("source,target,layer\na,zz,work\n")
    with pytest.raises(ValueError):
        graphs.read_edge_list(spark, str(tmp_path / "bad.csv"), str(tmp_path / "n.csv"))


def test_contacts(spark):
    people = spark.createDataFrame([("1", " Teacher ", "F"), ("2", "PC", "M"), ("3", "PC", "F")], "id string, class string, gender string")
    log = spark.createDataFrame([(1323468000.0, "1", "2", "a", "b"), (1323468020.0, "2", "1", "b", "a"), (1323468040.0, "2", "2", "b", "b"), (1323554400.0, "2", "3", "b", "b")], graphs.CONTACTS)
    e, n = graphs.contact_layers(log, people)
    assert e.count() == 4 and {r.layer for r in e.collect()} == {"2011-12-09", "2011-12-10"}
    assert {(r.name, r.label) for r in n.collect()} == {("1", 2), ("2", 1), ("3", 1)}
    with pytest.raises(ValueError):
        graphs.contact_layers(log.limit(0), people)
    with pytest.raises(ValueError):
        graphs.contact_layers(log, people.filter("id <> '3'"))


def test_citations_triples_and_triplets(spark):
    papers = spark.createDataFrame([(i, [float(i % 2), 1.0, float(i)], "A" if i < 3 else "B") for i in range(5)] + [(9, [1.0, 1.0, 1.0], "C")], "id long, features array<double>, class string")
    cites = spark.createDataFrame([(0, 1), (1, 3), (9, 1)], "cited long, citing long")
    e, n = graphs.citation_layers(papers, cites, ["A", "B"], k=2)
    assert n.count() == 5 and e.filter("layer = 'cites'").count() == 4
    lines = spark.createDataFrame([("1 1 2",), ("2 2  3",), ("",)], "value string")
    assert graphs.layered_triples(lines).count() == 4
    cells = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 1, 1.0), ("a", 1, 0, -1.0)], "layer string, i long, j long, x double")
    assert [tuple(r) for r in graphs.triplets(cells).collect()] == [("a", 0, 1, 1.0)]
    with pytest.raises(ValueError):
        graphs.triplets(cells.withColumn("x", F.lit(float("nan"))))
    with pytest.raises(TypeError):
        graphs.single_layer(cells)
    with pytest.raises(ValueError):
        graphs.single_layer(cells.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("x").alias("weight")))


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 0, 1.0)], "layer string, src long, dst long, weight double")
    sinks.write_graphml(e, spark.createDataFrame([(0,), (1,)], "node long"), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.count("<edge ") == 1 and text.startswith("<?xml") and text.rstrip().endswith("</graphml>")
    sinks.write_table(e, str(tmp_path / "t"), tab=True)
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    sinks.write_trace(spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.9)], "trial int, iteration int, error double"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_stream_matches_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(*coactivity.EVENTS.names)
    batch.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = coactivity.hourly_activity(coactivity.events(spark, str(tmp_path / "in")), "100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("hourly").count()
    assert got == batch.select("event_type", F.date_trunc("hour", "ts"), "user_id").distinct().count()


def test_ship_is_idempotent(spark):
    ship(spark)
    ship(spark)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
