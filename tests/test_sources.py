"""Files in and out, result operators, planning and streaming."""

import json

import golden
import pytest
from pyspark.sql import functions as F

from hopweave.operators import grouping, merge, paths
from hopweave.plans import order
from hopweave.sources import kgx, results
from hopweave.streaming import ingest


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def files(tmp_path):
    nodes = [{"id": "TEST:" + n, "category": ["biolink:" + c for c in cats], "name": n} for n, cats in golden.NODES] + [{"id": "TEST:none", "category": []}, {"id": "TEST:absent"}]
    edges = [{"subject": "TEST:" + s, "predicate": "biolink:" + p, "object": "TEST:" + t} for s, p, t in golden.EDGES]
    edges += [{"subject": "TEST:Gene_A", "predicate": "biolink:subclass_of", "object": "TEST:Gene_B"}, {"subject": "TEST:none", "predicate": "biolink:affects", "object": "TEST:Gene_B"}, {"subject": "TEST:Gene_A", "predicate": "biolink:affects", "object": "TEST:nowhere"}, edges[0]]
    return write_lines(tmp_path / "nodes.jsonl", nodes), write_lines(tmp_path / "edges.jsonl", edges)


def test_records_and_matrices(spark, tmp_path):
    g = kgx.read_graph(spark, *files(tmp_path), golden.ONTOLOGY)
    assert (g.catalog.count(), g.directed.count()) == (14, 22)
    kgx.write_matrices(g, str(tmp_path / "m"))
    again = kgx.read_matrices(spark, str(tmp_path / "m"), golden.ONTOLOGY)
    assert again.base.exceptAll(g.base).isEmpty() and g.base.exceptAll(again.base).isEmpty()
    assert kgx.read_catalog(spark, str(tmp_path / "m")).count() == 14
    some = kgx.read_matrices(spark, str(tmp_path / "m"), golden.ONTOLOGY, ["treats"])
    assert {r["pred"] for r in some.catalog.collect()} == {"treats"}
    plan = some.base._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "treats" in plan.split("PartitionFilters")[1]
    needed = kgx.needed_matrices(g.directed, 2, "SmallMolecule", "treats", "F", "Disease")
    assert ("SmallMolecule", "treats", "Disease") in {tuple(r) for r in needed.collect()}


def test_qualifiers_in_fields(spark):
    from hopweave.operators.graph import Graph

    nodes = spark.createDataFrame([("a", ["Drug"]), ("b", ["Gene"])], "id string, category array<string>")
    edges = spark.createDataFrame([("a", "biolink:causes", "b", "decreased", "activity_or_abundance"), ("a", "biolink:causes", "b", "decreased", ""), ("a", "biolink:causes", "b", None, None), (None, None, None, None, None)], kgx.EDGE)
    g = Graph.from_records(nodes, edges, golden.ONTOLOGY)
    assert sorted(r["pred"] for r in g.catalog.collect()) == ["causes", "causes--decreased--", "causes--decreased--activity_or_abundance"]


def test_result_files(spark, tmp_path):
    import zstandard

    g = golden.graph(spark)
    raw = paths.raw_overlaps(g, 2)
    results.write_raw(raw, str(tmp_path / "raw"))
    (tmp_path / "raw" / "broken.csv").write_text("predictor_metapath\tpredictor_count\nonly\t2\n")
    back = results.read_raw(spark, str(tmp_path / "raw"))
    assert merge.differences(raw, back).isEmpty()
    grouped = grouping.grouped_predictors(g, 2)
    results.write_grouped(grouped, str(tmp_path / "g"))
    target = "Disease|affects|R|Gene"
    one = results.read_grouped(spark, str(tmp_path / "g"), target)
    assert {r["predicted_metapath"] for r in one.collect()} == {target} and one.count() == 7
    results.write_grouped_tsv_zst(grouped, str(tmp_path / "z"))
    lines = zstandard.open(str(tmp_path / "z" / "Disease_affects_R_Gene.tsv.zst"), "rt").read().splitlines()
    assert len(lines) == 8 and lines[0].startswith("predictor_metapath\torientation\t")
    overlaps = [int(x.split("\t")[3]) for x in lines[1:]]
    assert overlaps == sorted(overlaps, reverse=True) and "\t0.400000\t" in "\n".join(lines)


def test_result_operators(spark):
    counts = spark.createDataFrame([("a", 5, 2), ("a", 7, 1), ("b", 1, 3)], "path string, n long, file int")
    assert {r["path"]: r["n"] for r in merge.first_seen(counts).collect()} == {"a": 7, "b": 1}
    assert [r["path"] for r in merge.inconsistent(counts).collect()] == ["a"]
    assert [r["path"] for r in merge.missing(counts, counts.filter("path = 'a'"), "path").collect()] == ["b"]
    items = spark.range(5000).select(F.col("id").alias("size"))
    sample = merge.stratified_sample(items, "size", 700, least={"tiny": 400, "small": 200})
    got = {r["bucket"]: r["count"] for r in sample.groupBy("bucket").count().collect()}
    assert got == {"tiny": 400 + 100 * 1000 // 5000, "small": 200 + 100 * 4000 // 5000}
    nodes = spark.createDataFrame([(f"n{i}", ["x"] * (1 + i % 3)) for i in range(300)], "id string, category array<string>")
    chosen = merge.sample_nodes(nodes, 30)
    assert {r["k"]: r["count"] for r in chosen.groupBy(F.size("category").alias("k")).count().collect()} == {1: 10, 2: 10, 3: 10}
    averages = merge.bucket_averages(spark.createDataFrame([(10, 1.0), (20, 3.0), (5000, 9.0)], "size long, s double"), "size", "s")
    cost = {r["bucket"]: (r["paths"], r["seconds"]) for r in merge.estimated_seconds(items, "size", averages).collect()}
    assert cost == {"tiny": (1000, 2000.0), "small": (4000, 36000.0)}


def test_plans(spark):
    g = golden.graph(spark)
    plan = paths.plan_paths(g, 3)
    sized = order.product_sizes(plan, g.sizes).collect()
    assert sized and all(r["about"] > 0 for r in sized)
    assert order.start_from_end(plan, g.sizes).count() == plan.paths.count()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_lines(source / "a.json", [{"subject": "TEST:" + s, "predicate": "biolink:" + p, "object": "TEST:" + t, "at": "2024-01-01T00:00:00"} for s, p, t in golden.EDGES] * 2)
    schema = kgx.EDGE.fieldNames()
    stream = spark.readStream.schema(", ".join(f"{c} string" for c in schema) + ", at timestamp").json(str(source))
    g = golden.graph(spark)
    from hopweave.operators.graph import typed_nodes

    nodes = typed_nodes(spark.createDataFrame([("TEST:" + n, [f"biolink:{c}" for c in cats]) for n, cats in golden.NODES], "id string, category array<string>"), golden.ONTOLOGY)
    query = ingest.write_base_edges(ingest.distinct_edges(stream, "at"), nodes, golden.ONTOLOGY, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.processAllAvailable()
    # a later batch: an edge that is stored, and the mirrors of symmetric ones, under new times
    again = [("TEST:" + t, "biolink:" + p, "TEST:" + s) for s, p, t in golden.EDGES if p in ("interacts_with", "associated_with")] + [("TEST:Gene_A", "biolink:regulates", "TEST:Gene_B")]
    write_lines(source / "b.json", [{"subject": s, "predicate": p, "object": t, "at": "2024-01-05T00:00:00"} for s, p, t in again])
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert out.select(g.base.columns).exceptAll(g.base).isEmpty() and out.count() == g.base.count()


def test_ontology_tables_are_whole_or_refused(spark, monkeypatch):
    from hopweave import ontology

    monkeypatch.setattr(ontology, "MOST_NAMES", 6)
    pairs = spark.createDataFrame([("a", "b")], "child string, parent string")
    names = spark.createDataFrame([("p",)] * 20 + [("q",)] * 20, "name string")
    assert ontology.Ontology.from_tables(pairs, pairs, names).symmetric == ("p", "q")
    many = spark.createDataFrame([(f"n{i}",) for i in range(7)], "name string")
    with pytest.raises(ValueError):
        ontology.Ontology.from_tables(pairs, pairs, many)
    for field in ("directions", "aspects"):
        with pytest.raises(ValueError):
            ontology.Ontology.from_tables(pairs, pairs, names, **{field: many.selectExpr("name as child", "name as parent")})
