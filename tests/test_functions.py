"""Scalar cases: predicates, paths, metrics, hierarchies, variants."""

import golden
import pytest
from pyspark.sql import functions as F

from hopweave.functions import metapath as mp
from hopweave.functions import predicates as P
from hopweave.functions.metrics import metrics
from hopweave.ontology import normalized_predicates
from hopweave.operators import grouping, variants

ONTO = golden.ONTOLOGY


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ((1000, 500, 100, 1_000_000), {"precision": 0.1, "recall": 0.2, "f1": 0.133333}),
        ((0, 0, 0, 0), {"precision": 0.0, "recall": 0.0, "f1": 0.0, "mcc": 0.0, "specificity": 0.0, "npv": 0.0, "plr": float("inf")}),
        ((800, 500, 100, 1000), {"specificity": 0.0, "npv": 0.0, "tn": -200}),
        ((100, 50, 25, 1000), {"tp": 25, "fp": 75, "fn": 25, "tn": 875, "total": 1000}),
        ((100, 100, 100, 1000), {"precision": 1.0, "recall": 1.0, "f1": 1.0, "mcc": 1.0}),
        ((1_345_540_431, 9_145_079, 4_159_177, 10**12), {"precision": 0.003091}),
    ],
)
def test_metrics(spark, args, expected):
    row = spark.createDataFrame([args], "a long, b long, c long, d long").select(*[c.alias(n) for n, c in metrics(*map(F.col, "abcd"), full=True).items()]).first().asDict()
    assert len(row) == 18
    for name, value in expected.items():
        assert round(row[name], 6) == value, name


def test_compound_predicates(spark):
    df = spark.createDataFrame([("causes", "decreased", "activity_or_abundance"), ("causes", "decreased", None), ("treats", "", None), ("affects", None, "activity")], "p string, d string, a string")
    names = [r[0] for r in df.select(P.compound(F.col("p"), F.col("d"), F.col("a"))).collect()]
    assert names == ["causes--decreased--activity_or_abundance", "causes--decreased--", "treats", "affects----activity"]
    parts = column(spark, names, P.parts_of)
    assert [tuple(p) for p in parts] == [("causes", "decreased", "activity_or_abundance"), ("causes", "decreased", None), ("treats", None, None), ("affects", None, "activity")]


def test_normalized_predicates(spark):
    flat = {"affects_increased_expression": "affects--increased--expression", "affects_expression": "affects----expression", "affects_increased": "affects--increased--", "treats": "treats", "interacts_with": "interacts_with", "affects--increased--expression": "affects--increased--expression", "unknown_thing": "unknown_thing", "related_to_increased_activity": "related_to--increased--activity", "affects_increased_unknown": "affects_increased_unknown"}
    got = {r["pred"]: r["normalized"] for r in normalized_predicates(spark.createDataFrame([(x,) for x in flat] * 2, "pred string"), ONTO).collect()}
    assert got == flat


def test_parse_build_and_ids(spark):
    good = ["A|p|F|B", "A|p1|F|B|p2|R|C", "A|a|F|B|b|A|C|c|R|D"]
    assert column(spark, good, lambda x: mp.build(mp.parse(x))) == good
    assert column(spark, ["", "A", "A|p|F", "A|p|F|B|q"], lambda x: mp.parse(x).isNull()) == [True] * 4
    assert column(spark, good, lambda x: mp.path_id(mp.parse(x)))[1] == "A|p1|F|B__B|p2|R|C"
    assert column(spark, good, lambda x: mp.build(mp.from_path_id(mp.path_id(mp.parse(x))))) == good
    assert column(spark, ["A|p q|F|b:B"], mp.file_name) == ["A_p_q_F_b_B"]
    assert column(spark, [1, 999, 1000, 10**8, 10**9], mp.size_bucket, "long") == ["tiny", "tiny", "small", "huge", "huge"]


def test_palindromes_and_orientation(spark):
    cases = {"A|p|A|A": True, "A|p|F|B|p|R|A": True, "A|p|F|A": False, "A|p1|F|B|p2|R|A": False, "A|p|F|B|q|A|B|p|R|A": True, "A|p|F|B|q|F|B|p|R|A": False}
    assert column(spark, list(cases), lambda x: mp.is_palindrome(mp.parse(x))) == list(cases.values())
    canonical = {"Gene|affects|F|Disease": "Disease|affects|R|Gene", "Protein|interacts_with|R|Gene": "Gene|interacts_with|A|Protein", "A|x|F|B": "A|x|F|B"}
    assert column(spark, list(canonical), lambda x: mp.build(ONTO.canonical_path(mp.parse(x)))) == list(canonical.values())
    assert column(spark, ["A|p|R|A", "B|p|R|A"], lambda x: mp.provenance(mp.parse(x))) == ["A|p|F|A", "B|p|R|A"]
    bad = column(spark, ["A|p|F|B", "A|q--up--|F|B", "X|p|F|B"], lambda x: mp.is_excluded(mp.parse(x), ["X"], ["q"]))
    assert bad == [False, True, True]


def test_types(spark):
    lists = [["biolink:SmallMolecule", "biolink:ChemicalEntity", "biolink:NamedThing"], ["Gene", "SmallMolecule"], ["Unknown"], [], None, ["Gene", "Gene"], ["NamedThing", "Other"]]
    assert column(spark, lists, ONTO.assigned_type, "array<string>") == ["SmallMolecule", "Gene+SmallMolecule", "Unknown", None, None, "Gene", "NamedThing+Other"]
    assert column(spark, [["NamedThing", "Gene"], ["zz"]], ONTO.most_specific, "array<string>") == ["Gene", "zz"]
    above = column(spark, ["Gene+SmallMolecule", "Mystery"], ONTO.type_ancestors)
    assert set(above[0]) == {"Gene+SmallMolecule", "Gene", "SmallMolecule", "BiologicalEntity", "GeneOrGeneProduct", "NamedThing", "Entity", "MolecularEntity", "ChemicalEntity"}
    assert above[1] == ["Mystery"]
    for name in ("Gene+SmallMolecule", "Mystery", "Disease"):
        assert set(column(spark, [name], ONTO.type_variants)[0]) == set(ONTO.types_above(name))
    for name in ("regulates", "affects--increased--activity", "affects----activity", "nothing", "nothing--up--"):
        assert set(column(spark, [name], ONTO.predicate_variants)[0]) == set(ONTO.predicates_above(name))
    assert ONTO.predicates_above("affects--increased--activity")[:4] == ["affects--increased--activity", "affects--increased--", "affects----activity", "affects"]
    assert ONTO.type_parents("Gene+SmallMolecule") == {"BiologicalEntity", "GeneOrGeneProduct", "MolecularEntity"}
    assert ONTO.predicate_parents("regulates") == {"affects", "interacts_with"}


def texts(df, name):
    return {r[0] for r in df.select(mp.build(F.col(name))).collect()}


def paths_of(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "text string").select(mp.parse(F.col("text")).alias("path"))


def test_type_pair_variants(spark):
    p = paths_of(spark, "SmallMolecule|treats|F|Drug")
    got = texts(variants.typepair_variants(p, ONTO, 1, "NamedThing", "ChemicalEntity"), "variant")
    assert {"ChemicalEntity|treats|F|NamedThing", "ChemicalEntity|treats|R|NamedThing"} <= got
    assert all({x.split("|")[0], x.split("|")[3]} == {"NamedThing", "ChemicalEntity"} for x in got)
    keys = variants.rollup_keys(p, ONTO, "NamedThing", "ChemicalEntity").collect()
    assert len(keys) == 2 and all(k["ends_distinct"] for k in keys)
    assert texts(variants.promoted_starts(p, ONTO, "NamedThing", "ChemicalEntity"), "start") == {"ChemicalEntity|treats|F|NamedThing", "ChemicalEntity|treats|R|NamedThing"}


@pytest.mark.parametrize("text", ["SmallMolecule|affects|F|Gene|regulates|R|Disease", "Gene|regulates|F|Gene", "Gene|interacts_with|A|Protein|affects|F|Disease"])
def test_raised_ends_expand_to_the_same(spark, text):
    hops = (text.count("|")) // 3
    p = paths_of(spark, text)
    for pair in (("ChemicalEntity", "BiologicalEntity"), ("BiologicalEntity", "BiologicalEntity")):
        explicit = variants.typepair_variants(p, ONTO, hops, *pair).select(ONTO.canonical_path(F.col("variant")).alias("variant"))
        assert texts(variants.rollup_variants(p, ONTO, hops, *pair), "variant") == texts(explicit, "variant")


def test_pruning_takes_what_is_implied(spark):
    p = paths_of(spark, "Gene|regulates|F|Disease")
    everything = texts(variants.path_variants(p, ONTO, 1), "variant")
    pruned = texts(variants.pruned_variants(p, ONTO, 1, prune=mp.first_node(F.col("variant")) == "BiologicalEntity"), "variant")
    assert pruned < everything
    assert "Disease|regulates|R|Gene" in pruned and not any(x.startswith("BiologicalEntity|") for x in pruned)
    kids = texts(variants.children(p, ONTO), "child")
    assert kids == {"Disease|affects|R|Gene"} or len(kids) == 1
    assert texts(variants.variant_ancestors(p, ONTO, 1), "variant") >= everything


def test_sums_by_evidence(spark):
    g = golden.graph(spark)
    raw = spark.createDataFrame([("Gene|affects|F|Disease", 100, "Gene|affects|F|Disease", 50, 25, 1000), ("Protein|affects|F|Disease", 80, "Protein|affects|F|Disease", 40, 20, 800)], "predictor_metapath string, predictor_count long, predicted_metapath string, predicted_count long, overlap long, total_possible long")
    got = {(r["predictor_metapath"], r["predicted_metapath"]): (r["predictor_count"], r["predicted_count"], r["overlap"], r["total_possible"]) for r in grouping.summed_variants(raw, g, 1).collect()}
    top = "BiologicalEntity|affects|F|Disease"
    assert got[top, top] == (180, 90, 45, 1800)
