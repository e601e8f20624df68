"""A graph of 9 nodes and 16 edges with a minimal vocabulary, and the rows expected of it (see FIXTURES.md)."""

from __future__ import annotations

from hopweave.ontology import Ontology

#: The nodes and their categories.
NODES = [
    ("Gene_A", ["Gene", "BiologicalEntity", "NamedThing"]),
    ("Gene_B", ["Gene", "BiologicalEntity", "NamedThing"]),
    ("GeneProtein_Z", ["Gene", "Protein", "BiologicalEntity", "NamedThing"]),
    ("SmallMolecule_X", ["SmallMolecule", "ChemicalEntity", "NamedThing"]),
    ("SmallMolecule_Y", ["SmallMolecule", "ChemicalEntity", "NamedThing"]),
    ("Disease_P", ["Disease", "DiseaseOrPhenotypicFeature", "NamedThing"]),
    ("Disease_Q", ["Disease", "DiseaseOrPhenotypicFeature", "NamedThing"]),
    ("Protein_M", ["Protein", "BiologicalEntity", "NamedThing"]),
    ("Protein_N", ["Protein", "BiologicalEntity", "NamedThing"]),
]
#: The edges (subject, predicate, object).
EDGES = [
    ("Gene_A", "affects", "Disease_P"),
    ("Gene_A", "affects", "Disease_Q"),
    ("Gene_B", "affects", "Disease_P"),
    ("Gene_B", "affects", "Disease_Q"),
    ("Disease_P", "affects", "Gene_B"),
    ("Protein_M", "affects", "Disease_P"),
    ("GeneProtein_Z", "affects", "Disease_Q"),
    ("SmallMolecule_X", "affects_increased_activity", "Gene_A"),
    ("SmallMolecule_Y", "affects", "Gene_B"),
    ("SmallMolecule_X", "treats", "Disease_P"),
    ("SmallMolecule_Y", "treats", "Disease_Q"),
    ("Gene_A", "interacts_with", "Protein_M"),
    ("Gene_B", "interacts_with", "Protein_N"),
    ("GeneProtein_Z", "interacts_with", "Gene_B"),
    ("Gene_A", "regulates", "Gene_B"),
    ("Protein_N", "associated_with", "Disease_Q"),
]

ONTOLOGY = Ontology(
    types=(
        ("SmallMolecule", "MolecularEntity"), ("MolecularEntity", "ChemicalEntity"), ("Drug", "ChemicalEntity"), ("ChemicalEntity", "NamedThing"),
        ("Gene", "BiologicalEntity"), ("Gene", "GeneOrGeneProduct"), ("Protein", "BiologicalEntity"), ("Protein", "GeneOrGeneProduct"),
        ("Disease", "DiseaseOrPhenotypicFeature"), ("DiseaseOrPhenotypicFeature", "BiologicalEntity"), ("BiologicalEntity", "NamedThing"),
        ("GeneOrGeneProduct", "NamedThing"), ("NamedThing", "Entity"),
    ),
    predicates=(
        ("affects", "related_to_at_instance_level"), ("treats", "related_to_at_instance_level"), ("interacts_with", "related_to_at_instance_level"),
        ("associated_with", "related_to_at_instance_level"), ("regulates", "affects"), ("regulates", "interacts_with"), ("ameliorates", "treats"),
        ("directly_physically_interacts_with", "interacts_with"), ("causes", "related_to_at_instance_level"), ("related_to_at_instance_level", "related_to"),
    ),
    symmetric=("related_to", "related_to_at_instance_level", "interacts_with", "associated_with", "directly_physically_interacts_with"),
    directions=(("increased", "increased"), ("decreased", "decreased")),
    aspects=(("activity", "activity"), ("expression", "expression"), ("activity_or_abundance", "activity_or_abundance")),
)

#: Predictor, its count, target, its count, overlap.
TWO_HOP = [
    ("Disease|affects|F|Gene|regulates|R|Gene", 1, "Disease|affects|R|Gene", 4, 1),
    ("Disease|affects|R|Gene+Protein|interacts_with|A|Gene", 1, "Disease|affects|R|Gene", 4, 1),
    ("Disease|affects|R|Protein|interacts_with|A|Gene", 1, "Disease|affects|R|Gene", 4, 1),
    ("Disease|associated_with|A|Protein|interacts_with|A|Gene", 1, "Disease|affects|R|Gene", 4, 1),
    ("Gene+Protein|affects|F|Disease|affects|R|Gene", 2, "Gene+Protein|interacts_with|A|Gene", 1, 1),
    ("Gene+Protein|interacts_with|A|Gene|affects|F|Disease", 2, "Gene+Protein|affects|F|Disease", 1, 1),
    ("Gene|affects--increased--activity|R|SmallMolecule|treats|F|Disease", 1, "Gene|affects|F|Disease", 4, 1),
    ("Gene|affects|F|Disease|affects|R|Gene", 1, "Gene|regulates|F|Gene", 1, 1),
    ("Gene|affects|R|Disease|affects|R|Gene", 1, "Gene|regulates|R|Gene", 1, 1),
    ("Gene|affects|R|SmallMolecule|treats|F|Disease", 1, "Gene|affects|F|Disease", 4, 1),
    ("Gene|regulates|F|Gene|affects|F|Disease", 2, "Gene|affects|F|Disease", 4, 2),
    ("Gene|regulates|R|Gene|affects|F|Disease", 2, "Gene|affects|F|Disease", 4, 2),
    ("Gene|regulates|R|Gene|affects|F|Disease", 2, "Gene|affects|R|Disease", 1, 1),
    ("Protein|affects|F|Disease|affects|R|Gene", 2, "Protein|interacts_with|A|Gene", 2, 1),
    ("Protein|associated_with|A|Disease|affects|R|Gene", 2, "Protein|interacts_with|A|Gene", 2, 1),
    ("Protein|interacts_with|A|Gene|affects|F|Disease", 4, "Protein|affects|F|Disease", 1, 1),
    ("Protein|interacts_with|A|Gene|affects|F|Disease", 4, "Protein|associated_with|A|Disease", 1, 1),
    ("SmallMolecule|affects--increased--activity|F|Gene|affects|F|Disease", 2, "SmallMolecule|treats|F|Disease", 2, 1),
    ("SmallMolecule|affects|F|Gene|affects|F|Disease", 2, "SmallMolecule|treats|F|Disease", 2, 1),
    ("SmallMolecule|treats|F|Disease|affects|R|Gene", 4, "SmallMolecule|affects--increased--activity|F|Gene", 1, 1),
    ("SmallMolecule|treats|F|Disease|affects|R|Gene", 4, "SmallMolecule|affects|F|Gene", 1, 1),
]
#: One-hop paths that predict themselves, with their counts.
ONE_HOP_SELF = [
    ("Disease|affects|F|Gene", 1),
    ("Disease|affects|R|Gene", 4),
    ("Disease|affects|R|Gene+Protein", 1),
    ("Disease|affects|R|Protein", 1),
    ("Disease|associated_with|A|Protein", 1),
    ("Disease|treats|R|SmallMolecule", 2),
    ("Gene|affects--increased--activity|R|SmallMolecule", 1),
    ("Gene|affects|R|SmallMolecule", 1),
    ("Gene|interacts_with|A|Gene+Protein", 1),
    ("Gene|interacts_with|A|Protein", 2),
    ("Gene|regulates|F|Gene", 1),
    ("Gene|regulates|R|Gene", 1),
]
#: One-hop paths that predict others.
ONE_HOP_CROSS = [("Disease|affects|F|Gene", 1, "Disease|affects|R|Gene", 4, 1), ("Disease|affects|R|Gene", 4, "Disease|affects|F|Gene", 1, 1)]

#: Exact counts of rolled-up targets.
ROLLED_UP = {
    "Disease|affects|R|Gene": 5, "Disease|affects|R|Gene+Protein": 1, "Disease|affects|R|Protein": 2, "Disease|treats|R|SmallMolecule": 2,
    "Gene|regulates|F|Gene": 1, "Gene|regulates|R|Gene": 1, "Gene|interacts_with|A|Protein": 3, "BiologicalEntity|affects|F|Disease": 6,
    "ChemicalEntity|treats|F|Disease": 2, "BiologicalEntity|affects|F|BiologicalEntity": 8, "BiologicalEntity|affects|R|BiologicalEntity": 8,
    "NamedThing|related_to|A|NamedThing": 16, "BiologicalEntity|related_to|A|ChemicalEntity": 4,
    "Gene|affects--increased--activity|R|SmallMolecule": 1, "Gene|affects|R|SmallMolecule": 2, "Gene|affects----activity|R|SmallMolecule": 1,
}

#: Target, predictor, orientation, predictor count, overlap, total, precision, recall, mcc
GROUPED = [
    ("ChemicalEntity|treats|F|Disease", "SmallMolecule|affects--increased--activity|F|Gene|affects|F|Disease", "fwd", 2, 1, 4, 0.5, 0.5, 0.0),
    ("ChemicalEntity|treats|F|Disease", "SmallMolecule|affects|F|Gene|affects|F|Disease", "fwd", 2, 1, 4, 0.5, 0.5, 0.0),
    ("Disease|affects|R|Gene", "Disease|affects|F|Gene|regulates|R|Gene", "fwd", 1, 1, 6, 1.0, 0.2, 0.2),
    ("Disease|affects|R|Gene", "Disease|affects|R|Protein|interacts_with|A|Gene", "fwd", 1, 1, 6, 1.0, 0.2, 0.2),
    ("Disease|affects|R|Gene", "Disease|associated_with|A|Protein|interacts_with|A|Gene", "fwd", 1, 1, 6, 1.0, 0.2, 0.2),
    ("Disease|affects|R|Gene", "Gene|affects--increased--activity|R|SmallMolecule|treats|F|Disease", "rev", 1, 1, 6, 1.0, 0.2, 0.2),
    ("Disease|affects|R|Gene", "Gene|affects|R|SmallMolecule|treats|F|Disease", "rev", 1, 1, 6, 1.0, 0.2, 0.2),
    ("Disease|affects|R|Gene", "Gene|regulates|F|Gene|affects|F|Disease", "rev", 2, 2, 6, 1.0, 0.4, 0.316228),
    ("Disease|affects|R|Gene", "Gene|regulates|R|Gene|affects|F|Disease", "rev", 2, 2, 6, 1.0, 0.4, 0.316228),
    ("GeneOrGeneProduct|interacts_with|A|GeneOrGeneProduct", "Gene|affects|F|Disease|affects|R|Gene", "fwd", 4, 2, 25, 0.5, 0.25, 0.168408),
    ("GeneOrGeneProduct|interacts_with|A|GeneOrGeneProduct", "Protein|affects|F|Disease|affects|R|Gene", "fwd", 2, 1, 25, 0.5, 0.125, 0.113787),
    ("GeneOrGeneProduct|interacts_with|A|GeneOrGeneProduct", "Protein|affects|F|Disease|affects|R|Gene", "rev", 2, 1, 25, 0.5, 0.125, 0.113787),
    ("GeneOrGeneProduct|interacts_with|A|GeneOrGeneProduct", "Protein|associated_with|A|Disease|affects|R|Gene", "fwd", 2, 1, 25, 0.5, 0.125, 0.113787),
    ("GeneOrGeneProduct|interacts_with|A|GeneOrGeneProduct", "Protein|associated_with|A|Disease|affects|R|Gene", "rev", 2, 1, 25, 0.5, 0.125, 0.113787),
    ("Gene|regulates|F|Gene", "Gene|affects|F|Disease|affects|R|Gene", "fwd", 4, 1, 9, 0.25, 1.0, 0.395285),
]


def graph(spark):
    from hopweave.operators.graph import Graph

    nodes = spark.createDataFrame([("TEST:" + n, [f"biolink:{c}" for c in cats]) for n, cats in NODES], "id string, category array<string>")
    edges = spark.createDataFrame([("TEST:" + s, "biolink:" + p, "TEST:" + t, None, None) for s, p, t in EDGES], "subject string, predicate string, object string, object_direction_qualifier string, object_aspect_qualifier string")
    return Graph.from_records(nodes, edges, ONTOLOGY)
