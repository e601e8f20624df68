"""The engine's queries on the driver's tables, one for each operator, and the SQL each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import metapath as mp
from .functions import predicates as P
from .functions.metrics import metrics
from .ontology import normalized_paths, normalized_predicates
from .operators import grouping, merge, paths, targets, variants
from .operators.graph import Graph, hierarchical_node_counts
from .sources import kgx, results
from .sources.tables import ONTOLOGY, PREDICATES, base_edges, categories, graph
from .storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

SUPPLY = ("ordered", "supplied_by", "bought_from")
PLACES = ("located_in", "in_region", "neighbor_of")
TWO_HOP = ("supplied_by", "located_in", "neighbor_of", "in_region")
FLAGSHIP = "Customer|ordered|F|Part|supplied_by|F|Supplier"
SIX = O.SIX


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a customer's ordering of parts that a supplier supplies predict buying from that supplier?"""
    g = graph(spark, sf_dir, SUPPLY, fine=False)
    raw = paths.raw_overlaps(g, 2, plan=paths.plan_paths(g, 2, [FLAGSHIP], dedupe=False))
    scored = raw.withColumns(metrics(F.col("predictor_count"), F.col("predicted_count"), F.col("overlap"), F.col("total_possible")))
    return _round(scored, *SIX)


def _flagship_sql() -> str:
    where = f"c1.txt || '|' || c2.pred || '|' || c2.dir || '|' || c2.ttype = '{FLAGSHIP}'"
    cte = O.overlaps(SUPPLY, 2, False, where).replace(O.should(2) + " AND", "")
    return f"""{cte}, x AS (SELECT *, predictor_count::DOUBLE AS n, predicted_count::DOUBLE AS m, overlap::DOUBLE AS o, total_possible::DOUBLE AS total FROM raw),
y AS (SELECT predictor_metapath, predictor_count, predicted_metapath, predicted_count, overlap, total_possible, {O.METRICS} FROM x)
SELECT predictor_metapath, predictor_count, predicted_metapath, predicted_count, overlap, total_possible, {O.rounded(*SIX)} FROM y"""


def node_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = categories(spark, sf_dir)
    return lists.select("id", ONTOLOGY.assigned_type(F.col("category")).alias("ntype"), F.size(ONTOLOGY.leaf_types(F.col("category"))).cast("long").alias("leaves"), ONTOLOGY.most_specific(F.col("category")).alias("most_specific"))


_DEPTH = {n: len(v) for n, v in ONTOLOGY.type_closure.items()}


def _node_typing_sql() -> str:
    n = O.node
    cust, part = "'Customer_' || c_mktsegment", "'Part_' || p_type"
    return f"""SELECT {n('customer', 'c_custkey')} AS id, {cust} AS ntype, 1::BIGINT AS leaves, {cust} AS most_specific FROM customer
UNION ALL SELECT {n('part', 'p_partkey')}, CASE WHEN p_size > {O.LARGE_SIZE} THEN 'LargeItem+' ELSE '' END || {part}, CASE WHEN p_size > {O.LARGE_SIZE} THEN 2 ELSE 1 END, {part} FROM part
UNION ALL SELECT {n('supplier', 's_suppkey')}, 'Supplier', 1, 'Supplier' FROM supplier
UNION ALL SELECT {n('nation', 'n_nationkey')}, 'Nation', 1, 'Nation' FROM nation
UNION ALL SELECT {n('region', 'r_regionkey')}, 'Region', 1, 'Region' FROM region"""


def hop_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).catalog


def directed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).directed.select("stype", "pred", "dir", "ttype", "nvals")


def type_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return hierarchical_node_counts(g.sizes, g.ontology)


def _raw(predicates: tuple[str, ...], n: int, fine: bool = True) -> Query:
    return lambda spark, sf_dir: paths.raw_overlaps(graph(spark, sf_dir, predicates, fine), n)


def _raw_sql(predicates: tuple[str, ...], n: int, fine: bool = True) -> str:
    return O.overlaps(predicates, n, fine) + " SELECT * FROM raw"


def dup_direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-hop paths to compute, of each path and its reverse one: the catalog alone is read."""
    plan = paths.plan_paths(graph(spark, sf_dir, PLACES), 2)
    return plan.paths.select(mp.build(F.col("path")).alias("path"), mp.is_palindrome(F.col("path")).alias("palindrome"))


def _text_paths(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    plan = paths.plan_paths(graph(spark, sf_dir, PLACES), n, dedupe=False)
    return plan.paths.select(mp.build(F.col("path")).alias("text"))


def metapath_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _text_paths(spark, sf_dir).withColumn("p", mp.parse(F.col("text")))
    p = F.col("p")
    hop = mp.last_hop(p)
    return t.select(
        "text", mp.first_node(p).alias("first_type"), mp.last_node(p).alias("last_type"), F.size(p["preds"]).cast("long").alias("hops"),
        mp.build(mp.prefix(p, F.lit(1))).alias("prefix"), F.concat_ws("|", hop["stype"], hop["pred"], hop["dir"], hop["ttype"]).alias("last_hop"),
        mp.path_id(p).alias("path_id"), (mp.build(mp.from_path_id(mp.path_id(p))) == F.col("text")).alias("round_trip"), mp.file_name(F.col("text")).alias("file_name"),
    )


def metapath_reverse_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _text_paths(spark, sf_dir).withColumn("p", mp.parse(F.col("text")))
    p = F.col("p")
    return t.select("text", mp.build(mp.reverse(p)).alias("reversed"), mp.build(mp.canonical(p)).alias("canonical"), mp.is_palindrome(p).alias("palindrome"), mp.provenance(p).alias("provenance"))


_REV = "e || '|' || q || '|' || fe || '|' || b || '|' || p || '|' || fd || '|' || a"
_PARTS = """parts AS (SELECT path AS text, string_split(path, '|') AS x FROM plan),
s AS (SELECT text, x[1] AS a, x[2] AS p, x[3] AS d, x[4] AS b, x[5] AS q, x[6] AS f, x[7] AS e, CASE x[3] WHEN 'F' THEN 'R' WHEN 'R' THEN 'F' ELSE 'A' END AS fd, CASE x[6] WHEN 'F' THEN 'R' WHEN 'R' THEN 'F' ELSE 'A' END AS fe FROM parts)"""


def _all_paths_sql() -> str:
    return f"WITH {O.base(PLACES)}, {O.paths(2)}, {_PARTS}".replace(O.should(2) + " AND", "")


def predicate_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "low").alias("aspect")).distinct()
    out = F.lit(None).cast("string")
    made = events.select(F.explode(F.array(P.compound(F.lit("performed"), F.col("event_type"), F.col("aspect")), P.compound(F.lit("performed"), out, F.col("aspect")))).alias("pred")).distinct()
    part = P.parts_of(F.col("pred"))
    return made.select("pred", P.is_compound(F.col("pred")).alias("is_compound"), part["base"].alias("base"), part["direction"].alias("direction"), part["aspect"].alias("aspect"))


def predicate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat names such as performed_click_high, made of the events, and names that must stay."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    flat = events.select(F.explode(F.array(F.concat(F.lit("performed_"), "event_type"), F.concat(F.lit("performed_"), "event_type", F.lit("_high")), F.concat(F.lit("located_in_"), "event_type", F.lit("_other")), F.lit("performed_low"), F.lit("located_in"), F.lit("performed--view--"))).alias("pred"))
    return normalized_predicates(flat, ONTOLOGY)


_NORMALIZE_SQL = """WITH e AS (SELECT DISTINCT event_type AS t FROM events)
SELECT 'performed_' || t AS pred, 'performed--' || t || '--' AS normalized FROM e
UNION ALL SELECT 'performed_' || t || '_high', 'performed--' || t || '--high' FROM e
UNION ALL SELECT 'located_in_' || t || '_other', 'located_in_' || t || '_other' FROM e
UNION ALL SELECT * FROM (VALUES ('performed_low', 'performed----low'), ('located_in', 'located_in'), ('performed--view--', 'performed--view--')) WHERE EXISTS (SELECT 1 FROM e)"""


def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that occur in the tables, with their ancestors."""
    used = categories(spark, sf_dir).select(F.explode("category").alias("type")).distinct()
    return used.join(F.broadcast(ONTOLOGY.type_table(spark)), "type").select("type", "ancestor")


def _closure_sql(kind: str, pairs, start: str) -> str:
    rows = O._values(sorted(pairs))
    return f"""WITH RECURSIVE isa(child, parent) AS {rows}, used AS ({start}),
up(name, ancestor) AS (SELECT name, name FROM used UNION SELECT up.name, isa.parent FROM up JOIN isa ON isa.child = up.ancestor)
SELECT name AS {kind}, ancestor FROM up"""


def predicate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = base_edges(spark, sf_dir).select("pred").distinct()
    return preds.select("pred", F.explode(ONTOLOGY.predicate_variants(F.col("pred"))).alias("variant"))


def _predicate_variants_sql() -> str:
    isa = O._values(sorted(ONTOLOGY.predicates))
    quals = O._values(sorted(ONTOLOGY.directions))
    return f"""WITH RECURSIVE {O.base(PREDICATES)}, isa(child, parent) AS {isa}, q(child, parent) AS {quals}, used AS (SELECT DISTINCT pred, string_split(pred, '--')[1] AS b, string_split(pred, '--')[2] AS d FROM base),
up(name, a) AS (SELECT DISTINCT b, b FROM used UNION SELECT up.name, isa.parent FROM up JOIN isa ON isa.child = up.a),
qu(name, a) AS (SELECT DISTINCT d, d FROM used WHERE d IS NOT NULL UNION SELECT qu.name, q.parent FROM qu JOIN q ON q.child = qu.a)
SELECT DISTINCT pred, up.a || CASE WHEN v.a IS NULL THEN '' ELSE '--' || v.a || '--' END AS variant FROM used JOIN up ON up.name = b JOIN (SELECT name, a FROM qu UNION ALL SELECT DISTINCT d, NULL FROM used) v ON v.name IS NOT DISTINCT FROM d"""


def _one_hop_paths(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] = PREDICATES) -> DataFrame:
    m = graph(spark, sf_dir, predicates).directed
    p = mp.path(F.array("stype", "ttype"), F.array("pred"), F.array("dir"))
    return m.select(mp.build(p).alias("text"), p.alias("path"))


def metapath_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.path_variants(_one_hop_paths(spark, sf_dir), ONTOLOGY, 1)
    return found.select("text", mp.build(F.col("variant")).alias("variant"))


def _variants_sql(select: str, where: str = "TRUE") -> str:
    return f"WITH {O.vocabulary(PREDICATES)}, {O.base(PREDICATES)}, {O.one_hop_variants('cat')} SELECT DISTINCT {select} FROM var WHERE {where}"


def typepair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.typepair_variants(_one_hop_paths(spark, sf_dir), ONTOLOGY, 1, "Party", "Product")
    return found.select("text", mp.build(F.col("variant")).alias("variant"))


def rollup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of raised ends; the results must agree."""
    found = variants.rollup_variants(_one_hop_paths(spark, sf_dir).select("path"), ONTOLOGY, 1, "Party", "Product")
    return found.select(mp.build(F.col("variant")).alias("variant")).distinct()


def typepair_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.endpoint_type_pairs(_one_hop_paths(spark, sf_dir), ONTOLOGY)
    return found.groupBy("type1", "type2").agg(F.count(F.lit(1)).alias("paths"))


def target_variant_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    p = mp.path(F.array("stype", "ttype"), F.array("pred"), F.array("dir"))
    return targets.target_variant_sums(g.directed.select(mp.build(p).alias("path"), F.col("nvals").alias("n")), g.ontology)


def _variant_sum_sql() -> str:
    return f"""WITH {O.vocabulary(PREDICATES)}, {O.base(PREDICATES)}, {O.one_hop_variants('cat')},
ev AS (SELECT var.variant, cat.txt, cat.nv, CASE WHEN stype = ttype AND dir = 'R' THEN stype || '|' || pred || '|F|' || ttype ELSE cat.txt END AS evidence FROM var JOIN cat USING (txt)),
once AS (SELECT variant, evidence, arg_max(nv, txt) AS n FROM ev GROUP BY ALL)
SELECT variant, sum(n)::BIGINT AS n FROM once GROUP BY 1"""


def target_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of every rolled-up target, beside the sum over its evidence."""
    g = graph(spark, sf_dir)
    plan = paths.plan_paths(g, 1, dedupe=False)
    wanted = variants.path_variants(_one_hop_paths(spark, sf_dir), ONTOLOGY, 1).select(mp.build(F.col("variant")).alias("target")).distinct()
    return targets.exact_target_counts(wanted, g, plan.matrices, paths.direct_sets(g, plan))


def _exact_sql() -> str:
    return f"""WITH {O.vocabulary(PREDICATES)}, {O.base(PREDICATES)}, {O.one_hop_variants('cat')}, g AS (SELECT DISTINCT variant, v1, vp, vd, v2 FROM var),
mem AS (SELECT DISTINCT g.variant, cat.stype, cat.pred, cat.dir, cat.ttype FROM g JOIN pv ON pv.variant = g.vp JOIN cat ON cat.pred = pv.name
  JOIN tv a ON a.name = cat.stype AND a.variant = g.v1 JOIN tv b ON b.name = cat.ttype AND b.variant = g.v2 WHERE g.vd = 'A' OR cat.dir = 'A' OR cat.dir = g.vd)
SELECT variant AS target, count(DISTINCT (s, t)) AS n FROM mem JOIN hop USING (stype, pred, dir, ttype) GROUP BY 1"""


def _grouped(predicates: tuple[str, ...], fine: bool, min_count: int, min_precision: float, types: tuple[str, ...] = (), preds: tuple[str, ...] = ()) -> Query:
    return lambda spark, sf_dir: _round(grouping.grouped_predictors(graph(spark, sf_dir, predicates, fine), 2, min_count, min_precision, types, preds), *SIX)


def metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eighteen measures of every one-hop path against every other."""
    raw = paths.raw_overlaps(graph(spark, sf_dir, ("ordered", "returned", "located_in", "neighbor_of")), 1)
    all_ = metrics(F.col("predictor_count"), F.col("predicted_count"), F.col("overlap"), F.col("total_possible"), full=True)
    out = raw.select("predictor_metapath", "predicted_metapath", *[c.alias(n) for n, c in all_.items()])
    return _round(out, *SIX, "accuracy", "balanced_accuracy", "tpr", "fpr", "fnr", "plr", "nlr")


def _metrics_full_sql() -> str:
    return f"""{O.overlaps(("ordered", "returned", "located_in", "neighbor_of"), 1)},
x AS (SELECT *, predictor_count::DOUBLE AS n, predicted_count::DOUBLE AS m, overlap::DOUBLE AS o, total_possible::DOUBLE AS total FROM raw),
y AS (SELECT *, {O.METRICS} FROM x),
z AS (SELECT *, (total - n - m + o) AS tnn, CASE WHEN total - m > 0 THEN (n - o) / (total - m) ELSE 0 END AS fpr, CASE WHEN m > 0 THEN (m - o) / m ELSE 0 END AS fnr FROM y)
SELECT predictor_metapath, predicted_metapath, overlap AS tp, (n - o)::BIGINT AS fp, (m - o)::BIGINT AS fn, tnn::BIGINT AS tn, total_possible AS total, {O.rounded(*SIX)},
  round(CASE WHEN total > 0 THEN (o + tnn) / total ELSE 0 END, 6) AS accuracy, round((recall + specificity) / 2, 6) AS balanced_accuracy, round(recall, 6) AS tpr, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr,
  round(CASE WHEN fpr > 0 THEN recall / fpr ELSE 'inf'::DOUBLE END, 6) AS plr, round(CASE WHEN specificity > 0 THEN fnr / specificity ELSE 'inf'::DOUBLE END, 6) AS nlr FROM z"""


def top_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the ten largest predictors."""
    return merge.top_predictors(paths.raw_overlaps(graph(spark, sf_dir, TWO_HOP), 2), 10)


def _rows_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as several files would hold them: one for each return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.count(F.lit(1))
    return lines.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(n.alias("predictor_count"), F.countDistinct("l_suppkey").alias("predicted_count"), F.countDistinct("l_partkey").alias("overlap"), (n * 10).alias("total_possible")).select(
        F.concat(F.lit("P|"), "l_returnflag").alias("predictor_metapath"), F.concat(F.lit("T|"), "l_linestatus").alias("predicted_metapath"), "predictor_count", "predicted_count", "overlap", "total_possible", F.col("l_linenumber").alias("file")
    )


_FILES_SQL = "r AS (SELECT 'P|' || l_returnflag AS predictor_metapath, 'T|' || l_linestatus AS predicted_metapath, count(*) AS predictor_count, count(DISTINCT l_suppkey) AS predicted_count, count(DISTINCT l_partkey) AS overlap, count(*) * 10 AS total_possible, l_linenumber AS file FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)"


def merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(_rows_per_line(spark, sf_dir))


def first_seen_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows_per_line(spark, sf_dir).groupBy(F.col("predictor_metapath").alias("path"), "file").agg(F.max("predictor_count").alias("n"))
    return merge.first_seen(rows)


def set_diff_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which two results differ: pairs ordered against pairs returned."""
    left = base_edges(spark, sf_dir, ("ordered",), False).select("s", "t")
    right = base_edges(spark, sf_dir, ("returned",), False).select("s", "t")
    return merge.differences(left, right).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).catalog.groupBy(mp.size_bucket(F.col("nvals")).alias("bucket")).agg(F.count(F.lit(1)).alias("matrices"), F.sum("nvals").alias("pairs"))


def explicit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.explicit_counts(paths.raw_overlaps(graph(spark, sf_dir, PLACES), 2))


def summed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, ("in_region", "neighbor_of"))
    return grouping.summed_variants(paths.raw_overlaps(g, 1), g, 1)


def _summed_sql() -> str:
    two = ("in_region", "neighbor_of")
    return f"""WITH {O.vocabulary(two)}, {O.base(two)}, {O.paths(1)}, {O.RAW}, {O.one_hop_variants('cat')},
l AS (SELECT variant, sum(predictor_count) AS n FROM (SELECT DISTINCT predictor_metapath, predictor_count FROM raw) JOIN var ON txt = predictor_metapath GROUP BY 1),
r AS (SELECT variant, sum(predicted_count) AS n FROM (SELECT DISTINCT predicted_metapath, predicted_count FROM raw) JOIN var ON txt = predicted_metapath GROUP BY 1),
p AS (SELECT a.variant AS x, b.variant AS y, sum(overlap) AS o, sum(total_possible) AS t FROM raw JOIN var a ON a.txt = predictor_metapath JOIN var b ON b.txt = predicted_metapath GROUP BY ALL)
SELECT x AS predictor_metapath, l.n::BIGINT AS predictor_count, y AS predicted_metapath, r.n::BIGINT AS predicted_count, o::BIGINT AS overlap, t::BIGINT AS total_possible FROM p JOIN l ON l.variant = x JOIN r ON r.variant = y"""


def category_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.category_frequencies(categories(spark, sf_dir))


def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prices stand for times: mean and percentiles by size bucket of the key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = merge.bucket_averages(orders, "o_orderkey", "o_totalprice")
    return out.select("bucket", "n", F.round("mean", 4).alias("mean"), *[F.round(F.get("percentiles", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95, 99))])


_BUCKET_SQL = "CASE " + " ".join(f"WHEN {{0}} < {n} THEN '{b}'" for b, n in mp.SIZE_BUCKETS) + " ELSE 'huge' END"


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    items = _text_paths(spark, sf_dir).select("text", F.length("text").alias("size"))
    return merge.stratified_sample(items, "size", 100)


def sampled_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: nodes evenly over category counts, and edges between them."""
    nodes = merge.sample_nodes(categories(spark, sf_dir).withColumn("id", F.col("id").cast("string")), 500)
    edges = base_edges(spark, sf_dir, ("ordered", "supplied_by"), False).select(F.col("s").cast("string").alias("subject"), F.col("pred").alias("predicate"), F.col("t").cast("string").alias("object"))
    return merge.sample_edges(edges, nodes, 1000)


def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected rows of every two-hop product, by size; the catalog alone is read."""
    from .plans.order import product_sizes

    g = graph(spark, sf_dir, PLACES)
    sized = product_sizes(paths.plan_paths(g, 2), g.sizes)
    return sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("products"), F.round(F.sum("about"), 3).alias("rows"))


def _plan_costs_sql() -> str:
    about = "c1.nv::DOUBLE * c2.nv / sz.n"
    return f"""WITH {O.base(PLACES)}, x AS (SELECT {about} AS about FROM cat c1 JOIN cat c2 ON c1.ttype = c2.stype JOIN sz ON sz.ntype = c2.stype WHERE {O.should(2)})
SELECT {_BUCKET_SQL.format("about")} AS bucket, count(*) AS products, round(sum(about), 3) AS rows FROM x GROUP BY 1"""


#: The predicates whose ends have node records (users and event types have none, so their edges are dropped).
RECORDED = tuple(p for p in PREDICATES if p != "performed")


def _records(spark: SparkSession, sf_dir: str) -> str:
    """The tables as node and edge records in JSON lines, in the shared folder: every edge of the graph, symmetric ones
    in one direction, edges with an unknown end, and subclass edges, which ingest must drop."""
    where = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    kgx.write_records(categories(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.transform("category", lambda c: F.concat(F.lit("biolink:"), c)).alias("category")), f"{where}/nodes")
    edges = base_edges(spark, sf_dir)
    part = P.parts_of(F.col("pred"))
    none = F.lit(None).cast("string")
    flat = edges.filter((F.col("pred") != "neighbor_of") | (F.col("s") < F.col("t"))).select(F.col("s").cast("string").alias("subject"), F.concat(F.lit("biolink:"), part["base"]).alias("predicate"), F.col("t").cast("string").alias("object"), part["direction"].alias("object_direction_qualifier"), part["aspect"].alias("object_aspect_qualifier"))
    below = edges.filter("pred = 'in_region'").select(F.col("s").cast("string").alias("subject"), F.lit("biolink:subclass_of").alias("predicate"), F.col("t").cast("string").alias("object"), none.alias("object_direction_qualifier"), none.alias("object_aspect_qualifier"))
    kgx.write_records(flat.unionByName(below), f"{where}/edges")
    return where


def _ingested(spark: SparkSession, sf_dir: str) -> Graph:
    where = _records(spark, sf_dir)
    return kgx.read_graph(spark, f"{where}/nodes", f"{where}/edges", ONTOLOGY)


def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed base edges from records: subclass edges and untyped ends dropped, prefixes stripped, symmetric mirrored."""
    return _ingested(spark, sf_dir).base.withColumns({"s": F.col("s").cast("long"), "t": F.col("t").cast("long")})


def ingest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog and node counts of matrices that were written, and read back."""
    path = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    kgx.write_matrices(_ingested(spark, sf_dir), path)
    return kgx.read_catalog(spark, path).select("stype", "pred", "ttype", "nrows", "ncols", "nvals")


def matrices_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop overlaps from stored matrices, only those of some predicates opened (a pruned scan, whole matrices)."""
    path = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    kgx.write_matrices(graph(spark, sf_dir), path)
    return paths.raw_overlaps(kgx.read_matrices(spark, path, ONTOLOGY, list(TWO_HOP)), 1)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw overlap rows written as files and read back."""
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    results.write_raw(paths.raw_overlaps(graph(spark, sf_dir, PLACES), 2), path)
    return results.read_raw(spark, path)


def grouped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows written in a folder for each target and read back."""
    path = f"{shared_dir(spark)}/grouped-{uuid.uuid4().hex}"
    results.write_grouped(grouping.grouped_predictors(graph(spark, sf_dir, PLACES), 2), path)
    return _round(results.read_grouped(spark, path), *SIX)


def metapath_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat predicate names in all hops of a path."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    text = F.concat(F.lit("User|performed_"), "event_type", F.lit("_high|F|EventType|performed_"), "event_type", F.lit("|R|User|located_in|F|Nation"))
    made = e.select(mp.parse(text).alias("path"))
    return normalized_paths(made, ONTOLOGY).select(mp.build(F.col("path")).alias("path"), mp.build(F.col("normalized")).alias("normalized"))


def queries() -> dict[str, Query]:
    return {
        "flagship": flagship,
        "node_typing": node_typing,
        "hop_table_counts": hop_table_counts,
        "directed_catalog": directed_catalog,
        "type_node_counts": type_node_counts,
        "onehop_overlap": _raw(PREDICATES, 1),
        "twohop_overlap": _raw(TWO_HOP, 2),
        "twohop_palindrome_dedup": _raw(("in_region", "neighbor_of"), 2),
        "threehop_overlap": _raw(PLACES, 3, False),
        "dup_direction_filter": dup_direction_filter,
        "metapath_parse": metapath_parse,
        "metapath_reverse_canonical": metapath_reverse_canonical,
        "predicate_compound": predicate_compound,
        "predicate_normalize": predicate_normalize,
        "type_closure": type_closure,
        "predicate_variants": predicate_variants,
        "metapath_variants": metapath_variants,
        "typepair_variants": typepair_variants,
        "rollup_variants": rollup_variants,
        "typepair_fanout": typepair_fanout,
        "target_variant_sum": target_variant_sum,
        "target_exact_pairs": target_exact_pairs,
        "grouped_metrics": _grouped(PLACES, True, 0, 0.0),
        "exclude_filters": _grouped(TWO_HOP, True, grouping.MIN_COUNT, grouping.MIN_PRECISION, ("NamedThing", "Party"), ("related_to", "associated_with")),
        "metrics_full": metrics_full,
        "top_predictors": top_predictors,
        "merge_sum": merge_sum,
        "first_seen_min_by": first_seen_min_by,
        "set_diff_compare": set_diff_compare,
        "size_buckets": size_buckets,
        "explicit_counts": explicit_counts,
        "summed_variants": summed_variants,
        "category_frequencies": category_frequencies,
        "timing_percentiles": timing_percentiles,
        "plan_costs": plan_costs,
        "stratified_sample": stratified_sample,
        "sampled_subgraph": sampled_subgraph,
        "ingest_edges": ingest_edges,
        "ingest_catalog": ingest_catalog,
        "matrices_overlap": matrices_overlap,
        "raw_files": raw_files,
        "grouped_files": grouped_files,
        "metapath_normalize": metapath_normalize,
        "whole_twohop_overlap": _raw(PREDICATES, 2),
        "whole_twohop_grouped": _grouped(PREDICATES, True, 0, 0.0),
    }


def oracle_sql() -> dict[str, str]:
    cat_sql = f"WITH {O.base(PREDICATES)}"
    used_types = "SELECT DISTINCT name FROM (SELECT unnest(['Customer_' || c_mktsegment, 'Customer', 'Party', 'NamedThing']) AS name FROM customer UNION ALL SELECT unnest(['Product', 'Part', 'Part_' || p_type]) FROM part UNION ALL SELECT 'LargeItem' FROM part WHERE p_size > 40 UNION ALL SELECT unnest(['NamedThing', 'Supplier', 'Party']) FROM supplier UNION ALL SELECT unnest(['Nation', 'Place']) FROM nation UNION ALL SELECT 'Region' FROM region)"
    return {
        "flagship": _flagship_sql(),
        "node_typing": _node_typing_sql(),
        "hop_table_counts": f"{cat_sql} SELECT stype, pred, ttype, a.n AS nrows, b.n AS ncols, count(*) AS nvals FROM base JOIN sz a ON a.ntype = stype JOIN sz b ON b.ntype = ttype GROUP BY ALL",
        "directed_catalog": f"{cat_sql} SELECT stype, pred, dir, ttype, nv AS nvals FROM cat",
        "type_node_counts": f"WITH {O.vocabulary(PREDICATES)}, {O.base(PREDICATES)} SELECT tv.variant AS ntype, sum(n)::BIGINT AS n FROM sz JOIN tv ON tv.name = sz.ntype GROUP BY 1",
        "onehop_overlap": _raw_sql(PREDICATES, 1),
        "twohop_overlap": _raw_sql(TWO_HOP, 2),
        "twohop_palindrome_dedup": _raw_sql(("in_region", "neighbor_of"), 2),
        "threehop_overlap": _raw_sql(PLACES, 3, False),
        "dup_direction_filter": f"WITH {O.base(PLACES)}, {O.paths(2)} SELECT path, palin AS palindrome FROM plan",
        "metapath_parse": f"{_all_paths_sql()} SELECT text, a AS first_type, e AS last_type, 2::BIGINT AS hops, a || '|' || p || '|' || d || '|' || b AS prefix, b || '|' || q || '|' || f || '|' || e AS last_hop, a || '|' || p || '|' || d || '|' || b || '__' || b || '|' || q || '|' || f || '|' || e AS path_id, TRUE AS round_trip, translate(text, '|: ', '___') AS file_name FROM s",
        "metapath_reverse_canonical": f"{_all_paths_sql()} SELECT text, {_REV} AS reversed, CASE WHEN a <= e THEN text ELSE {_REV} END AS canonical, {_REV} = text AS palindrome, CASE WHEN a = e THEN least(text, {_REV}) ELSE text END AS provenance FROM s",
        "predicate_compound": "WITH e AS (SELECT DISTINCT event_type AS d, CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'low' END AS a FROM events), x AS (SELECT d, a FROM e UNION SELECT NULL, a FROM e) SELECT CASE WHEN d IS NULL AND a IS NULL THEN 'performed' ELSE 'performed--' || coalesce(d, '') || '--' || coalesce(a, '') END AS pred, NOT (d IS NULL AND a IS NULL) AS is_compound, 'performed' AS base, d AS direction, a AS aspect FROM x",
        "predicate_normalize": _NORMALIZE_SQL,
        "type_closure": _closure_sql("type", ONTOLOGY.types, used_types),
        "predicate_variants": _predicate_variants_sql(),
        "metapath_variants": _variants_sql("txt AS text, variant"),
        "typepair_variants": _variants_sql("txt AS text, variant", "v1 = 'Party' AND v2 = 'Product'"),
        "rollup_variants": _variants_sql("variant", "v1 = 'Party' AND v2 = 'Product'"),
        "typepair_fanout": f"WITH {O.vocabulary(PREDICATES)}, {O.base(PREDICATES)}, x AS (SELECT DISTINCT txt, least(a.variant, b.variant) AS type1, greatest(a.variant, b.variant) AS type2 FROM cat JOIN tv a ON a.name = stype JOIN tv b ON b.name = ttype) SELECT type1, type2, count(*) AS paths FROM x GROUP BY ALL",
        "target_variant_sum": _variant_sum_sql(),
        "target_exact_pairs": _exact_sql(),
        "grouped_metrics": O.grouped(PLACES, 2, True, 0, 0.0, (), ()),
        "exclude_filters": O.grouped(TWO_HOP, 2, True, grouping.MIN_COUNT, grouping.MIN_PRECISION, ("NamedThing", "Party"), ("related_to", "associated_with")),
        "metrics_full": _metrics_full_sql(),
        "top_predictors": f"{O.overlaps(TWO_HOP, 2)} SELECT DISTINCT predictor_metapath, predictor_count FROM raw ORDER BY 2 DESC, 1 LIMIT 10",
        "merge_sum": f"WITH {_FILES_SQL} SELECT predictor_metapath, predicted_metapath, sum(predictor_count)::BIGINT AS predictor_count, sum(predicted_count)::BIGINT AS predicted_count, sum(overlap)::BIGINT AS overlap, sum(total_possible)::BIGINT AS total_possible FROM r GROUP BY ALL",
        "first_seen_min_by": f"WITH {_FILES_SQL}, p AS (SELECT predictor_metapath AS path, file, max(predictor_count) AS n FROM r GROUP BY ALL) SELECT path, arg_min(n, file) AS n FROM p GROUP BY 1",
        "set_diff_compare": f"WITH {O.base(('ordered', 'returned'), False)}, l AS (SELECT s, t FROM base WHERE pred = 'ordered'), r AS (SELECT s, t FROM base WHERE pred = 'returned') SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) HAVING count(*) > 0",
        "size_buckets": f"{cat_sql}, c AS (SELECT count(*) AS nvals FROM base GROUP BY stype, pred, ttype) SELECT {_BUCKET_SQL.format('nvals')} AS bucket, count(*) AS matrices, sum(nvals)::BIGINT AS pairs FROM c GROUP BY 1",
        "explicit_counts": f"{O.overlaps(PLACES, 2)} SELECT path, min(n) AS n FROM (SELECT predictor_metapath AS path, predictor_count AS n FROM raw UNION ALL SELECT predicted_metapath, predicted_count FROM raw) GROUP BY 1",
        "summed_variants": _summed_sql(),
        "category_frequencies": "SELECT category, count(*) AS n FROM (SELECT unnest(['Customer_' || c_mktsegment, 'Customer', 'Party', 'NamedThing']) AS category FROM customer UNION ALL SELECT unnest(['Product', 'Part', 'Part_' || p_type]) FROM part UNION ALL SELECT 'LargeItem' FROM part WHERE p_size > 40 UNION ALL SELECT unnest(['NamedThing', 'Supplier', 'Party']) FROM supplier UNION ALL SELECT unnest(['Nation', 'Place']) FROM nation UNION ALL SELECT 'Region' FROM region) GROUP BY 1",
        "timing_percentiles": f"SELECT {_BUCKET_SQL.format('o_orderkey')} AS bucket, count(*) AS n, round(avg(o_totalprice), 4) AS mean, " + ", ".join(f"round(quantile_cont(o_totalprice, {p / 100}), 4) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM orders GROUP BY 1",
        "plan_costs": _plan_costs_sql(),
        "ingest_edges": f"WITH {O.base(RECORDED)} SELECT * FROM base",
        "ingest_catalog": f"WITH {O.base(RECORDED)} SELECT stype, pred, ttype, a.n AS nrows, b.n AS ncols, count(*) AS nvals FROM base JOIN sz a ON a.ntype = stype JOIN sz b ON b.ntype = ttype GROUP BY ALL",
        "matrices_overlap": _raw_sql(TWO_HOP, 1),
        "raw_files": _raw_sql(PLACES, 2),
        "grouped_files": O.grouped(PLACES, 2, True, 0, 0.0, (), ()),
        "metapath_normalize": "SELECT 'User|performed_' || e || '_high|F|EventType|performed_' || e || '|R|User|located_in|F|Nation' AS path, 'User|performed--' || e || '--high|F|EventType|performed--' || e || '--|R|User|located_in|F|Nation' AS normalized FROM (SELECT DISTINCT event_type AS e FROM events)",
        "whole_twohop_overlap": _raw_sql(PREDICATES, 2),
    }
