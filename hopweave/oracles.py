"""SQL text for DuckDB that states what each query must return, from the same tables."""

from __future__ import annotations

from .sources.tables import EVENT_TYPES, KINDS, LARGE_SIZE, ONTOLOGY, RANGE

_SYM = ", ".join(f"'{s}'" for s in ONTOLOGY.symmetric)


def node(kind: str, key: str) -> str:
    return f"({KINDS[kind] * RANGE} + {key}::BIGINT)"


def base(predicates: tuple[str, ...], fine: bool = True) -> str:
    """CTEs ``base`` and what follows from it: hop, cat, sz."""
    ct = "'Customer_' || c_mktsegment" if fine else "'Customer'"
    pt = f"CASE WHEN p_size > {LARGE_SIZE} THEN 'LargeItem+Part_' || p_type ELSE 'Part_' || p_type END" if fine else "'Part'"
    lines = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    c, p, s, n = node("customer", "c_custkey"), node("part", "p_partkey"), node("supplier", "l_suppkey"), node("nation", "n_nationkey")
    events = " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(EVENT_TYPES, 1))
    made = {
        "ordered": f"SELECT {ct} AS stype, 'ordered' AS pred, {pt} AS ttype, {c} AS s, {p} AS t FROM {lines} JOIN part ON l_partkey = p_partkey",
        "returned": f"SELECT {ct} AS stype, 'returned' AS pred, {pt} AS ttype, {c} AS s, {p} AS t FROM {lines} JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
        "bought_from": f"SELECT {ct} AS stype, 'bought_from' AS pred, 'Supplier' AS ttype, {c} AS s, {s} AS t FROM {lines}",
        "supplied_by": f"SELECT {pt} AS stype, 'supplied_by' AS pred, 'Supplier' AS ttype, {p} AS s, {s} AS t FROM lineitem JOIN part ON l_partkey = p_partkey",
        "located_in": f"SELECT {ct} AS stype, 'located_in' AS pred, 'Nation' AS ttype, {c} AS s, {node('nation', 'c_nationkey')} AS t FROM customer UNION ALL SELECT 'Supplier', 'located_in', 'Nation', {node('supplier', 's_suppkey')}, {node('nation', 's_nationkey')} FROM supplier",
        "in_region": f"SELECT 'Nation' AS stype, 'in_region' AS pred, 'Region' AS ttype, {n} AS s, {node('region', 'n_regionkey')} AS t FROM nation",
        "neighbor_of": f"SELECT 'Nation' AS stype, 'neighbor_of' AS pred, 'Nation' AS ttype, {node('nation', 'a.n_nationkey')} AS s, {node('nation', 'b.n_nationkey')} AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
        "performed": f"SELECT 'User' AS stype, 'performed--' || event_type || '--' AS pred, 'EventType' AS ttype, {node('user', 'user_id')} AS s, {KINDS['event_type'] * RANGE} + (CASE event_type {events} END)::BIGINT AS t FROM events",
    }
    return f"""base AS (SELECT DISTINCT stype, pred, ttype, s, t FROM ({" UNION ALL ".join(made[x] for x in predicates)})),
hop AS (SELECT stype, pred, CASE WHEN string_split(pred, '--')[1] IN ({_SYM}) THEN 'A' ELSE 'F' END AS dir, ttype, s, t FROM base
  UNION ALL SELECT ttype, pred, 'R', stype, t, s FROM base WHERE string_split(pred, '--')[1] NOT IN ({_SYM})),
cat AS (SELECT stype, pred, dir, ttype, count(*) AS nv, stype || '|' || pred || '|' || dir || '|' || ttype AS txt FROM hop GROUP BY ALL),
sz AS (SELECT ntype, count(DISTINCT id) AS n FROM (SELECT stype AS ntype, s AS id FROM base UNION ALL SELECT ttype, t FROM base) GROUP BY 1)"""


def should(n: int) -> str:
    if n == 1:
        return "c1.stype <= c1.ttype"
    return f"(c{n}.nv > c1.nv OR (c{n}.nv = c1.nv AND c1.stype <= c{n}.ttype))"


def paths(n: int, where: str = "TRUE") -> str:
    """CTEs ``plan`` (the paths to compute) and ``prod`` (their distinct pairs)."""
    joins = "".join(f" JOIN cat c{k} ON c{k - 1}.ttype = c{k}.stype" for k in range(2, n + 1))
    text = "c1.txt" + "".join(f" || '|' || c{k}.pred || '|' || c{k}.dir || '|' || c{k}.ttype" for k in range(2, n + 1))
    nodes = "[c1.stype" + "".join(f", c{k}.ttype" for k in range(1, n + 1)) + "]"
    flip = lambda d: f"CASE {d} WHEN 'F' THEN 'R' WHEN 'R' THEN 'F' ELSE 'A' END"
    back = "[" + ", ".join(flip(f"c{k}.dir") for k in range(n, 0, -1)) + "]"
    preds, dirs = "[" + ", ".join(f"c{k}.pred" for k in range(1, n + 1)) + "]", "[" + ", ".join(f"c{k}.dir" for k in range(1, n + 1)) + "]"
    keys = ", ".join(f"c{k}.txt AS k{k}" for k in range(1, n + 1))
    hops = "".join(f" JOIN hop h{k} ON h{k}.s = h{k - 1}.t AND h{k}.stype || '|' || h{k}.pred || '|' || h{k}.dir || '|' || h{k}.ttype = plan.k{k}" for k in range(2, n + 1))
    return f"""plan AS (SELECT {text} AS path, c1.stype, c{n}.ttype, {keys},
  {nodes} = list_reverse({nodes}) AND {preds} = list_reverse({preds}) AND {dirs} = {back} AS palin FROM cat c1{joins} WHERE {should(n)} AND ({where})),
prod AS (SELECT DISTINCT path, plan.stype, plan.ttype, palin, h1.s, h{n}.t FROM plan JOIN hop h1 ON h1.stype || '|' || h1.pred || '|' || h1.dir || '|' || h1.ttype = plan.k1{hops})"""


RAW = """kept AS (SELECT * FROM prod WHERE CASE WHEN stype = ttype AND palin THEN s < t WHEN stype = ttype THEN s <> t ELSE TRUE END),
cnt AS (SELECT path, count(*) AS n FROM kept GROUP BY 1),
ov AS (SELECT path, hop.stype, hop.pred, hop.dir, hop.ttype, count(*) AS o FROM kept JOIN hop ON hop.s = kept.s AND hop.t = kept.t GROUP BY ALL),
raw AS (SELECT path AS predictor_metapath, cnt.n::BIGINT AS predictor_count, cat.txt AS predicted_metapath, cat.nv::BIGINT AS predicted_count, o::BIGINT AS overlap,
  (a.n * b.n)::BIGINT AS total_possible FROM ov JOIN cnt USING (path) JOIN cat USING (stype, pred, dir, ttype) JOIN sz a ON a.ntype = cat.stype JOIN sz b ON b.ntype = cat.ttype)"""


def overlaps(predicates: tuple[str, ...], n: int, fine: bool = True, where: str = "TRUE") -> str:
    return f"WITH {base(predicates, fine)}, {paths(n, where)}, {RAW}"


def _values(rows: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ")"


def vocabulary(predicates: tuple[str, ...], types: list[str] | None = None) -> str:
    """CTEs ``tv`` and ``pv``: every type and predicate of the tables with its variants."""
    from .sources.tables import PART_TYPES

    names = types or [*ONTOLOGY.type_closure, *(f"LargeItem+Part_{t}" for t in PART_TYPES)]
    preds = [*ONTOLOGY.predicate_closure, *(f"performed--{e}--" for e in EVENT_TYPES)]
    tv = [(n, v) for n in names for v in ONTOLOGY.types_above(n)]
    pv = [(n, v) for n in preds for v in ONTOLOGY.predicates_above(n)]
    return f"tv(name, variant) AS {_values(tv)}, pv(name, variant) AS {_values(pv)}"


def one_hop_variants(source: str) -> str:
    """CTE ``var`` (txt, variant, v1, vp, vd, v2): what the one-hop paths of ``source`` (stype, pred, dir, ttype, txt) imply."""
    sym = f"string_split(p.variant, '--')[1] IN ({_SYM})"
    return f"""combo AS (SELECT DISTINCT x.txt, a.variant AS v1, p.variant AS vp, CASE WHEN {sym} THEN 'A' ELSE x.dir END AS d, b.variant AS v2, x.stype <> x.ttype AS differ
  FROM {source} x JOIN tv a ON a.name = x.stype JOIN tv b ON b.name = x.ttype JOIN pv p ON p.name = x.pred WHERE NOT (x.stype = x.ttype AND x.dir = 'R' AND {sym})),
canon AS (SELECT txt, differ, vp, least(v1, v2) AS v1, greatest(v1, v2) AS v2, CASE WHEN v1 <= v2 OR d = 'A' THEN d WHEN d = 'F' THEN 'R' ELSE 'F' END AS vd FROM combo),
var AS (SELECT DISTINCT txt, v1, vp, vd, v2, v1 || '|' || vp || '|' || vd || '|' || v2 AS variant FROM
  (SELECT * FROM canon UNION ALL SELECT txt, differ, vp, v1, v2, CASE vd WHEN 'F' THEN 'R' ELSE 'F' END FROM canon WHERE differ AND v1 = v2 AND vd <> 'A'))"""


METRICS = """CASE WHEN n > 0 THEN o / n ELSE 0 END AS precision, CASE WHEN m > 0 THEN o / m ELSE 0 END AS recall,
  CASE WHEN 2 * o > 0 THEN 2 * o / (n + m) ELSE 0 END AS f1,
  CASE WHEN n * m * (total - m) * (total - n) > 0 THEN (o * (total - n - m + o) - (n - o) * (m - o)) / sqrt(n * m * (total - m) * (total - n)) ELSE 0 END AS mcc,
  CASE WHEN total - m > 0 AND total - n - m + o >= 0 THEN (total - n - m + o) / (total - m) ELSE 0 END AS specificity,
  CASE WHEN total - n > 0 AND total - n - m + o >= 0 THEN (total - n - m + o) / (total - n) ELSE 0 END AS npv"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names)


SIX = ("precision", "recall", "f1", "mcc", "specificity", "npv")


def grouped(predicates: tuple[str, ...], n: int, fine: bool, min_count: int, min_precision: float, types: tuple[str, ...], preds: tuple[str, ...]) -> str:
    bad_t = ", ".join(f"'{t}'" for t in types) or "''"
    bad_p = ", ".join(f"'{p}'" for p in preds) or "''"
    excluded = lambda x: f"(contains({x}, '+') OR len(list_filter(string_split({x}, '|'), lambda z, i: (i % 3 = 1 AND z IN ({bad_t})) OR (i % 3 = 2 AND (z IN ({bad_p}) OR string_split(z, '--')[1] IN ({bad_p}))))) > 0)"
    return f"""WITH {vocabulary(predicates)}, {base(predicates, fine)}, {paths(n)}, {RAW},
seen AS (SELECT DISTINCT predicted_metapath AS txt FROM raw), src AS (SELECT cat.* FROM cat JOIN seen USING (txt)), {one_hop_variants("src")},
tgt AS (SELECT * FROM var WHERE NOT {excluded("variant")}),
cand AS (SELECT DISTINCT predictor_metapath AS path, variant, v1, vp, vd, v2 FROM raw JOIN tgt ON txt = predicted_metapath WHERE NOT {excluded("predictor_metapath")}),
mem AS (SELECT DISTINCT g.variant, cat.stype, cat.pred, cat.dir, cat.ttype FROM (SELECT DISTINCT variant, v1, vp, vd, v2 FROM tgt) g JOIN pv ON pv.variant = g.vp JOIN cat ON cat.pred = pv.name
  JOIN tv a ON a.name = cat.stype AND a.variant = g.v1 JOIN tv b ON b.name = cat.ttype AND b.variant = g.v2 WHERE g.vd = 'A' OR cat.dir = 'A' OR cat.dir = g.vd),
tp AS (SELECT DISTINCT variant, hop.s, hop.t FROM mem JOIN hop USING (stype, pred, dir, ttype)),
tc AS (SELECT variant, count(*)::DOUBLE AS m FROM tp GROUP BY 1),
hc AS (SELECT tv.variant AS ntype, sum(n) AS n FROM sz JOIN tv ON tv.name = sz.ntype GROUP BY 1),
ends AS (SELECT c.*, p.palin, EXISTS (SELECT 1 FROM tv WHERE name = p.stype AND variant = v1) AND EXISTS (SELECT 1 FROM tv WHERE name = p.ttype AND variant = v2) AS f,
  EXISTS (SELECT 1 FROM tv WHERE name = p.stype AND variant = v2) AND EXISTS (SELECT 1 FROM tv WHERE name = p.ttype AND variant = v1) AS r FROM cand c JOIN (SELECT DISTINCT path, stype, ttype, palin FROM plan) p USING (path)),
tag AS (SELECT path, variant, v1, v2, 'fwd' AS orientation FROM ends WHERE f UNION ALL SELECT path, variant, v1, v2, 'rev' FROM ends WHERE r AND NOT (f AND palin)),
pc AS (SELECT path, count(*)::DOUBLE AS n FROM prod GROUP BY 1),
ovx AS (SELECT tag.path, tag.variant, orientation, count(*)::DOUBLE AS o FROM tag JOIN prod ON prod.path = tag.path JOIN tp ON tp.variant = tag.variant
  AND ((orientation = 'fwd' AND tp.s = prod.s AND tp.t = prod.t) OR (orientation = 'rev' AND tp.s = prod.t AND tp.t = prod.s)) GROUP BY ALL),
fin AS (SELECT tag.variant, tag.path, tag.orientation, pc.n AS n, m, o, (coalesce(a.n, 0) * coalesce(b.n, 0))::DOUBLE AS total FROM tag JOIN ovx USING (path, variant, orientation) JOIN pc USING (path) JOIN tc ON tc.variant = tag.variant
  LEFT JOIN hc a ON a.ntype = v1 LEFT JOIN hc b ON b.ntype = v2),
scored AS (SELECT variant AS predicted_metapath, path AS predictor_metapath, orientation, n::BIGINT AS predictor_count, o::BIGINT AS overlap, total::BIGINT AS total_possible, {METRICS} FROM fin WHERE n > 0 AND n >= {min_count})
SELECT predicted_metapath, predictor_metapath, orientation, predictor_count, overlap, total_possible, {rounded(*SIX)} FROM scored WHERE precision >= {min_precision}"""
