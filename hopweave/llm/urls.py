"""URL filters: rules by host and path, and gradient-boosted trees for the URLs that no rule covers.

DataFrame functions only. A rule ``host/path`` fits its host and all subdomains where the URL's path starts with
the rule's; the longest rule that fits decides. URLs that a rule decides are the labelled ones: boosted trees on
lexical features (length, depth, digit share, entropy, parameter counts, suffix statistics) learn the rules'
verdicts and judge the rest. Trees grow by histogram: for each level of a tree one aggregation sums gradients per
node, feature and bin, and only these bounded sums reach the driver, which picks the splits. Trees are fitted on
at most ``SAMPLE_ROWS`` labelled URLs (those of the lowest hash; the documented bound), kept in one partition, so
no level shuffles. The finished trees are one CASE expression inside the scan's stage.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged on its (empty)
features. Repeated rows get equal results; two rules of equal length cannot both fit; a score of one half blocks.
Without labelled URLs, or with labels of one kind only, the share of blocked labels decides (none: allow). URLs of any
length are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, small, staged, table

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rules up to which matching is one expression; longer lists are joined on host suffixes.
EXPRESSION_RULES = 200
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 10, 3, 32, 0.5, 1.0
#: Weight of the overall share in a suffix's statistic.
PRIOR = 20
FEATURES = ("f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_letters", "f_entropy", "f_params", "f_fragment", "f_hyphens", "f_tld", "f_extension")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    known = F.coalesce(at > 0, F.lit(False))
    return pages.withColumns({"host": F.when(known, host).otherwise(""), "path": F.when(known, path).otherwise("")})


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))


def with_rule(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, expression_rules: int = EXPRESSION_RULES) -> DataFrame:
    """Add ``rule`` (the longest that fits, else null) and ``rule_verdict`` to rows with ``host`` and ``path``."""
    if len(rules) <= expression_rules:
        ordered = sorted(rules, key=lambda r: -len(r[0]))
        none = F.lit(None).cast("string")
        pick = lambda k: F.coalesce(none, *[F.when(_fits(r[0]), F.lit(r[k])) for r in ordered])
        return urls.withColumns({"rule": pick(0), "rule_verdict": pick(1)})
    # one row for each distinct host and path and each of the host's suffixes meets the rules of that suffix
    listed = urls.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "suffix string, prefix string, rule string, rule_verdict string")
    distinct = urls.select("host", "path").distinct()
    label = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    met = distinct.select("host", "path", F.explode(suffixes).alias("suffix")).join(listed, "suffix").filter(F.startswith("path", "prefix"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.length("rule")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def _count(of: Column, character: str) -> Column:
    return (F.length(of) - F.length(F.replace(of, F.lit(character), F.lit("")))).cast("int")


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add the lexical features as whole numbers, and the suffixes ``tld`` and ``extension``."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    # entropy from run lengths of the sorted characters: log2 n - sum(c log2 c) / n
    chars = F.expr(f"sort_array(filter(split(coalesce(`{url}`, ''), ''), c -> c <> ''))")
    log2 = "if(a.run > 1, a.run * log2(cast(a.run as double)), 0d)"
    mixed = F.expr(f"aggregate(`__chars`, named_struct('last', '', 'run', 0, 'sum', 0d), (a, c) -> if(c = a.last, named_struct('last', c, 'run', a.run + 1, 'sum', a.sum), named_struct('last', c, 'run', 1, 'sum', a.sum + {log2})), a -> a.sum + {log2})")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    made = urls.withColumn("__chars", chars).withColumns({
        "f_length": n,
        "f_host_length": F.length("host"),
        "f_labels": _count(F.col("host"), "."),
        "f_depth": _count(F.col("path"), "/"),
        "f_digits": F.when(n > 0, F.floor(1000 * F.length(F.regexp_replace(u, "[^0-9]", "")) / n)).otherwise(0).cast("int"),
        "f_letters": F.when(n > 0, F.floor(1000 * F.length(F.regexp_replace(u, "[^A-Za-z]", "")) / n)).otherwise(0).cast("int"),
        "f_entropy": F.when(n > 0, F.floor(100 * (F.log2(n.cast("double")) - mixed / n))).otherwise(0).cast("int"),
        "f_params": _count(query, "=") + _count(query, "&"),
        "f_fragment": F.when(F.instr(u, "#") > 0, 1).otherwise(0),
        "f_hyphens": _count(u, "-") + _count(u, "_"),
        "tld": F.regexp_extract("host", r"([^.]*)\z", 1),
        "extension": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/|/[a-z]{2}/[^/]*)\z", 1),
    })
    return made.drop("__chars").withColumn("extension", F.when(F.startswith("extension", F.lit("/")), F.substring("extension", 1, 3)).otherwise(F.col("extension")))


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: "Node | None" = None
    high: "Node | None" = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) <= self.at, self.low.column()).otherwise(self.high.column())

    def number(self) -> Column:
        """The leaf a row is in, while the tree grows: leaves are numbered in ``value``."""
        if self.low is None:
            return F.lit(int(self.value))
        return F.when(F.col(self.feature) <= self.at, self.low.number()).otherwise(self.high.number())


@dataclass
class Boosted:
    bias: float
    trees: list[Node] = field(default_factory=list)

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(float(self.bias)))

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def _best(sums: dict[tuple[str, int], tuple[float, float]], feature: str, cuts: list[int], g: float, h: float) -> tuple[float, int]:
    """The gain and cut of a feature's best split, from its bins' sums."""
    best, gl, hl = (0.0, 0), 0.0, 0.0
    for b, cut in enumerate(cuts):
        dg, dh = sums.get((feature, b), (0.0, 0.0))
        gl, hl = gl + dg, hl + dh
        if hl > 1e-3 and h - hl > 1e-3:
            gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
            if gain > best[0] + 1e-9:
                best = (gain, cut)
    return best


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Boost trees on a staged, bounded sample with the features and ``y``; it is read as one partition."""
    rows = sample.groupBy(*FEATURES, "y").agg(F.count(F.lit(1)).alias("n"))  # equal URLs' rows meet
    rows = staged(rows, "url-training").coalesce(1)
    first = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("blocked"), *[F.percentile_approx(f, [(b + 1) / BINS for b in range(BINS - 1)], 2000).alias(f) for f in FEATURES]).first()
    if not first["n"]:
        return Boosted(-30.0)
    share = first["blocked"] / first["n"]
    if not 0 < share < 1:
        return Boosted(30.0 if share else -30.0)
    cuts = {f: sorted(set(first[f])) for f in FEATURES}
    model = Boosted(math.log(share / (1 - share)))
    binned = {f"b_{f}": sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES}
    rows = staged(rows.withColumns(binned), "url-binned").coalesce(1)
    pairs = ", ".join(f"'{f}', b_{f}" for f in FEATURES)
    for _ in range(trees):
        p = model.probability()
        root = Node(0)
        slopes = rows.withColumns({"g": F.col("n") * (p - F.col("y")), "h": F.col("n") * p * (1 - p)})
        leaves = [root]
        for level in range(depth + 1):
            summed = slopes.select(root.number().alias("node"), "g", "h", F.expr(f"stack({len(FEATURES)}, {pairs}) as (feature, bin)")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            by_node: dict[int, dict[tuple[str, int], tuple[float, float]]] = {}
            for r in summed.collect():  # at most 2^depth nodes x features x bins sums
                by_node.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["h"])
            grown: list[Node] = []
            for k, leaf in enumerate(leaves):
                sums = by_node.get(k, {})
                g = sum(x[0] for (f, _), x in sorted(sums.items()) if f == FEATURES[0])
                h = sum(x[1] for (f, _), x in sorted(sums.items()) if f == FEATURES[0])
                gain, cut, feature = max(((*_best(sums, f, cuts[f], g, h), f) for f in FEATURES), key=lambda x: x[0])
                if level < depth and gain > 1e-6:
                    leaf.feature, leaf.at, leaf.low, leaf.high = feature, cut, Node(), Node()
                    grown += [leaf.low, leaf.high]
                else:
                    leaf.value = -RATE * g / (h + RIDGE)
                    leaf.feature = "done"
            if not grown:
                break
            # leaves that are done keep no number below; rows in them are told apart by a number of their own
            for k, leaf in enumerate(grown):
                leaf.value = k
            leaves = grown
            slopes = slopes.filter(root_open(root, len(grown)))
        model.trees.append(root)
    return model


def root_open(root: Node, n: int) -> Column:
    """Whether a row is in a leaf that may still be split."""

    def is_open(node: Node) -> Column:
        if node.low is None:
            return F.lit(node.feature != "done")
        return F.when(F.col(node.feature) <= node.at, is_open(node.low)).otherwise(is_open(node.high))

    return is_open(root)


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample_rows: int = SAMPLE_ROWS, url: str = "url") -> DataFrame:
    """All columns of ``pages`` with host, path, rule, ``score`` (the trees' chance of block) and verdict; columns of
    these names are replaced, others of any name stay."""
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    plain, back = shielded(pages, [url])
    if url != "__url":
        plain = plain.withColumnRenamed(url, "__url")
    wide = with_features(with_rule(with_host_path(plain, "__url"), rules), "__url")
    # the features are made once for all that is learnt; the trees' sample is the only row-wise use of them
    labelled = wide.filter(F.col("rule").isNotNull()).select("__url", "tld", "extension", *[f for f in FEATURES if f not in ("f_tld", "f_extension")], (F.col("rule_verdict") == "block").cast("int").alias("y"))
    labelled = staged(labelled, "url-labelled")
    every = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked")).first()
    share = every["blocked"] / every["n"] if every["n"] else 0.0
    sample = labelled.orderBy(F.xxhash64("__url"), "__url").limit(sample_rows)
    for suffix in ("tld", "extension"):
        rate = F.floor(1000 * (F.sum("y") + PRIOR * F.lit(share)) / (F.count(F.lit(1)) + PRIOR)).cast("int")
        stats = small(staged(labelled.groupBy(suffix).agg(rate.alias(f"f_{suffix}")), f"url-{suffix}"))
        wide = wide.join(stats, suffix, "left").fillna({f"f_{suffix}": 500})
        sample = sample.join(stats, suffix, "left")
    model = fit(sample.select(*FEATURES, "y"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    out = wide.withColumn("score", model.probability()).withColumn("verdict", verdict).withColumnRenamed("__url", url)
    return out.select(*back(), "host", "path", "rule", "score", "verdict")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
