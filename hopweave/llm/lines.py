"""Removal of boilerplate lines by their spread over distinct sites, in DataFrame functions only.

A line is known by the 64-bit hash of its trimmed text. Lines that occur less often than ``MIN_SITES`` cannot
have that spread; a plain count sets them aside. For the rest, HyperLogLog sketches of the sites, merged by
aggregation, estimate the spread; lines within ``MARGIN`` of the threshold get an exact distinct count. Lines at
or above it leave every text, however much of it they are.

A text that many sites hold unchanged is a copy, which near-duplicate search deals with, and does not make its lines
boilerplate: each different text counts once, for the first of its sites. With ``linked_copies`` the same holds for
near copies: among texts of which such lines make up over half, those that have 0.8 of their five-word shingles in
common with another form groups, exactly (:func:`copy_groups`); a group counts as one site, and lines that have the spread only through
such groups stay in the group's texts (they leave all others). All of it is DataFrame functions.

Null texts stay null; empty texts and blank lines stay as they are. Rows without a site add nothing to a spread. Ties
at the threshold count as boilerplate. Repeated rows are treated alike. Texts of any length are taken whole; an empty
table gives no rows. Other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small, staged, table
from .graphs import components

MIN_SITES = 10
#: Sketches of 2^10 registers err by 3.2 % (one deviation); the margin is eight of them.
LG_REGISTERS = 10
MARGIN = 0.25
#: Linked copies: their similarity, by shingles of so many words, and that of two texts linked with others: copies within
#: a distance of 0.2 of one original lie within 0.4 of each other.
COPY_SHARE, COPY_REACH, COPY_WORDS = (80, 100), (60, 100), 5
#: The rarest lines of a text that seek partners first, and the partners of each. A copy that links with a share p of its
#: group is left to the exact search with a chance of (1 - p) ** COPY_PARTNERS.
COPY_LINES, COPY_PARTNERS = 4, 32
#: Numbers of 64 bits in a text's parity sketch.
COPY_SKETCH = 8

_SPACE = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def _keys(text: Column, *more: Column) -> list[Column]:
    """What names a row's text: 96 bits of hash, so rows without an id need no care."""
    return [F.xxhash64(*more, text).alias("__key"), F.hash(text).alias("__key2")]


def spread_lines(lines: DataFrame, min_sites: int, copies: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hashes ``h`` of the lines found on ``min_sites`` sites or more; ``lines`` has ``h`` and ``site``, staged.

    ``copies`` (__key, __key2, one) names the site that all rows of a text count for.
    """
    often = staged(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h"), "lines-often")
    left = lines.join(small(often, most), "h", "left_semi")
    if copies is not None:
        left = left.join(small(copies, most), ["__key", "__key2"], "left").withColumn("site", F.coalesce("one", "site"))
    left = left.filter(F.col("site").isNotNull()).select("h", "site")
    spread = left.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("about"))
    spread = staged(spread.filter(F.col("about") >= min_sites * (1 - MARGIN)), "lines-spread")
    sure = spread.filter(F.col("about") > min_sites * (1 + MARGIN)).select("h")
    near = spread.filter(F.col("about") <= min_sites * (1 + MARGIN)).select("h")
    exact = left.join(small(near, most), "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h")
    return sure.unionByName(exact)


def shingle_sets(text: Column, k: int) -> Column:
    """Distinct hashes of a text's k-word shingles (all words, if fewer); words lie between ASCII blanks, A-Z
    lower-cased. Texts without words have none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, "[\\x09-\\x0D\\x20]+"), lambda w: w != "")
    at = lambda all_: F.sequence(F.lit(1), F.greatest(F.size(all_) - (k - 1), F.lit(1)))
    # bound to a name, or each shingle would split the text again
    return F.array_distinct(F.transform(F.array(words), lambda all_: F.transform(F.filter(at(all_), lambda _: F.size(all_) > 0), lambda i: F.xxhash64(F.slice(all_, i, k))))[0])


def _prefixes(sets: DataFrame, most: int) -> DataFrame:
    """(__key, m, h, at, tight, alone, p0, ...), staged: the rarest shingles of each set, as many that two sets whose
    similarity reaches ``COPY_REACH`` share one of them, and two that reach ``COPY_SHARE`` one that is ``tight`` in
    both; ``at`` is a shingle's place in the order, ``alone`` tells how many shingles no other text has, and the bits
    of ``p0`` and so on whether an odd number of the others falls on each.

    A set of m that has a share s of its shingles in common with another has all but m - ceil(s m) of them; so of the
    first m - ceil(s m) + 1 in any order that is the same for all sets, the two share one. Shingles of one text alone
    come first in the order and meet nothing.
    """
    each = sets.select("__key", F.size("set").alias("m"), F.explode("set").alias("h"))
    shared = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies-shared")
    # no longer than the text's shingles
    odd = [F.expr(f"bit_xor(if(shiftright(h, 6) & {COPY_SKETCH - 1} = {i}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"p{i}") for i in range(COPY_SKETCH)]
    order = each.join(small(shared, most), "h").groupBy("__key", "m").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("order"), *odd)
    sketch = [f"p{i}" for i in range(COPY_SKETCH)]
    alone = F.col("m") - F.size("order")
    upto = lambda share: F.greatest(F.col("m") - F.floor((F.col("m") * share[0] + share[1] - 1) / share[1]) + 1 - alone, F.lit(0)).cast("int")
    picked = order.select("__key", "m", alone.alias("alone"), *sketch, upto(COPY_SHARE).alias("tight"), F.slice("order", F.lit(1), upto(COPY_REACH))["h"].alias("of"))
    each = picked.select("__key", "m", "alone", "tight", *sketch, F.posexplode("of").alias("i", "h"))
    return staged(each.select("__key", "m", "h", (F.col("alone") + F.col("i")).alias("at"), (F.col("i") < F.col("tight")).alias("tight"), "alone", *sketch), "copies-prefixes")


def _near(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """(a, b, linked), staged: of ``pairs`` (a, b; staged) those that reach ``COPY_REACH``, and whether ``COPY_SHARE``."""
    firsts = staged(pairs.select("a").distinct(), "copies-firsts")
    first = staged(sets.join(small(firsts.select(F.col("a").alias("__key")), most), "__key", "left_semi").select(F.col("__key").alias("a"), F.col("set").alias("set_a")), "copies-first-sets")
    both = small(pairs, most).join(sets.select(F.col("__key").alias("b"), F.col("set").alias("set_b")), "b").join(small(first, most), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    met = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    every = F.col("sum") - F.col("common")
    reach = lambda share: F.col("common") * share[1] >= every * share[0]
    return staged(met.filter((F.col("common") > 0) & reach(COPY_REACH)).select("a", "b", reach(COPY_SHARE).alias("linked")), "copies-near")


def _meeting(left: DataFrame, right: DataFrame, share: tuple[int, int], more: str = "true") -> DataFrame:
    """(a, b), staged: texts of ``left`` and ``right`` (rows of :func:`_prefixes`, and more) that share a shingle and
    may reach ``share``; ``more`` is a condition on l and r.

    Two bounds rule out nearly every other pair, so that rows do not grow with the pairs of a group. What two sets have
    in common lies at their first common shingle's place or after it, in both orders: texts that part in too many rarer
    shingles do not meet by what a whole group shares, and neither do texts too unlike in size. And two sets differ in
    the shingles that either has alone and in no fewer others than their sketches in bits.
    """
    num, den = share
    first = f"least(l.m - l.at, r.m - r.at) * {num + den} >= (l.m + r.m) * {num}"
    apart = " + ".join(["l.alone", "r.alone", *(f"bit_count(l.p{i} ^ r.p{i})" for i in range(COPY_SKETCH))])
    met = left.alias("l").join(right.alias("r"), F.expr(f"l.h = r.h and l.__key <> r.__key and {first} and ({apart}) * {num + den} <= (l.m + r.m) * {den - num} and {more}"))
    return staged(met.select(F.least("l.__key", "r.__key").alias("a"), F.greatest("l.__key", "r.__key").alias("b")).distinct(), "copies-pairs")


def copy_groups(texts: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """(__key, group) of the ``texts`` (__key, __key2, text; staged, distinct) that are linked copies; ``lines`` has
    their lines (__key, __key2, h; staged).

    A text is a copy if the similarity of its shingles to another text reaches ``COPY_SHARE``; copies are one group if
    chains of copies whose similarity reaches ``COPY_REACH`` join them. Both are exact.

    Most copies share their rarest lines, so these go first: for each of its ``COPY_LINES`` rarest lines, each text is
    held against the texts that ``COPY_PARTNERS`` hashes put first among those with the line, and pairs grow with the
    texts however many share a line. What that leaves open is found by the rarest shingles (:func:`_prefixes`): texts
    not yet known as copies meet all texts that share one, and copies those of other groups. So no group is expanded
    into its pairs; unlike texts that share shingles among their rarest are.
    """
    sets = staged(texts.select("__key", shingle_sets(F.col("text"), COPY_WORDS).alias("set")), "copies-sets")
    each = staged(lines.select("__key", "h").distinct(), "copies-lines")
    drawn = F.array(*[F.min_by("__key", F.xxhash64("__key", F.lit(turn))) for turn in range(COPY_PARTNERS)])
    count = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), drawn.alias("a")).filter("n > 1"), "copies-count")
    # no longer than the text's lines
    of = each.join(small(count, most), "h").groupBy("__key").agg(F.collect_list(F.struct("n", "h", "a")).alias("all"))
    rare = of.select(F.col("__key").alias("b"), F.explode(F.array_distinct(F.flatten(F.slice(F.array_sort("all"), 1, COPY_LINES)["a"]))).alias("a"))
    near = _near(staged(rare.filter("a <> b").select("a", "b").distinct(), "copies-pairs"), sets, most)
    ends = lambda pairs: staged(pairs.filter("linked").select(F.explode(F.array("a", "b")).alias("__key")).distinct(), "copies-linked")
    prefixes = _prefixes(sets, most)
    tight = prefixes.filter("tight")
    alone = tight.join(small(ends(near), most), "__key", "left_anti")
    near = near.unionByName(_near(_meeting(alone, tight, COPY_SHARE), sets, most))
    # two texts that a text not yet known meets are copies by that pair alone, so all copies are known now
    linked = ends(near)
    for end in ("a", "b"):
        near = near.join(small(linked.select(F.col("__key").alias(end)), most), end, "left_semi")
    near = staged(near.select("a", "b"), "copies-links")
    group = staged(components(near).select(F.col("node").alias("__key"), F.col("label").alias("group")), "copies-groups")
    open_ = prefixes.join(small(group, most), "__key")
    across = staged(open_.groupBy("h").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("h"), "copies-across")
    open_ = staged(open_.join(small(across, most), "h", "left_semi"), "copies-open")
    joined = _near(_meeting(open_, open_, COPY_REACH, "l.group < r.group"), sets, most)
    if joined.isEmpty():
        return group
    return components(near.unionByName(joined.select("a", "b"))).select(F.col("node").alias("__key"), F.col("label").alias("group"))


def copied_places(docs: DataFrame, lines: DataFrame, cut: DataFrame, repeated: DataFrame, min_sites: int, most: int) -> DataFrame:
    """(__key, __key2, __keep): of texts that are linked copies, the places of lines that spread by copying alone.

    Texts with lines to cut over half their characters are held against each other (:func:`copy_groups`); each group
    of linked ones counts as one site.
    """
    whole = docs.select(*_keys(F.col("text")), "text")
    size = F.aggregate("__cut", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    much = staged(cut.select("__key", "__key2", size.alias("size")), "lines-much")
    rows = whole.join(small(much, most), ["__key", "__key2"]).filter(F.col("size") * 2 > F.length("text"))
    one = staged(rows.groupBy("__key", "__key2").agg(F.first("text").alias("text")), "lines-whole")
    names = staged(one.select("__key", "__key2"), "lines-names")
    theirs = staged(lines.join(small(names, most), ["__key", "__key2"], "left_semi"), "lines-theirs")
    found = copy_groups(one, theirs, most)
    # no site has a name with this line feed
    member = staged(names.join(small(found, most), "__key").select("__key", "__key2", F.concat(F.lit("\ncopies "), F.col("group").cast("string")).alias("one")), "lines-copies")
    inside = staged(theirs.join(small(member.drop("one"), most), ["__key", "__key2"], "left_semi"), "lines-inside")
    asked = staged(inside.select("h").distinct(), "lines-asked")
    units = staged(repeated.join(member, ["__key", "__key2"], "left_anti").unionByName(member), "lines-units")
    anyway = staged(spread_lines(lines.join(small(asked, most), "h", "left_semi"), min_sites, units, most), "lines-anyway")
    return staged(inside.join(small(anyway, most), "h", "left_anti").groupBy("__key", "__key2").agg(F.collect_set("at").alias("__keep")), "lines-kept")


def without_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, linked_copies: bool = False, broadcast_bytes: int = BROADCAST_BYTES, removed: str = "__removed") -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines cut from ``text``, and how many as a last column."""
    most = broadcast_bytes
    plain = docs.toDF(*["text" if c == text else "site" if c == site else f"c{i}" for i, c in enumerate(docs.columns)])
    keyed = plain.select(*_keys(F.col("text")), F.col("site").cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = keyed.select("__key", "__key2", "site", "at", F.length("line").alias("size"), _trimmed(F.col("line")).alias("line"))
    lines = staged(lines.filter(F.col("line") != "").select("__key", "__key2", "site", "at", "size", F.xxhash64("line").alias("h")), "lines")
    # texts in several rows: the first of their sites stands for all
    rows = plain.filter("text is not null").select(*_keys(F.col("text")), F.col("site").cast("string").alias("site"))
    repeated = staged(rows.groupBy("__key", "__key2").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("one")).filter("n > 1 and one is not null").drop("n"), "lines-repeated")
    common = staged(spread_lines(lines, min_sites, repeated, most), "lines-common")
    # one row for each different text that has such lines: copies meet before the shuffle, and the set of places
    # is no longer than the text
    cut = lines.join(small(common, most), "h", "left_semi").groupBy("__key", "__key2").agg(F.collect_set(F.struct("at", "size")).alias("__cut"))
    cut = staged(cut, "lines-cut")
    key, key2 = _keys(F.col("text"))
    joined = plain.withColumns({"__key": key, "__key2": key2}).join(small(cut, most), ["__key", "__key2"], "left")
    places = F.coalesce(F.transform("__cut", lambda x: x["at"]), F.array().cast("array<int>"))
    if linked_copies:
        joined = joined.join(small(copied_places(plain, lines, cut, repeated, min_sites, most), most), ["__key", "__key2"], "left")
        places = F.array_except(places, F.coalesce("__keep", F.array().cast("array<int>")))
    # the places that stay, by one hashed difference; the lines are split once and picked by place
    rest = F.transform(F.array(F.split("text", "\n")), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("__places")), lambda i: F.get(all_, i)), "\n"))[0]
    cleaned = joined.withColumn("__places", places).withColumn("__removed", F.size("__places").cast("long"))
    cleaned = cleaned.withColumn("text", F.when(F.col("__removed") > 0, rest).otherwise(F.col("text")))
    return cleaned.select(*plain.columns, "__removed").toDF(*docs.columns, removed)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = without_boilerplate(docs)
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CLEANED_SQL = f"""
d AS (SELECT row_number() OVER () AS r, * FROM {{docs}}),
sp AS (SELECT r, string_split(text, chr(10)) AS a FROM d),
li AS (SELECT r, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM sp),
ln AS (SELECT li.*, trim(line, {_TRIM}) AS t FROM li WHERE trim(line, {_TRIM}) <> ''),
copies AS (SELECT text, min(source) AS site FROM d GROUP BY text),
boiler AS (SELECT t FROM ln JOIN d USING (r) JOIN copies USING (text) GROUP BY t HAVING count(DISTINCT site) >= {MIN_SITES}),
hit AS (SELECT r, list(pos) AS places FROM ln JOIN boiler USING (t) GROUP BY r),
cleaned AS (SELECT d.r, CASE WHEN places IS NULL THEN 0 ELSE len(places) END AS n_removed,
  CASE WHEN places IS NULL THEN text
  ELSE array_to_string([a[i] for i in range(1, len(a) + 1) if NOT list_contains(places, i)], chr(10)) END AS text
  FROM d JOIN sp ON sp.r = d.r LEFT JOIN hit ON hit.r = d.r)
"""
ORACLE = f"""
WITH {CLEANED_SQL.format(docs="documents")}
SELECT doc_id, n_removed::BIGINT AS n_removed, length(cleaned.text)::BIGINT AS n_chars, md5(cleaned.text) AS text_md5
FROM cleaned JOIN d USING (r)
"""
