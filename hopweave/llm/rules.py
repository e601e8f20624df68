"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets a few whole-number measures. For each language and source, each measure's distribution is kept as
a mergeable quantile sketch: counts in buckets whose edges grow by ``GROWTH`` (relative error bounded by it; two
sketches merge by adding counts). A threshold lies ``FACTOR`` spreads and the measure's tolerance above the sketch's
median, so it adapts to what is usual in that language and source. The spread is that from the lower quartile to the
median (the corpus's, where that is larger): junk lies at the upper end and moves neither by much, even where it makes
up a third of a source. A source that is junk for the most part is held by its language: no threshold lies more than
``REACH`` times as far above the language's median as the language's own. Sketches of fewer than ``LEAST_DOCS`` texts
give way to that of the language, and then to that of the corpus, both merged from the finer ones. Texts are then
joined to their thresholds.

A measure that is zero for half of a group's texts says nothing of how far the others may go; there the tolerance
alone decides.

Null texts count as empty and fail the base rule; null languages and sources form groups of their own. Repeated
rows get equal results. Ties at a threshold pass. An empty table gives no rows. Texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, small, staged, table

GROWTH = 1.05
LEAST_DOCS = 50
#: Of each measure (per thousand; word length in hundredths): how far above the usual a text may lie without a spread.
TOLERANCE = {"symbols": 20, "capitals": 30, "repeats": 300, "copied_lines": 400, "word_length": 60}
LOW, MID = 25, 50
FACTOR, REACH = 8, 4


def _count(character: str) -> Column:
    """How often one ASCII character stands in the text (a byte search, no pattern)."""
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit(character), F.lit("")))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text.

    ``n_repeat_words`` counts the words that lie in a 3-word window which the text holds twice or more. Windows
    are compared by a 64-bit hash within one text: hash and place are sorted, equal neighbours are repeats.
    """
    trimmed = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    one = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    two = one.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        sum((_count(c) for c in "#*$%&|<>"), F.lit(0)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    three = two.select(
        *keep,
        "n_symbols",
        "n_capitals",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("sort_array(if(size(w) < 3, cast(array() as array<struct<h: bigint, i: int>>), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))))").alias("g"),
    )
    four = three.select(
        *[c for c in three.columns if c != "g"],
        F.expr("sort_array(transform(filter(g, (x, k) -> x.h = get(g, k + 1).h or x.h = get(g, k - 1).h), x -> x.i))").alias("starts"),
    )
    covered = F.expr("aggregate(starts, named_struct('n', 0L, 'last', -3), (a, s) -> named_struct('n', a.n + least(3, s - a.last), 'last', s), a -> a.n)")
    return four.select(*[c for c in four.columns if c != "starts"], covered.alias("n_repeat_words"))


def _per_thousand(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.lit(1000) * F.col(part) / F.col(whole))).otherwise(F.lit(0)).cast("long")


def with_values(measured: DataFrame) -> DataFrame:
    """Add the base verdict and the values that thresholds are set for."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({
        "base_failed": failed,
        "v_symbols": _per_thousand("n_symbols", "word_chars"),
        "v_capitals": _per_thousand("n_capitals", "word_chars"),
        "v_repeats": _per_thousand("n_repeat_words", "n_words"),
        "v_copied_lines": _per_thousand("n_dup_lines", "n_lines"),
        "v_word_length": F.when(F.col("n_words") > 0, F.floor(F.lit(100) * F.col("word_chars") / F.col("n_words"))).otherwise(0).cast("long"),
    })


def sketches(values: DataFrame) -> DataFrame:
    """Bucket counts per language, source and measure; ``level`` 2 is a source's, 1 a language's, 0 the corpus's."""
    pairs = ", ".join(f"'{m}', v_{m}" for m in TOLERANCE)
    bucket = F.when(F.col("v") <= 0, 0).otherwise(1 + F.floor(F.log(F.col("v").cast("double")) / F.log(F.lit(GROWTH)))).cast("int")
    long = values.filter(~F.col("base_failed")).select("lang", "source", F.expr(f"stack({len(TOLERANCE)}, {pairs}) as (measure, v)"))
    fine = long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(2))
    return fine


def merged(fine: DataFrame) -> DataFrame:
    """The sketches and their merges: of a language's sources, and of all."""
    nothing = F.lit(None).cast("string")
    by_lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).select("lang", nothing.alias("source"), "measure", "bucket", "n", F.lit(1).alias("level"))
    whole = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).select(nothing.alias("lang"), nothing.alias("source"), "measure", "bucket", "n", F.lit(0).alias("level"))
    return fine.select("lang", "source", "measure", "bucket", "n", "level").unionByName(by_lang).unionByName(whole)


def thresholds(fine: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each language and source: the largest value that passes, of each measure (``t_<measure>``)."""
    keys = ["level", "lang", "source", "measure"]
    cells = merged(fine)
    w = Window.partitionBy(*keys)  # a sketch's few hundred buckets
    run = cells.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "docs": F.sum("n").over(w)})
    edge = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * share, F.col("bucket")))
    found = run.groupBy(*keys).agg(F.max("docs").alias("docs"), edge(LOW).alias("low"), edge(MID).alias("mid"))
    value = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col(c).cast("double")))
    tolerance = F.create_map(*[F.lit(x) for m, s in TOLERANCE.items() for x in (m, float(s))])
    found = staged(found.select(*keys, "docs", value("mid").alias("mid"), (value("mid") - value("low")).alias("spread")), "rule-sketches")
    usual = found.filter("level = 0").select("measure", F.col("spread").alias("usual"))  # a row for each measure
    found = found.join(F.broadcast(usual), "measure").withColumn("room", FACTOR * F.greatest("spread", "usual") + tolerance[F.col("measure")])
    bound = found.filter("level = 1").select(F.col("lang").alias("b_lang"), F.col("measure").alias("b_measure"), (F.col("mid") + REACH * F.col("room")).alias("bound"))
    found = found.join(small(bound), (F.col("level") == 2) & F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure")), "left")
    found = found.withColumn("t", F.least(F.col("mid") + F.col("room"), "bound"))
    names = list(TOLERANCE)
    wide = found.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, F.col("t"))).alias(f"t_{m}") for m in names])
    at = lambda level, prefix: wide.filter(F.col("level") == level).select(F.col("lang").alias(f"{prefix}lang"), F.col("source").alias(f"{prefix}source"), F.col("docs").alias(f"{prefix}docs"), *[F.col(f"t_{m}").alias(f"{prefix}{m}") for m in names])
    s, lang, whole = at(2, "s_"), at(1, "l_"), at(0, "w_")
    both = s.join(lang, F.col("s_lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(whole))  # one row
    pick = lambda m: F.when(F.col("s_docs") >= least_docs, F.col(f"s_{m}")).when(F.col("l_docs") >= least_docs, F.col(f"l_{m}")).otherwise(F.col(f"w_{m}"))
    return both.select(F.col("s_lang").alias("t_lang"), F.col("s_source").alias("t_source"), *[pick(m).alias(f"t_{m}") for m in names])


def judged(values: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``values`` (staged, for it is read twice) with ``kept``: not base-failed, and no measure above its threshold."""
    limits = staged(thresholds(sketches(values), least_docs), "rule-thresholds")
    joined = values.join(small(limits), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = F.lit(True)
    for m in TOLERANCE:
        within = within & (F.col(f"v_{m}") <= F.coalesce(F.col(f"t_{m}"), F.lit(float("inf"))))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("t_lang", "t_source", *[f"t_{m}" for m in TOLERANCE])


def filtered(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows that pass, all columns of ``docs`` as they are; a table without language or source counts as one."""
    plain, back = shielded(docs, ["text", "lang", "source"])
    plain = plain.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in plain.columns})
    keep = [c for c in plain.columns if c != "text"]
    # the texts are measured once and kept aside with the measures, so that they need not be joined again
    values = staged(with_values(measures(plain.withColumn("__text", F.col("text")), [*keep, "__text"])), "rule-values")
    return judged(values, least_docs).filter("kept").withColumnRenamed("__text", "text").select(*back())


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    values = staged(with_values(measures(docs, ["doc_id", "lang", "source"])), "rule-values")
    return judged(values).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    blank = "[\\x20\\x09-\\x0D]+"
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, v_{m} AS v FROM vals WHERE NOT base_failed" for m in TOLERANCE)
    slack = " ".join(f"WHEN '{m}' THEN {float(s)}" for m, s in TOLERANCE.items())
    pick = lambda m: f"CASE WHEN s.docs >= {LEAST_DOCS} THEN s.t_{m} WHEN l.docs >= {LEAST_DOCS} THEN l.t_{m} ELSE w.t_{m} END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
wd AS (SELECT r, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS w FROM d),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS l FROM d),
gi AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM wd WHERE len(w) >= 3),
gw AS (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM gi),
gc AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM gw),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM gc WHERE k > 1) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN wd USING (r) JOIN ln USING (r) LEFT JOIN cov ON cov.r = d.r),
vals AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS v_symbols,
  CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS v_capitals,
  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS v_repeats,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS v_copied_lines,
  CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS v_word_length FROM m),
cells AS (SELECT lang, source, measure, CASE WHEN v <= 0 THEN 0 ELSE 1 + floor(ln(v::DOUBLE) / ln({GROWTH}))::INT END AS bucket FROM ({union})),
lv AS (SELECT 2 AS level, lang, source, measure, bucket, count(*) AS n FROM cells GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM cells GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, measure, bucket, count(*) FROM cells GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS docs FROM lv),
q AS (SELECT level, lang, source, measure, max(docs) AS docs, min(bucket) FILTER (upto * 100 >= docs * {LOW}) AS low, min(bucket) FILTER (upto * 100 >= docs * {MID}) AS mid FROM run GROUP BY ALL),
e AS (SELECT level, lang, source, measure, docs, CASE WHEN mid = 0 THEN 0.0::DOUBLE ELSE pow({GROWTH}::DOUBLE, mid) END AS mid, CASE WHEN low = 0 THEN 0.0::DOUBLE ELSE pow({GROWTH}::DOUBLE, low) END AS low FROM q),
o AS (SELECT e.*, {FACTOR} * greatest(e.mid - e.low, u.mid - u.low) + CASE e.measure {slack} END AS room FROM e JOIN e AS u ON u.level = 0 AND u.measure = e.measure),
t AS (SELECT o.level, o.lang, o.source, o.measure, o.docs, CASE WHEN b.mid IS NULL THEN o.mid + o.room ELSE least(o.mid + o.room, b.mid + {REACH} * b.room) END AS t
  FROM o LEFT JOIN o AS b ON o.level = 2 AND b.level = 1 AND b.lang IS NOT DISTINCT FROM o.lang AND b.measure = o.measure),
wide AS (SELECT level, lang, source, max(docs) AS docs, {", ".join(f"max(t) FILTER (measure = '{m}') AS t_{m}" for m in TOLERANCE)} FROM t GROUP BY ALL),
lim AS (SELECT s.lang, s.source, {", ".join(f"{pick(m)} AS t_{m}" for m in TOLERANCE)} FROM wide s LEFT JOIN wide l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM s.lang JOIN wide w ON w.level = 0 WHERE s.level = 2)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"v_{m} <= coalesce(t_{m}, 'inf'::DOUBLE)" for m in TOLERANCE)} AS kept
FROM vals v LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM v.lang AND lim.source IS NOT DISTINCT FROM v.source
"""


ORACLE = _oracle()
