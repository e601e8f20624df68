"""Conversations without quotations: quoted passages are linked to the messages they come from.

DataFrame functions only. The leading ``>`` signs of a line are its quote level; neighbouring lines of one level
form a passage. Passages and their lines are normalised (lower case, single blanks) and hashed, and joined within
a conversation to the nearest earlier message whose own text (its lines of level 0) is, or holds, the same. A message
replies to the original of its lowest quoted level, a whole passage before a single line, the latest first. A quote
under ``LEAST_QUOTE`` characters, such as ``> yes``, says little: it links only as a passage of its own, and only to a
message that consists of it.

Replies are followed up to the message that began the thread by pointer doubling, so a chain of n replies takes
log2(n) joins; so are the sizes of the subtrees below each message, from which ``place``, a message's number in the
thread's reply order, follows: every message before its replies, and all that follows from one reply before the next
reply. Sorting by ``conv_id, thread_turn, place`` gives the conversations.

A conversation or a passage may hold any share of the rows. The nearest earlier message, and the replies before one,
are found in runs of ``TURNS`` turns and then between the runs, so no task gathers a conversation, and no pairs of
messages are made. Rows without conversation or turn, and null or empty texts, are kept and have no links; a text of
quotes only has an empty body. Rows that repeat a conversation's turn share its links. Quotes whose original is not in
the conversation, or comes no earlier, are removed and counted but not linked. Texts of any length are taken whole; an
empty table gives no rows. Other columns, whatever their names, are passed through; those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, staged, table

LEAST_QUOTE = 12
#: Turns of a run.
TURNS = 1024
RESULTS = ("body", "n_quotes", "max_level", "n_linked", "reply_to_turn", "thread_turn", "depth", "place")

_MARK = r"\A((?:[ \t]*>)+)[ \t]?"
_WROTE = r"(?i)\Aon .{1,200} wrote:\s*\z"


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _level(line: Column) -> Column:
    mark = F.regexp_extract(line, _MARK, 1)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def _body(text: Column) -> Column:
    """The lines of level 0 without those that introduce a quote."""
    own = F.filter(F.split(text, "\n"), lambda x: (~x.rlike(_MARK)) & (~F.btrim(x).rlike(_WROTE)))
    return F.btrim(F.array_join(own, "\n"), F.lit(" \t\n\r"))


def own_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, h), distinct: the passages that each message's own text is or holds."""
    body = messages.select("conv_id", "turn", _body(F.col("text")).alias("body"))
    held = F.array_distinct(F.concat(F.split("body", "\n"), F.split("body", r"\n[ \t]*\n")))
    pieces = F.concat(F.array(F.struct(_normal(F.col("body")).alias("piece"), F.lit(True).alias("all"))), F.transform(held, lambda x: F.struct(_normal(x).alias("piece"), F.lit(False).alias("all"))))
    each = body.select("conv_id", "turn", F.explode(pieces).alias("p")).filter((F.col("p.piece") != "") & (F.col("p.all") | (F.length("p.piece") >= LEAST_QUOTE)))
    return each.select("conv_id", "turn", F.xxhash64("p.piece").alias("h")).distinct()


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, whole, h): every quoted passage, and every line of it."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = quoting.distinct().select("conv_id", "turn", "key", "at", _level(F.col("line")).alias("level"), F.regexp_replace("line", _MARK, "").alias("content"))
    # one text's lines: a window no longer than the text
    w = Window.partitionBy("conv_id", "turn", "key").orderBy("at")
    runs = lines.withColumn("new", F.when(F.col("level") == F.lag("level").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).filter("level > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n")
    passages = runs.groupBy("conv_id", "turn", "key", "run", "level").agg(joined.alias("piece")).select("conv_id", "turn", "level", F.lit(1).alias("whole"), _normal(F.col("piece")).alias("piece"))
    single = runs.select("conv_id", "turn", "level", F.lit(0).alias("whole"), _normal(F.col("content")).alias("piece"))
    both = passages.unionByName(single.filter(F.length("piece") >= LEAST_QUOTE)).filter(F.col("piece") != "")
    return both.select("conv_id", "turn", "level", "whole", F.xxhash64("piece").alias("h"))


def nearest_earlier(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, h, turn, original) for each of ``asked`` (conv_id, h, turn; distinct): the last turn before that is in
    ``own``, if any. Found in runs of turns, then among the last turns of the runs before."""
    run = F.floor(F.col("turn") / TURNS).alias("run")
    both = asked.select("conv_id", "h", "turn", run, F.lit(True).alias("asks")).unionByName(own.select("conv_id", "h", "turn", run, F.lit(False).alias("asks")))
    # a turn's own passage does not come before itself: equal turns are outside the range
    w = Window.partitionBy("conv_id", "h", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(~F.col("asks"), F.col("turn"))).over(w)).filter("asks")
    last = own.select("conv_id", "h", run, "turn").groupBy("conv_id", "h", "run").agg(F.max("turn").alias("last"))
    runs = last.unionByName(asked.select("conv_id", "h", run).distinct(), allowMissingColumns=True).groupBy("conv_id", "h", "run").agg(F.max("last").alias("last"))
    before = runs.withColumn("before", F.max("last").over(Window.partitionBy("conv_id", "h").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    return near.join(before.select("conv_id", "h", "run", "before"), ["conv_id", "h", "run"], "left").select("conv_id", "h", "turn", F.coalesce("near", "before").alias("original"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quotes, max_level, n_linked, reply_to_turn) of the messages that quote."""
    passages = staged(quoted_passages(messages).filter("conv_id is not null and turn is not null"), "quoted")
    own = own_passages(messages.join(passages.select("conv_id").distinct(), "conv_id", "left_semi").filter("turn is not null"))
    own = staged(own.join(passages.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi"), "own-passages")
    near = nearest_earlier(passages.select("conv_id", "h", "turn").distinct(), own)
    found = passages.join(near, ["conv_id", "h", "turn"], "left")
    linked = F.col("original").isNotNull()
    best = F.min(F.when(linked, F.struct("level", (-F.col("whole")).alias("line"), (-F.col("original")).alias("turn"))))
    return found.groupBy("conv_id", "turn").agg(
        F.sum("whole").alias("n_quotes"),
        F.max("level").cast("long").alias("max_level"),
        F.sum(F.when(linked, F.col("whole")).otherwise(0)).alias("n_linked"),
        (-best["turn"]).alias("reply_to_turn"),
    )


def _above(up: DataFrame, **columns: str) -> DataFrame:
    return up.select("conv_id", F.col("turn").alias("up"), *[F.col(c).alias(n) for n, c in columns.items()])


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, size): of each message in ``edges`` (conv_id, turn, up; staged) how many follow from it, itself
    among them. After k rounds those up to 2^k replies away are counted."""
    nodes = edges.select("conv_id", "turn").unionByName(edges.select("conv_id", F.col("up").alias("turn"))).distinct()
    size, far = staged(nodes.withColumn("size", F.lit(1).cast("long")), "sizes"), edges
    while not far.isEmpty():
        more = far.join(size, ["conv_id", "turn"]).groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more"))
        size = staged(size.join(more, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        far = staged(far.join(_above(far, next="up"), ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up")), "ancestors")
    return size


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth, place) of every message that replies to another, by pointer doubling."""
    edges = staged(links.filter(F.col("reply_to_turn").isNotNull()).select("conv_id", "turn", F.col("reply_to_turn").alias("up")), "replies")
    run = F.floor(F.col("turn") / TURNS).alias("run")
    sized = staged(edges.join(subtree_sizes(edges), ["conv_id", "turn"]).select("conv_id", "turn", "up", "size", run), "replies-sized")
    # what stands before a reply: the replies to the same message that came earlier, with all that follows from them
    upto = lambda *keys: Window.partitionBy("conv_id", "up", *keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.groupBy("conv_id", "up", "run").agg(F.sum("size").alias("all")).withColumn("before", F.sum("all").over(upto().orderBy("run"))).drop("all")
    inside = sized.withColumn("inside", F.sum("size").over(upto("run").orderBy("turn")))
    step = inside.join(runs, ["conv_id", "up", "run"]).select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth"), (1 + F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("place"))
    up = staged(step, "threads")
    while True:
        met = staged(up.join(_above(up, next="up", deeper="depth", further="place"), ["conv_id", "up"], "left"), "threads")
        up = met.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"), (F.col("place") + F.coalesce("further", F.lit(0))).alias("place"))
        if met.filter(F.col("next").isNotNull()).isEmpty():
            return up.withColumnRenamed("up", "thread_turn")


def unquoted(messages: DataFrame) -> DataFrame:
    """Every row and column of ``messages`` with ``body`` (the text without quotes) and its place in the thread."""
    kept = [c for c in messages.columns if c not in RESULTS]
    links = staged(reply_links(messages.select("conv_id", "turn", "text")), "reply-links")
    nothing = F.lit(None).cast("long")
    if links.isEmpty():
        link = links.withColumns({"thread_turn": nothing, "depth": nothing, "place": nothing})
    else:
        link = links.join(threads(links), ["conv_id", "turn"], "left")
    names = [n for n in RESULTS if n != "body"]
    link = link.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), *[F.col(n).alias(f"__{n}") for n in names])
    plain = messages.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)])
    at = {c: F.col(f"c{kept.index(c)}") for c in ("conv_id", "turn", "text")}
    out = plain.join(link, (at["conv_id"] == F.col("__conv")) & (at["turn"] == F.col("__turn")), "left")
    of = {n: F.coalesce(F.col(f"__{n}"), F.lit(0)).cast("long") for n in names}
    of |= {"reply_to_turn": F.col("__reply_to_turn"), "thread_turn": F.coalesce(F.col("__thread_turn"), at["turn"])}
    return out.select(*plain.columns, _body(F.coalesce(at["text"], F.lit(""))).alias("__body"), *[of[n].alias(f"r_{n}") for n in names]).toDF(*kept, *RESULTS)


def conversations(messages: DataFrame) -> DataFrame:
    """The messages in reply order: a global sort, so that one long conversation is spread over many tasks."""
    return unquoted(messages).orderBy("conv_id", "thread_turn", "place", "turn")


def op3_quotation_links(spark, sf_dir: str) -> DataFrame:
    out = unquoted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", *RESULTS)


_N = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_M = "'^([ \\t]*>)+[ \\t]?'"
ORACLE = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, * FROM conversations),
li AS (SELECT r, conv_id, turn, md5(text) AS key, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM m WHERE text IS NOT NULL),
lv AS (SELECT *, length(regexp_replace(regexp_extract(line, {_M}), '[^>]', '', 'g')) AS level, regexp_replace(line, {_M}, '') AS content FROM li),
body AS (SELECT r, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT regexp_matches(trim(line), '^(?i)on .{{1,200}} wrote:\\s*$')), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM lv GROUP BY r),
own AS (SELECT DISTINCT conv_id, turn AS original, h FROM (
  SELECT conv_id, turn, {_N.format("body.body")} AS h, TRUE AS every FROM body JOIN m USING (r)
  UNION ALL SELECT conv_id, turn, {_N.format("piece")}, FALSE FROM (SELECT conv_id, turn, unnest(string_split(body.body, chr(10)) || regexp_split_to_array(body.body, '\\n[ \\t]*\\n')) AS piece FROM body JOIN m USING (r)))
  WHERE h <> '' AND (every OR length(h) >= {LEAST_QUOTE})),
ql AS (SELECT DISTINCT conv_id, turn, key, pos, level, content, sum(new) OVER w AS run FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY r ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lv) WINDOW w AS (PARTITION BY r ORDER BY pos)),
q AS (SELECT conv_id, turn, level, 1 AS whole, {_N.format("string_agg(content, chr(10) ORDER BY pos)")} AS h FROM ql WHERE level > 0 GROUP BY conv_id, turn, key, run, level
  UNION ALL SELECT conv_id, turn, level, 0, {_N.format("content")} FROM ql WHERE level > 0),
f AS (SELECT q.*, (SELECT max(original) FROM own WHERE own.conv_id = q.conv_id AND own.h = q.h AND own.original < q.turn) AS o FROM q WHERE q.h <> '' AND (whole = 1 OR length(q.h) >= {LEAST_QUOTE}) AND conv_id IS NOT NULL AND turn IS NOT NULL),
lk AS (SELECT conv_id, turn, sum(whole) AS n_quotes, max(level) AS max_level, sum(CASE WHEN o IS NULL THEN 0 ELSE whole END) AS n_linked,
  arg_min(o, level * 2 - whole - o / 1e12) FILTER (o IS NOT NULL) AS reply_to_turn FROM f GROUP BY 1, 2),
up(conv_id, turn, root, depth, path) AS (SELECT conv_id, turn, turn, 0, [turn] FROM (SELECT DISTINCT conv_id, turn FROM m) LEFT JOIN lk USING (conv_id, turn) WHERE reply_to_turn IS NULL
  UNION ALL SELECT lk.conv_id, lk.turn, up.root, depth + 1, list_append(path, lk.turn) FROM up JOIN lk ON lk.conv_id = up.conv_id AND lk.reply_to_turn = up.turn),
th AS (SELECT conv_id, turn, root, depth, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS place FROM up)
SELECT m.conv_id, m.turn, m.role, coalesce(body.body, '') AS body, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(max_level, 0)::BIGINT AS max_level,
  coalesce(n_linked, 0)::BIGINT AS n_linked, lk.reply_to_turn, coalesce(th.root, m.turn) AS thread_turn, coalesce(th.depth, 0)::BIGINT AS depth, coalesce(th.place, 0)::BIGINT AS place
FROM m LEFT JOIN body USING (r) LEFT JOIN lk ON lk.conv_id = m.conv_id AND lk.turn = m.turn LEFT JOIN th ON th.conv_id = m.conv_id AND th.turn = m.turn
"""
