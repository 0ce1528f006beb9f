r"""Chat formatting by quotation linking, in DataFrame expressions only.

Lines that begin with `>` quote; the number of `>` is the level. Each run of lines of one level
is a passage. Passages and their lines are normalised (lower case, letters and digits only) and
hashed, and so are every message's own text, paragraphs and lines. A quote is linked to the
latest earlier message of its conversation that has the hash. A message answers the message that
most of its quoted text at the lowest linked level comes from; without a link it answers the
message before it. Quoted lines, and the line before a quote that ends in a colon, leave the text.

Messages of a conversation are ordered by turn; equal turns share a place. Parents have smaller
places, so places are a reply order. Only conversations with quotes are linked at all.

Defined results: null texts are empty; messages with a null conversation or turn have no place,
no parent and depth 0; repeated rows are rows of their own with equal results; a quote of
something that no earlier message has is dropped from the text but links nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.operators.skew import rank_within
from apportion.session import cut, hinted

MARK = r"^\s*((?:>\s?)+)"


def level(line: Column) -> Column:
    """Quote level of a line."""
    marks = F.regexp_extract(line, MARK, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def plain(text: Column) -> Column:
    """Lower-case letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _own_text(text: Column) -> Column:
    lines = F.split(text, "\n")
    levels = F.transform(lines, level)
    kept = F.filter(
        lines,
        lambda x, i: (F.get(levels, i) == 0) & ~(F.rtrim(x).endswith(":") & (F.coalesce(F.get(levels, i + 1), F.lit(0)) > 0)),
    )
    return _strip(F.array_join(kept, "\n"))


def _units(text: Column) -> Column:
    """Normalised text, paragraphs and lines of a text, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")), plain), lambda u: u != ""))


def _placed(rows: DataFrame) -> DataFrame:
    """(conv, turn, place): the order of the turns of each conversation."""
    turns = rows.filter("conv is not null and turn is not null").select("conv", "turn").distinct()
    return rank_within(cut(turns), ["conv"], "turn", "place")


def _linked(rows: DataFrame) -> DataFrame:
    """(conv, place, text_key, n_quotes, n_linked, answers) of messages with quotes; answers is
    the place of the message answered, null without a link."""
    quoting = rows.filter(F.col("quoting") & F.col("place").isNotNull())
    message = ["conv", "place", "text_key"]
    lines = quoting.select(*message, "text").dropDuplicates(message).select(*message, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("line", F.regexp_replace("line", MARK, ""))
    order = Window.partitionBy(*message).orderBy("at")
    step = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(1))
    lines = lines.withColumn("run", F.sum(step).over(order)).filter("level > 0")
    runs = lines.groupBy(*message, "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("passage"))
    runs = cut(runs)
    counts = runs.groupBy(*message).agg(F.count(F.lit(1)).alias("n_quotes"))
    units = runs.select(*message, "level", F.explode(_units(F.col("passage"))).alias("unit"))
    quotes = units.select("conv", F.xxhash64("unit").alias("hash"), "place", "text_key", "level", F.length("unit").alias("size"), F.lit(0).alias("kind"))
    near = quotes.select("conv").distinct()
    originals = rows.filter("place is not null").join(hinted(near, near.count(), 32), "conv", "left_semi")
    originals = originals.select("conv", "place", F.explode(_units(F.col("own"))).alias("unit")).select("conv", F.xxhash64("unit").alias("hash"), "place").distinct()
    originals = originals.withColumn("kind", F.lit(1))
    # At equal places quotes come first, so a message never answers its own place.
    past = Window.partitionBy("conv", "hash").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = quotes.unionByName(originals, allowMissingColumns=True)
    source = F.last(F.when(F.col("kind") == 1, F.col("place")), ignorenulls=True).over(past)
    hits = both.withColumn("source", source).filter("kind = 0 and source is not null")
    sums = hits.groupBy(*message, "level", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    best = sums.groupBy(*message).agg(
        F.max_by("source", F.struct(-F.col("level"), "size", "source")).alias("answers"), F.sum("n").alias("n_linked")
    )
    return cut(counts.join(best, message, "left"))


def _depths(links: DataFrame) -> DataFrame:
    """(conv, place, depth) from (conv, place, parent) by pointer doubling: each pass doubles the
    distance that is known."""
    state = cut(links.select("conv", "place", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while state.filter("up is not null").limit(1).count():
        above = state.select("conv", F.col("place").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(above, ["conv", "up"], "left")
        state = cut(state.select("conv", "place", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return state.select("conv", "place", "depth")


def reply_order(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_col, turn_col, role_col, place, parent_turn, depth (answers
    between it and a message that answers nothing), n_quotes (passages), n_linked (quoted units
    found in earlier messages) and text without quotes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    rows = rows.withColumn("quoting", F.col("text").rlike(r"(?m)^\s*>"))
    own = F.when(F.col("quoting"), _own_text(F.col("text"))).otherwise(_strip(F.col("text")))
    rows = rows.select("*", F.xxhash64("text").alias("text_key"), own.alias("own"))
    places = cut(_placed(rows))
    rows = rows.join(places, ["conv", "turn"], "left")
    earlier = places.select("conv", F.col("place").alias("parent"), F.col("turn").alias("parent_turn"))
    linked = _linked(rows)
    n_linked = linked.count()
    parent = F.when(F.col("place") > 1, F.col("place") - 1)
    if not n_linked:
        out = rows.withColumn("parent", parent).withColumn("depth", F.coalesce(F.col("place") - 1, F.lit(0)))
        out = out.select("*", F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"))
    else:
        out = rows.join(hinted(linked, n_linked, 64), ["conv", "place", "text_key"], "left").withColumn("parent", F.coalesce("answers", parent))
        # Equal turns can answer different messages: a place's own depth follows its first answer.
        chains = out.filter("place is not null").groupBy("conv", "place").agg(F.min("parent").alias("parent"))
        near = linked.select("conv").distinct()
        chains = chains.join(hinted(near, near.count(), 32), "conv", "left_semi")
        deep = _depths(chains).select("conv", F.col("place").alias("parent"), F.col("depth").alias("above"))
        out = out.join(deep, ["conv", "parent"], "left")
        other = F.coalesce(F.col("place") - 1, F.lit(0))
        out = out.withColumn("depth", F.coalesce(F.col("above") + 1, F.when(F.col("parent").isNull(), F.lit(0)).otherwise(other)))
        for c in ("n_quotes", "n_linked"):
            out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    out = out.join(earlier, ["conv", "parent"], "left")
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "place",
        "parent_turn",
        F.col("depth").cast("long").alias("depth"),
        "n_quotes",
        "n_linked",
        F.col("own").alias(text_col),
    )


_STRIP = r"regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_UNITS = (
    r"list_distinct(list_filter(list_transform(list_concat([{0}], regexp_split_to_array({0}, '\n\s*\n'), string_split({0}, chr(10))),"
    r" lambda u: trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda u: u <> ''))"
)
_MARKS = r"regexp_extract({0}, '^\s*((?:>\s?)+)', 1)"
_OWN = _STRIP.format("array_to_string(list_filter(ls, lambda x, i: lv[i] = 0 AND NOT (rtrim(x, ' ') LIKE '%:' AND coalesce(lv[i + 1], 0) > 0)), chr(10))")

SQL = rf"""WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST) END AS place
  FROM conversations),
l AS (SELECT *, string_split(text, chr(10)) AS ls, regexp_matches(text, '(?m)^\s*>') AS quoting FROM m),
v AS (SELECT *, list_transform(ls, lambda x: len({_MARKS.format("x")}) - len(replace({_MARKS.format("x")}, '>', ''))) AS lv FROM l),
o AS MATERIALIZED (SELECT *, CASE WHEN quoting THEN {_OWN} ELSE {_STRIP.format("text")} END AS own FROM v),
x AS (SELECT conv_id, place, text, i, lv[i] AS level, regexp_replace(ls[i], '^\s*((?:>\s?)+)', '') AS line
  FROM (SELECT DISTINCT conv_id, place, text, ls, lv, unnest(range(1, len(ls) + 1)) AS i FROM o WHERE quoting AND place IS NOT NULL)),
y AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, place, text ORDER BY i) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, place, text ORDER BY i) AS before FROM x)),
runs AS (SELECT conv_id, place, text, run, level, string_agg(line, chr(10) ORDER BY i) AS passage FROM y WHERE level > 0 GROUP BY ALL),
q AS (SELECT conv_id, place, text, level, unnest({_UNITS.format("passage")}) AS unit FROM runs),
a AS (SELECT DISTINCT conv_id, place, unnest({_UNITS.format("own")}) AS unit FROM o WHERE place IS NOT NULL AND conv_id IN (SELECT conv_id FROM q)),
hits AS (SELECT q.conv_id, q.place, q.text, q.level, q.unit, max(a.place) AS source FROM q JOIN a ON a.conv_id = q.conv_id AND a.unit = q.unit AND a.place < q.place GROUP BY ALL),
sums AS (SELECT h.conv_id, h.place, h.text, h.level, h.source, sum(len(h.unit)) AS size, count(*) AS n
  FROM q JOIN hits h ON q.conv_id = h.conv_id AND q.place = h.place AND q.text = h.text AND q.level = h.level AND q.unit = h.unit GROUP BY ALL),
best AS (SELECT conv_id, place, text, sum(n) AS n_linked, arg_max(source, (-level, size, source)) AS answers FROM sums GROUP BY ALL),
c AS (SELECT conv_id, place, text, count(*) AS n_quotes FROM runs GROUP BY ALL),
p AS MATERIALIZED (SELECT o.conv_id, o.turn, o.role, o.place, o.own, coalesce(c.n_quotes, 0) AS n_quotes, coalesce(b.n_linked, 0) AS n_linked,
  coalesce(b.answers, CASE WHEN o.place > 1 THEN o.place - 1 END) AS parent
  FROM o LEFT JOIN c ON c.conv_id = o.conv_id AND c.place = o.place AND c.text = o.text
  LEFT JOIN best b ON b.conv_id = o.conv_id AND b.place = o.place AND b.text = o.text),
links AS (SELECT conv_id, place, min(parent) AS parent FROM p WHERE place IS NOT NULL GROUP BY ALL),
d(conv_id, place, depth) AS (SELECT conv_id, place, 0 FROM links WHERE parent IS NULL
  UNION ALL SELECT k.conv_id, k.place, d.depth + 1 FROM links k JOIN d ON k.conv_id = d.conv_id AND k.parent = d.place),
t AS (SELECT DISTINCT conv_id, place, turn FROM m WHERE place IS NOT NULL)
SELECT p.conv_id, p.turn, p.role, CAST(p.place AS BIGINT) AS place, t.turn AS parent_turn, CAST(coalesce(d.depth + 1, 0) AS BIGINT) AS depth,
  CAST(p.n_quotes AS BIGINT) AS n_quotes, CAST(p.n_linked AS BIGINT) AS n_linked, p.own AS text
FROM p LEFT JOIN d ON d.conv_id = p.conv_id AND d.place = p.parent LEFT JOIN t ON t.conv_id = p.conv_id AND t.place = p.parent"""
