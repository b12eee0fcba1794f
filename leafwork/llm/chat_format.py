"""Chat formatting in budgeted windows, with DataFrame functions only.

The turns of a conversation are laid out by prefix sums of their token counts: a window holds
the turns that start in one cell of half the room that the system turn and the history leave,
so whole turns always fit; a turn longer than a cell has a window of its own. Each window opens
with the system turn (if the conversation starts with one), repeats up to ``history`` turns
before its first within their own budget, and then has its new turns. Only new assistant turns
are under the loss mask; repeated ones are masked.

A turn is ``<turn role=ROLE>\\n`` text ``\\n</turn>\\n``. In texts a backslash is doubled and one
is put before ``<turn`` and ``</turn``, so no text can look like a mark; roles are URL-encoded.

Edge cases: null texts and roles are empty; turns with the same number are ordered by role and
text, repeated rows stay; a null turn number comes first; rows with a null conversation form
one; an empty table has no windows; other input columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY_TURNS = 2
#: Shares of the budget that the system turn and the history may take at most before the cell shrinks to its least.
HISTORY_TOKENS = 256
LEAST_CELL = 64


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<turn"), F.lit("\\<turn"))
    return F.replace(text, F.lit("</turn"), F.lit("\\</turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its code points, and four for its marks."""
    return F.ceil(F.char_length(text) / F.lit(4)).cast("long") + 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Formatted windows: conv_id, window (from 0), formatted, segments.

    Segments, in order: turn (position in the conversation, from 1), start and stop of the escaped
    text in code points of ``formatted``, repeated, loss.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tok", tokens(F.col("text"))).withColumn("rn", F.row_number().over(by))
    rows = rows.withColumn("sys_tok", F.first(F.when((F.col("rn") == 1) & (F.col("role") == "system"), F.col("tok")).otherwise(0)).over(upto))
    rows = rows.withColumn("own", F.when((F.col("rn") == 1) & (F.col("sys_tok") > 0), 0).otherwise(F.col("tok")))
    rows = rows.withColumn("cum", F.sum("own").over(upto))
    cell = F.greatest(F.floor((F.lit(budget - history_tokens) - F.col("sys_tok")) / 2).cast("long"), F.lit(LEAST_CELL).cast("long"))
    rows = rows.withColumn("long", (F.col("own") > cell).cast("int"))
    rows = rows.withColumn("cell", F.floor((F.col("cum") - F.col("own")) / cell).cast("long"))
    # A long turn stands alone: what comes before it and after it belongs to other windows.
    rows = rows.withColumn("part", F.sum(F.col("long") * 2).over(upto) - F.col("long"))
    fresh = (F.col("rn") == 1) | (F.lag("cell").over(by) != F.col("cell")) | (F.lag("part").over(by) != F.col("part"))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("fresh").cast("int")).over(upto) - 1)
    # The windows that repeat a turn: those that open within the next few turns, if the turns between fit.
    later = []
    for k in range(1, history + 1):
        fits = F.lead("fresh", k).over(by) & (F.lead(F.col("cum") - F.col("own"), k).over(by) - (F.col("cum") - F.col("own")) <= history_tokens)
        rows = rows.withColumn(f"later{k}", F.when(fits & ~((F.col("rn") == 1) & (F.col("sys_tok") > 0)), F.lead("window", k).over(by)))
        later.append(F.col(f"later{k}"))
    system = F.first(F.struct(F.col("role"), F.col("text"))).over(upto)
    rows = rows.withColumn("system", F.when(F.col("fresh") & (F.col("sys_tok") > 0) & (F.col("rn") > 1), system))
    item = lambda window, rn, role, text, repeated: F.struct(window.alias("window"), rn.alias("rn"), role.alias("role"), text.alias("text"), repeated.alias("repeated"))
    copies = [
        item(F.col("window"), F.col("rn"), F.col("role"), F.col("text"), F.lit(False)),
        *(F.when(x.isNotNull(), item(x, F.col("rn"), F.col("role"), F.col("text"), F.lit(True))) for x in later),
        F.when(F.col("system").isNotNull(), item(F.col("window"), F.lit(1), F.col("system.role"), F.col("system.text"), F.lit(True))),
    ]
    copied = rows.select("conv_id", F.explode(F.array_compact(F.array(*copies))).alias("x")).select("conv_id", "x.*")
    opened = F.concat(F.lit("<turn role="), F.url_encode("role"), F.lit(">\n"))
    drawn = copied.select("conv_id", "window", F.struct("rn", opened.alias("opened"), escape(F.col("text")).alias("body"), "repeated", (~F.col("repeated") & (F.col("role") == "assistant")).alias("loss")).alias("x"))
    close = "\n</turn>\n"
    grouped = drawn.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    sizes = F.transform("xs", lambda x: F.char_length(x.opened) + F.char_length(x.body) + len(close))
    grouped = grouped.withColumn("sizes", sizes)
    begins = F.aggregate("sizes", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    grouped = grouped.withColumn("begins", begins)

    def segment(x: Column, i: Column) -> Column:
        start = F.get("begins", i) + F.char_length(x.opened)
        return F.struct(x.rn.alias("turn"), start.alias("start"), (start + F.char_length(x.body)).alias("stop"), x.repeated.alias("repeated"), x.loss.alias("loss"))

    formatted = F.array_join(F.transform("xs", lambda x: F.concat(x.opened, x.body, F.lit(close))), "")
    return grouped.select("conv_id", "window", formatted.alias("formatted"), F.transform("xs", segment).alias("segments"))


def digest(formed: DataFrame) -> DataFrame:
    """By conversation, from formatted windows alone: its turns and the text under the loss mask."""
    turn = r"(?s)<turn role=([^>]*)>\n(.*?)\n</turn>\n"
    read = formed.select(
        "conv_id", "window", F.char_length("formatted").alias("size"), "segments", "formatted",
        F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)).alias("roles"), F.regexp_extract_all("formatted", F.lit(turn), F.lit(2)).alias("bodies"),
    )
    both = F.filter(F.arrays_zip("roles", "bodies", "segments"), lambda x: ~x.segments.repeated)
    told = F.array_join(F.transform(both, lambda x: F.concat(F.url_decode(x.roles), F.lit("\n"), unescape(x.bodies), F.lit("\n"))), "")
    learnt = F.filter("segments", lambda s: s.loss)
    under = F.array_join(F.transform(learnt, lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.stop - s.start))), "")
    parts = read.select("conv_id", "size", F.size(both).cast("long").alias("n"), F.struct("window", told.alias("told"), under.alias("under")).alias("x"))
    by = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.sort_array(F.collect_list("x")).alias("xs"))
    text = lambda k: F.array_join(F.transform("xs", lambda x: x[k]), "")
    by = by.select("conv_id", "n_turns", "formatted_chars", text("told").alias("told"), text("under").alias("under"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return by.select("conv_id", "n_turns", sha("told").alias("turns_sha256"), F.char_length("under").cast("long").alias("loss_chars"), sha("under").alias("loss_sha256"), "formatted_chars")


#: The same result in SQL; the windows are laid out again, to count the characters of what is repeated.
ORACLE = f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
a AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tok,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM src),
b AS (SELECT *, max(CASE WHEN rn = 1 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok FROM a),
c AS (SELECT *, CASE WHEN rn = 1 AND sys_tok > 0 THEN 0 ELSE tok END AS own,
        greatest(CAST(floor(({BUDGET - HISTORY_TOKENS} - sys_tok) / 2.0) AS BIGINT), {LEAST_CELL}) AS cell FROM b),
d AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY rn) AS cum,
        CASE WHEN own > cell THEN 1 ELSE 0 END AS lng FROM c),
e AS (SELECT *, CAST(floor((cum - own) / cell) AS BIGINT) AS k, sum(lng * 2) OVER (PARTITION BY conv_id ORDER BY rn) - lng AS part FROM d),
f AS (SELECT *, CASE WHEN rn = 1 OR k <> lag(k) OVER w OR part <> lag(part) OVER w THEN 1 ELSE 0 END AS fresh
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
g AS (SELECT *, length('<turn role=' || role || '>') + 1 + length(text) + (length(text) - length(replace(text, '\\', '')))
         + (length(text) - length(replace(text, '<turn', ''))) // 5 + (length(text) - length(replace(text, '</turn', ''))) // 6 + 9 AS size,
        {" + ".join(f"CASE WHEN lead(fresh, {k}) OVER w = 1 AND lead(cum - own, {k}) OVER w - (cum - own) <= {HISTORY_TOKENS} AND NOT (rn = 1 AND sys_tok > 0) THEN 1 ELSE 0 END" for k in range(1, HISTORY_TURNS + 1))} AS again
      FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY rn))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size * (1 + again)) + sum(fresh) FILTER (WHERE rn > 1) * max(CASE WHEN rn = 1 AND sys_tok > 0 THEN size ELSE 0 END) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
