"""Chat formatting by perspective rotation, in DataFrame functions alone.

Every participant of a conversation (each role but ``system``) gets the whole dialogue once
with their own turns as the assistant's, everybody else's as those of a named user, and a
mask that covers exactly the assistant's texts with their end marks. On request (``part``)
dialogues are cut into parts of so many turn numbers, a row each.

Marks in what people wrote cannot be taken for those of the format: in texts and roles a
blank is put between the signs of ``<|``, in roles also of ``|>``.

Edge cases: turns without ``conv_id`` belong to no dialogue and are left out; a null role
is the participant ``unknown``; a null text is empty, and its end mark alone is masked;
turns of one number come in order of role and text, null numbers first (in part 0);
repeated turns are rendered as often as they occur; very long texts are rendered whole; a
dialogue of system turns alone has no participant and no row; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def tag(role: Column, perspective: Column) -> Column:
    """The head of a turn as ``perspective`` sees it."""
    return F.when(role == perspective, F.lit("<|assistant|>\n")).when(role == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part: int | None = None) -> DataFrame:
    """Rows ``(conv_id, perspective, n_turns, n_own_turns, text, mask)``, with ``part`` also the
    turn numbers' multiple of it; ``mask`` lists the ``[start, stop)`` characters of ``text`` to
    learn from."""
    role = F.coalesce(F.replace(plain(F.col("role").cast("string")), F.lit("|>"), F.lit("| >")), F.lit("unknown"))
    number = F.coalesce(F.floor(F.col("turn") / part), F.lit(0)).cast("long").alias("part") if part else F.lit(0).alias("part")
    turns = turns.where("conv_id is not null").select("conv_id", number, "turn", role.alias("role"), plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    speakers = turns.select("conv_id", F.col("role").alias("perspective")).where("perspective <> 'system'").distinct()
    head = tag(F.col("role"), F.col("perspective"))
    said = turns.join(speakers, "conv_id").select("*", F.length(head).alias("head"), F.concat(head, "text", F.lit(END)).alias("said"))
    order = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = F.coalesce(F.sum(F.length("said")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    said = said.select("conv_id", "perspective", "part", "role", "head", "said", F.row_number().over(order).alias("k"), so_far.alias("at"))
    own = F.col("role") == F.col("perspective")
    span = F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.length("said")).alias("stop"))
    whole = said.groupBy("conv_id", "perspective", "part").agg(
        F.count("*").alias("n_turns"), F.count(F.when(own, 1)).alias("n_own_turns"),
        F.array_sort(F.collect_list(F.struct("k", "said"))).alias("text"), F.array_sort(F.collect_list(F.when(own, span))).alias("mask"),
    )
    return whole.select("conv_id", "perspective", *(["part"] if part else []), "n_turns", "n_own_turns", F.array_join("text.said", "").alias("text"), "mask")


def spans(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(replace(replace(role, '<|', '< |'), '|>', '| >'), 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT conv_id, perspective, turn, role, text,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS said,
         row_number() OVER w AS k,
         coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, count(*) AS n_turns,
       count(*) FILTER (WHERE role = perspective) AS n_own_turns,
       string_agg(said, '' ORDER BY k) AS text,
       coalesce(string_agg((ofs + length(head))::BIGINT::VARCHAR || '-' || (ofs + length(said))::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (WHERE role = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
