"""Operator 9, chat formatting: cumulative snapshots collapse into the longest conversation, which is then rendered.

Logs often hold a conversation again after each turn. Rolling hashes over turns name every prefix of a conversation; one
whose own hash is a proper prefix of a longer one goes (an anti-join on hashes), as do all but one of equal ones. Hashes
decide over narrow rows; texts are shuffled once, for what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def _part(name: str) -> str:
    """SQL for a value with its length in front, so that parts end to end stay apart; null differs from empty."""
    return f"coalesce(concat(length({name}), ':', {name}), '-')"


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and texts of the maximal conversations of turns (conv_id, turn, role, text).

    Turns go by `turn`, nulls first, and by a hash of role and text where it ties; rows repeated in all four columns count
    once. Each other row without conv_id is a conversation of one turn by itself, its id null. Null roles and texts differ from empty
    ones in comparison and render as empty. Of equal conversations that of the lowest id stays (a null id is lowest), and
    `copies` counts them. Other columns are not read. No turns, no conversations. A conversation is held whole by a task."""
    rows = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text")
    ).withColumn("digest", F.expr(f"md5({_part('role')} || {_part('text')})"))
    rows = rows.withColumn("own", F.expr("coalesce(cast(conv_id as string), concat(coalesce(cast(turn as string), '-'), ':', digest))"))  # what is one conversation
    logged = rows.groupBy("own", "conv_id").agg(F.expr("sort_array(collect_set(struct(turn, digest))).digest").alias("digests"))
    rolled = "aggregate(digests, named_struct('h', '', 'all', cast(array() as array<string>)), (a, d) -> named_struct('h', md5(a.h || d), 'all', array_append(a.all, md5(a.h || d))), a -> a.all)"
    hashed = logged.withColumn("hashes", F.expr(rolled)).withColumn("whole", F.element_at("hashes", -1))
    kept = hashed.groupBy("whole").agg(F.min_by(F.struct("own", "conv_id"), F.struct("conv_id", "own")).alias("first"), F.count("*").alias("copies"))
    prefixes = hashed.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("whole")).distinct()
    maximal = kept.join(prefixes, "whole", "left_anti").select("first.own", "copies")
    said = rows.join(maximal, "own").groupBy("own", "conv_id", "copies").agg(F.expr("sort_array(collect_set(struct(turn, digest, role, text)))").alias("said"))
    return said.select("conv_id", F.size("said").cast("bigint").alias("n_turns"), "copies", "said")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered (each turn as <|role|> line, text and <|end|>) of the maximal conversations."""
    line = f"concat('{OPEN}', coalesce(t.role, ''), '{CLOSE}\\n', coalesce(t.text, ''), '{END}\\n')"
    return collapse(turns).select("conv_id", "n_turns", "copies", F.expr(f"array_join(transform(said, t -> {line}), '')").alias("rendered"))


RENDER_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text, coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS said,
         coalesce(conv_id::VARCHAR, coalesce(turn::VARCHAR, '-') || ':' || md5(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'))) AS own
  FROM conversations
), c AS (
  SELECT own, conv_id, list(md5(said) ORDER BY turn NULLS FIRST, md5(said)) AS d,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, md5(said)) AS rendered
  FROM t GROUP BY own, conv_id
), k AS (
  SELECT d, count(*) AS copies, arg_min(struct_pack(conv_id := conv_id, rendered := rendered), coalesce(conv_id, -9223372036854775808)) AS f FROM c GROUP BY d
), p AS (SELECT DISTINCT d[1:i] AS d FROM (SELECT d, unnest(range(1, len(d))) AS i FROM k))
SELECT k.f.conv_id AS conv_id, len(k.d)::BIGINT AS n_turns, k.copies AS copies, k.f.rendered AS rendered
FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.d = k.d)
"""
