"""Preference pairs: the longest common turn prefix as prompt, and two masked completions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandex.llm.common import table

# The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """``(start, length)`` in characters of what is learned: text and end mark of the assistant's turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(_header(t))
        body = F.length(t["text"]) + len(CLOSE) - 1
        span = F.struct((acc["at"] + head).alias("start"), body.alias("length"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + F.length(t["text"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def _clean(text: Column) -> Column:
    """Marks that a text contains are broken up, so that no text opens or closes a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def preferences(turns: DataFrame) -> DataFrame:
    """``(pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, status)``, a row for each pair.

    ``turns(pair_id, side, turn, role, text)`` with side ``chosen`` or ``rejected``. Turns are ordered by number, then
    role and text (nulls first); repeated ones stay. Null text counts as empty, a null role as ``unknown``. The
    prompt is the longest run of first turns that both sides have alike (role and text), rendered once; the
    completions are what follows, with masks over the assistant's part. Status: ``ok``; ``same`` (nothing differs);
    ``short`` (a completion has no assistant's turn); ``unpaired`` (a side is missing: it is all completion). A pair
    is the record here: one task holds the two conversations of a pair, and nothing more of them. Null pair ids form
    no pair and are left out.
    """
    row = F.struct(
        F.col("turn").alias("turn"), _clean(F.coalesce("role", F.lit("unknown"))).alias("role"), _clean(F.col("text")).alias("text")
    )
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(s[0]) for s in ("chosen", "rejected")]
    pairs = turns.where("pair_id IS NOT NULL").groupBy("pair_id").agg(*sides)
    both = F.least(F.size("c"), F.size("r"))
    same = F.transform(
        F.slice("c", 1, F.greatest(both, F.lit(0))),
        lambda t, i: (t["role"] == F.element_at("r", i + 1)["role"]) & (t["text"] == F.element_at("r", i + 1)["text"]),
    )
    pairs = pairs.withColumn("same", same)
    differs = F.array_position("same", F.lit(False))
    pairs = pairs.withColumn("prefix_turns", F.when(differs > 0, differs - 1).otherwise(F.size("same")).cast("int"))
    rest = {s: F.slice(s, F.col("prefix_turns") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("c", "r")}
    answers = {s: F.exists(rest[s], lambda t: t["role"] == "assistant") for s in rest}
    status = (
        F.when((F.size("c") == 0) | (F.size("r") == 0), "unpaired")
        .when((F.size("c") == F.size("r")) & (F.col("prefix_turns") == F.size("c")), "same")
        .when(~(answers["c"] & answers["r"]), "short")
        .otherwise("ok")
    )
    return pairs.select(
        "pair_id", "prefix_turns", F.when(F.col("prefix_turns") > 0, _render(F.slice("c", 1, F.greatest("prefix_turns", F.lit(1))))).otherwise("").alias("prompt"),
        _render(rest["c"]).alias("chosen"), _render(rest["r"]).alias("rejected"),
        _mask(rest["c"]).alias("chosen_mask"), _mask(rest["r"]).alias("rejected_mask"), status.alias("status"),
    )


def answers_of_others(turns: DataFrame) -> DataFrame:
    """``(pair_id, side, turn, role, text)`` of ``turns(conv_id, turn, role, text)``: pair n sets conversation 2n, whole,
    against its turns before the assistant's last one with the last answer of conversation 2n + 1 in its place.

    Without an answer of its own, the rejected side has all turns of 2n before that of the other. Null ids are left out.
    """
    numbered = turns.where("conv_id IS NOT NULL")
    last = numbered.where("role = 'assistant'").groupBy(F.col("conv_id").alias("of")).agg(F.max("turn").alias("last"))
    all_turns = numbered.join(last, F.col("conv_id") == F.col("of"), "left")
    first = F.col("conv_id").bitwiseAND(F.lit(1)) == 0
    before = first & (F.col("last").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("last")))
    answer = ~first & (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    ends = F.lit((1 << 63) - 1)
    sides = F.array(
        F.struct(first.alias("is"), F.lit("chosen").alias("side"), F.col("turn").cast("long").alias("turn")),
        F.struct(before.alias("is"), F.lit("rejected").alias("side"), F.col("turn").cast("long").alias("turn")),
        F.struct(answer.alias("is"), F.lit("rejected").alias("side"), ends.alias("turn")),
    )
    rows = all_turns.select(F.shiftright("conv_id", 1).alias("pair_id"), F.explode(F.filter(sides, lambda s: s["is"])).alias("s"), "role", "text")
    return rows.select("pair_id", "s.side", "s.turn", "role", "text")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of :func:`answers_of_others`; masks as ``start+length`` lists."""
    turns = answers_of_others(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"], s["length"])), ",")
    out = preferences(turns)
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


SQL = """
WITH lasts AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT k.conv_id, k.turn, k.role, k.text, l.last FROM conversations k LEFT JOIN lasts l ON k.conv_id = l.conv_id WHERE k.conv_id IS NOT NULL),
sided AS (
  SELECT conv_id >> 1 AS pair_id, 0 AS side, turn, role, text FROM c WHERE conv_id & 1 = 0
  UNION ALL SELECT conv_id >> 1, 1, turn, role, text FROM c WHERE conv_id & 1 = 0 AND (last IS NULL OR turn IS NULL OR turn < last)
  UNION ALL SELECT conv_id >> 1, 1, 9223372036854775807, role, text FROM c WHERE conv_id & 1 = 1 AND role = 'assistant' AND turn = last),
t AS (
  SELECT pair_id, side, coalesce(replace(role, '<|im_', '<| im_'), 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text, turn
  FROM sided),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
sizes AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS c, count(*) FILTER (WHERE side = 1) AS r FROM n GROUP BY pair_id),
first_differs AS (
  SELECT a.pair_id, min(a.i) AS i FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
p AS (SELECT s.pair_id, c, r, CAST(coalesce(d.i - 1, least(c, r)) AS INTEGER) AS prefix_turns FROM sizes s LEFT JOIN first_differs d ON s.pair_id = d.pair_id),
x AS (
  SELECT n.*, p.prefix_turns, i <= p.prefix_turns AS shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM n JOIN p ON n.pair_id = p.pair_id),
y AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x),
z AS (
  SELECT *, CAST(pos + 13 + length(role) AS BIGINT)::VARCHAR || '+' || (length(text) + 10)::VARCHAR AS span FROM y)
SELECT p.pair_id, p.prefix_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE shared AND side = 0), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask,
       CASE WHEN c = 0 OR r = 0 THEN 'unpaired' WHEN c = r AND p.prefix_turns = c THEN 'same'
            WHEN count(*) FILTER (WHERE NOT shared AND side = 0 AND role = 'assistant') = 0
              OR count(*) FILTER (WHERE NOT shared AND side = 1 AND role = 'assistant') = 0 THEN 'short' ELSE 'ok' END AS status
FROM p JOIN z ON p.pair_id = z.pair_id
GROUP BY p.pair_id, p.prefix_turns, c, r
"""
