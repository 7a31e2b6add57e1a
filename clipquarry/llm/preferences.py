"""Preference formatting: one prompt from the longest common turn prefix, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, read_table

TURNS = "array<struct<role:string,text:string>>"
OPEN, BETWEEN, CLOSE, AFTER = "<|", "|>\n", "<|end|>", "\n"


def _clean(turns: Column) -> Column:
    """Turns with '' for nulls; a null conversation has none."""
    return F.transform(F.coalesce(turns, F.lit([]).cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE + AFTER))), "")


def mask(turns: Column, start: Column) -> Column:
    """Spans, in characters from the beginning of the prompt, of what is to be learnt: texts and end marks of assistant turns."""
    kind = "array<struct<begin:int,end:int>>"
    zero = F.struct(start.cast("int").alias("at"), F.lit([]).cast(kind).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN + BETWEEN) + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + len(AFTER)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected), arrays of (role, text): (pair_id, turns_in_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask).

    The prompt is the longest common prefix of turns, rendered once; each completion is what follows in its conversation, of which the mask says what is learnt. If one conversation is a prefix of the other, the prompt ends a turn earlier, so that both have a completion. Pairs of equal conversations, and pairs of which a side is null or has no turn, say nothing and have no row. Null roles and texts count as empty. Repeated rows and null pair_ids are rows like others. Other columns are ignored. No rows in: none out."""
    p = only(pairs, "pair_id", "chosen", "rejected").select("pair_id", _clean(F.col("chosen")).alias("c"), _clean(F.col("rejected")).alias("r")).filter("size(c) > 0 and size(r) > 0 and c <> r")
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size("c"), F.size("r")) - 1), lambda i: F.get("c", i) != F.get("r", i))
    n = F.least(F.coalesce(F.get(differs, F.lit(0)), F.size("c")), F.size("c") - 1, F.size("r") - 1)
    p = p.withColumn("n", n).withColumn("prompt", render(F.slice("c", F.lit(1), F.col("n"))))
    rest = {x: F.slice(x, F.col("n") + 1, F.size(x) - F.col("n")) for x in "cr"}
    return p.select(
        "pair_id",
        F.col("n").cast("long").alias("turns_in_prompt"),
        "prompt",
        render(rest["c"]).alias("chosen"),
        render(rest["r"]).alias("rejected"),
        mask(rest["c"], F.length("prompt")).alias("chosen_mask"),
        mask(rest["r"], F.length("prompt")).alias("rejected_mask"),
    )


def pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of single conversations, (pair_id, chosen, rejected): chosen is a conversation up to its last assistant turn; rejected is the same but for one assistant turn, the one numbered conv_id modulo their count, in place of which it has the last earlier assistant text that differs from it or, where there is none, the first half of its words. So pairs branch at any depth, and what follows the branch is in both completions.

    Turns are in order of turn, then role and text; repeated rows count once. Rows with a null conv_id or turn are left out, conversations without an assistant turn too. A conversation is one row of the result, so it is gathered in one place, however long its texts."""
    t = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
    c = c.withColumn("t", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    own = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    c = c.withColumn("own", own).filter("size(own) > 0").withColumn("chosen", F.slice("t", F.lit(1), F.array_max("own") + 1))
    c = c.withColumn("at", F.get("own", F.pmod(F.col("conv_id"), F.size("own").cast("long")).cast("int"))).withColumn("good", F.get("chosen", F.col("at"))["text"])
    earlier = F.filter(F.slice("chosen", F.lit(1), F.col("at")), lambda x: (x["role"] == "assistant") & (x["text"] != F.col("good")))
    words = F.split("good", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    c = c.withColumn("worse", F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["text"]).otherwise(half))
    turned = F.transform("chosen", lambda x, i: F.when(i == F.col("at"), F.struct(x["role"].alias("role"), F.col("worse").alias("text"))).otherwise(x))
    return c.select(F.col("conv_id").alias("pair_id"), "chosen", turned.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(pairs(read_table(spark, sf_dir, "conversations")))


def _sql_side(side: str) -> str:
    """Completion and mask of one side: what follows the common turns, and the places of its assistant turns."""
    return f"""
{side}_at AS (SELECT *, sum(5 + length(role) + length(text) + 8) OVER (PARTITION BY conv_id ORDER BY k) - length(text) - 8 AS begin FROM {side}),
{side}_out AS (
  SELECT s.conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY s.k) AS rest,
    coalesce(list({{'begin': CAST(begin AS INT), 'end': CAST(begin + length(text) + 7 AS INT)}} ORDER BY s.k) FILTER (role = 'assistant'), []) AS mask
  FROM {side}_at s JOIN n ON n.conv_id = s.conv_id AND s.k > n.n GROUP BY s.conv_id)"""


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS m, max(k) OVER (PARTITION BY conv_id) AS last FROM i WHERE role = 'assistant'),
b AS (SELECT * FROM a WHERE j = (conv_id % m + m) % m),
e AS (SELECT b.conv_id, arg_max(a.text, a.k) AS old FROM b JOIN a ON a.conv_id = b.conv_id AND a.k < b.k AND a.text <> b.text GROUP BY b.conv_id),
w AS (SELECT b.*, coalesce(e.old, array_to_string(string_split(b.text, ' ')[1:len(string_split(b.text, ' ')) // 2], ' ')) AS bad FROM b LEFT JOIN e USING (conv_id)),
c AS (SELECT i.conv_id, i.k, i.role, i.text FROM i JOIN w ON w.conv_id = i.conv_id AND i.k <= w.last),
r AS (SELECT i.conv_id, i.k, i.role, CASE WHEN i.k = w.k THEN w.bad ELSE i.text END AS text FROM i JOIN w ON w.conv_id = i.conv_id AND i.k <= w.last),
n AS (SELECT c.conv_id, min(c.k) FILTER (c.role <> r.role OR c.text <> r.text) - 1 AS n FROM c JOIN r ON r.conv_id = c.conv_id AND r.k = c.k GROUP BY c.conv_id HAVING n IS NOT NULL),
p AS (SELECT n.conv_id, n.n, coalesce(string_agg('<|' || c.role || '|>' || chr(10) || c.text || '<|end|>' || chr(10), '' ORDER BY c.k), '') AS prompt FROM n LEFT JOIN c ON c.conv_id = n.conv_id AND c.k <= n.n GROUP BY n.conv_id, n.n),
{_sql_side("c")},
{_sql_side("r")}
SELECT p.conv_id AS pair_id, p.n AS turns_in_prompt, p.prompt, c_out.rest AS chosen, r_out.rest AS rejected, c_out.mask AS chosen_mask, r_out.mask AS rejected_mask
FROM p JOIN c_out USING (conv_id) JOIN r_out USING (conv_id)
"""

by_value(__name__)
