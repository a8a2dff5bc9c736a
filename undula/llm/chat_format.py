r"""Operator 13, chat formatting with a grammar round trip. DataFrame functions only.

The grammar. A conversation is turns in a row; a turn is `<s>[INST] `, its role, ` [/INST] `, its text, `</s>`. Neither role
nor text has a control string (`<s>`, `</s>`, `[INST]`, `[/INST]`). Within them a backslash stands for the character after it.
So a turn ends at the first `</s>`, its role at the first ` [/INST] `, and the parser never looks ahead or back.

The round trip. Each turn is rendered and parsed again; if the parser fails or finds another turn, its text is rendered
by the next of ROUNDS, until what it finds is the source: as it is; with a backslash inside every control string; with
every backslash doubled as well. The last one always comes back: no control string is left in it, none can arise where
text and template meet (`</s>` doesn't overlap itself), and backslashes are undone from the left. Rendered turns are put
together to conversations, which are parsed once more and compared to their source (`identical`).

The loss mask: spans [start, end) of code points of `formatted`, one for each assistant turn, around its rendered text.

Order: turns ascend by `turn` (null first), then role, then text; repeated rows are turns of their own. Null roles and texts are empty; a
null conv_id is one conversation. An empty text of an assistant has an empty span. No rows: no result. Extra columns are ignored.

Long conversations, of over LONG turns, are formatted in blocks of BLOCK turns (`part`), whose texts in a row are the
conversation's: their turns are numbered by ranges (common.ranked), so no array of all turns arises. Only what one
SHA-256 must read in order, a conversation's whole text, meets in one row; Spark holds 2 GB in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import ranked, table
from undula.llm.decontamination import small

#: Fixed values of the template.
OPEN, SAYS, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"
#: Turns of a conversation that is formatted as a whole, and of a block of a longer one.
LONG, BLOCK = 256, 64


def guarded(text: Column) -> Column:
    """A backslash after the first character of every control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def doubled(text: Column) -> Column:
    return guarded(F.replace(text, F.lit("\\"), F.lit("\\\\")))


ROUNDS = (lambda text: text, guarded, doubled)


def unescaped(text: Column) -> Column:
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\(.?)", "$1")).otherwise(text)


def turn_of(piece: Column) -> Column:
    """What the parser finds in a turn without its `</s>`: (role, text), null if it is none."""
    at = F.instr(piece, SAYS)
    role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
    text = F.substring(piece, at + len(SAYS), F.length(piece))
    good = F.startswith(piece, F.lit(OPEN)) & (at > len(OPEN)) & ~role.rlike(CONTROL) & ~text.rlike(CONTROL)
    return F.when(good, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))


def turns_of(formatted: Column) -> Column:
    """The parser: an array of (role, text), with a null for what is no turn."""
    pieces = F.split(formatted, CLOSE)
    whole = F.element_at(pieces, -1) == ""  # nothing may follow the last end of a turn
    return F.when(whole, F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn_of))


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), doubled(role), F.lit(SAYS))


def rendered(rows: DataFrame) -> DataFrame:
    """rows with `head` and `body`, of which the parser finds their role and text."""
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    body = ROUNDS[-1](F.col("text"))
    for way in reversed(ROUNDS[:-1]):
        tried = way(F.col("text"))
        body = F.when(turns_of(F.concat(head(F.col("role")), tried, F.lit(CLOSE))) == source, tried).otherwise(body)
    return rows.select("conv_id", "part", "turn", "role", "text", head(F.col("role")).alias("head"), body.alias("body"))


def parted(conversations: DataFrame, long: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, part, turn, role, text) of the conversations that are formatted as a whole, and of longer ones."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > long).select(F.col("conv_id").alias("long_id"))
    whole = rows.withColumn("part", F.lit(0).cast("long"))
    if sizes.isEmpty():
        return whole, None
    sizes = small(sizes)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    of_long = rows.join(sizes, is_long, "left_semi").withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    of_long = of_long.withColumn("begins", F.substring("text", 1, 32))  # ranges are drawn from short values only
    placed = ranked(of_long, "key", ["turn", "role", "text"], ["turn", "role", "begins"])
    return whole.join(sizes, is_long, "left_anti"), placed.withColumn("part", F.floor(F.col("pos") / block))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss (array of spans), identical of rendered turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body")))
    d = rows.groupBy("conv_id", "part").agg(turns.alias("turns"))
    said = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    before = F.aggregate(  # where each turn begins
        "turns", F.array(F.lit(0).cast("long")),
        lambda ends, t: F.array_append(ends, F.element_at(ends, -1) + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)),
    )
    d = d.select("conv_id", "part", "turns", F.array_join(F.transform("turns", said), "").alias("formatted"), before.alias("at"))
    start = lambda t, i: F.get("at", i) + F.length(t["head"])
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(start(t, i).alias("start"), (start(t, i) + F.length(t["body"])).alias("end"))))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.coalesce(turns_of(F.col("formatted")) == source, F.lit(False))
    return d.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), "formatted", F.array_compact(spans).alias("loss"), same.alias("identical"))


def chat_format(conversations: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss, identical: a row for each conversation, or for each block of a long one."""
    whole, longer = parted(conversations, long, block)
    out = formatted(rendered(whole))
    return out if longer is None else out.unionByName(formatted(rendered(longer)))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, part, said (role, \\n, text, \\n of each turn) and learned (the text under the mask), by the parser from the output alone."""
    said = F.array_join(F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "part", "n_turns", "identical", F.length("formatted").cast("long").alias("n_chars"), said.alias("said"), F.array_join(learned, "").alias("learned"))


def digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation from those of read_back."""
    together = F.array_sort(F.collect_list(F.struct("part", "said", "learned")))
    d = rows.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.every("identical").alias("identical"), together.alias("parts"))
    text = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return d.select(
        "conv_id", "n_turns", F.sha2(text("said"), 256).alias("turns_sha256"), F.length(text("learned")).cast("long").alias("loss_chars"),
        F.sha2(text("learned"), 256).alias("loss_sha256"), "formatted_chars", "identical",
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(read_back(chat_format(rows.unionByName(planted))))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), escaped AS (
  SELECT *, regexp_replace(CASE WHEN contains(text, '\') THEN replace(text, '\', '\\') ELSE text END, '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS body,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS head FROM clean
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(10 + length(head) + 9 + length(body) + 4)::BIGINT AS formatted_chars, true AS identical
FROM escaped GROUP BY conv_id
"""
