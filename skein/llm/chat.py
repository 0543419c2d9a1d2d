"""Operator 7: conversations of many layouts to one chat text (DataFrame functions only).

The nested field paths of a record are hashed to a schema fingerprint, and a
declarative mapping chosen by that fingerprint turns prompt, instruction and message
layouts into canonical turns (role, text). A record is JSON, or a row that is already
one turn. Of such a row only the skeleton is fingerprinted, its nested fields with a
flag in place of each value, so no text becomes JSON and neither a turn nor a
conversation meets the limits of a parser.

A JSON layout without a mapping gives null turns and is kept; a record that can't be
parsed (malformed, or beyond the limits of a variant) and a turn without a mapping are
errors, so nothing is lost silently.

Template: each turn is ``<s>role[INST]text</s>``. Inside roles and texts ``~``,
``<`` and ``[`` are written ``~0``, ``~1`` and ``~2``, so no control string can
occur in them, and reading back is exact. The loss mask lists the character
ranges of assistant texts in the formatted text.

Null text or role is empty. Turns of one conversation are ordered by turn, then
role and text, null turns first; rows with a null ``conv_id`` form one
conversation. Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Escapes, in the order in which they are written; read back in the reverse order.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "</s>"
TURNS = "array<struct<role string, text string>>"

#: Layouts: a name, an example record with all its fields, and the canonical turns as SQL over ``v``. A record without
#: any message has a fingerprint of its own, and the same mapping.
LAYOUTS = (
    ("no messages", '{"messages": []}', "variant_get(v, '$.messages', 'array<struct<role string, text string>>')"),
    ("no conversations", '{"conversations": []}', "variant_get(v, '$.conversations', 'array<struct<role string, text string>>')"),
    (
        "messages",
        '{"messages": [{"role": "", "content": ""}]}',
        "transform(variant_get(v, '$.messages', 'array<struct<role string, content string>>'), m -> struct(m.role AS role, m.content AS text))",
    ),
    (
        "conversations",
        '{"conversations": [{"from": "", "value": ""}]}',
        "transform(variant_get(v, '$.conversations', 'array<struct<`from` string, value string>>'), m -> struct(CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END AS role, m.value AS text))",
    ),
    (
        "prompt",
        '{"prompt": "", "completion": ""}',
        "array(struct('user' AS role, variant_get(v, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(v, '$.completion', 'string') AS text))",
    ),
    (
        "prompt with system",
        '{"system": "", "prompt": "", "completion": ""}',
        "array(struct('system' AS role, variant_get(v, '$.system', 'string') AS text), struct('user' AS role, variant_get(v, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(v, '$.completion', 'string') AS text))",
    ),
    (
        "instruction",
        '{"instruction": "", "output": ""}',
        "array(struct('user' AS role, variant_get(v, '$.instruction', 'string') AS text), struct('assistant' AS role, variant_get(v, '$.output', 'string') AS text))",
    ),
    (
        "instruction with input",
        '{"instruction": "", "input": "", "output": ""}',
        "array(struct('user' AS role, concat_ws('\\n\\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), '')) AS text), struct('assistant' AS role, variant_get(v, '$.output', 'string') AS text))",
    ),
)


#: Field names that some layout uses; a leaf of another name (such as an author's) is no part of a layout.
NAMES = ("messages", "role", "content", "conversations", "from", "value", "system", "prompt", "completion", "instruction", "input",
    "output")


def fingerprint(variant: Column, names: tuple[str, ...] = NAMES) -> Column:
    """Hash of the nested paths of the fields ``names``, which layouts use; types of leaves and leaves of other names don't count."""
    shape = F.schema_of_variant(variant)
    shape = F.regexp_replace(shape, r"\b(STRING|VOID|BIGINT|DOUBLE|BOOLEAN|VARIANT|DATE|FLOAT|BINARY|DECIMAL\(\d+,\s*\d+\))(?![\w:])", "_")
    shape = F.regexp_replace(shape, "ARRAY<_>", "_")
    shape = F.regexp_replace(shape, rf"(?<=<|, )`?(?!(?:{'|'.join(names)})`?:)[^`:<>,]+`?: _(?:, |(?=>))", "")
    return F.xxhash64(F.regexp_replace(shape, ", >", ">"))


def canonical_turns(records: DataFrame, record_col: str = "record", to: str = "turns") -> DataFrame:
    """The rows with ``to``, the canonical turns of the JSON in ``record_col``."""
    spark = records.sparkSession
    mark = "mapped_"
    while mark in records.columns:
        mark += "_"
    examples = spark.range(1).select(*(fingerprint(F.parse_json(F.lit(x))).alias(f"f{i}") for i, (_, x, _) in enumerate(LAYOUTS)))
    known = examples.first()
    parsed = records.withColumn(mark, F.parse_json(record_col))
    parsed = parsed.withColumn(f"{mark}f", fingerprint(F.col(mark)))
    cases = [(known[i], F.expr(turns.replace("(v,", f"(`{mark}`,"))) for i, (_, _, turns) in enumerate(LAYOUTS)]
    chosen = reduce(lambda rest, x: F.when(F.col(f"{mark}f") == x[0], x[1]).otherwise(rest), reversed(cases), F.lit(None).cast(TURNS))
    filled = F.transform(
        chosen, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    )
    return parsed.withColumn(to, filled).drop(mark, f"{mark}f")


def escaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), text)


def format_chat(rows: DataFrame, turns_col: str = "turns") -> DataFrame:
    """The rows with ``formatted`` and ``loss``, the [begin, end) character ranges of assistant texts in it."""
    pieces = F.transform(
        turns_col,
        lambda t: F.struct(
            (t["role"] == "assistant").alias("learn"),
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE)).alias("head"),
            escaped(t["text"]).alias("body"),
        ),
    )
    rows = rows.withColumn("pieces_", pieces)
    formatted = F.array_join(F.transform("pieces_", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return rows.withColumn("formatted", formatted).withColumn("loss", _ranges(F.col("pieces_"))).drop("pieces_")


#: Turns whose ranges are gathered at a time; appending to an array copies it, so the arrays under way stay short.
_BLOCK = 256


def _ranges(pieces: Column) -> Column:
    """The ranges of the turns to learn, in time that grows with the number of turns: blocks of turns first, then all blocks."""
    array, longs = "array<struct<begin long, end long>>", lambda x: x.cast("long")

    def turn(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        own = F.array(F.struct(longs(begin).alias("begin"), longs(end).alias("end")))
        return F.struct(longs(end + len(CLOSE)).alias("at"),
            F.when(p["learn"], F.concat(s["loss"], own)).otherwise(s["loss"]).alias("loss"))

    def block(i: Column) -> Column:
        start = F.struct(longs(F.lit(0)).alias("at"), F.array().cast(array).alias("loss"))
        return F.aggregate(F.slice(pieces, i * _BLOCK + 1, F.lit(_BLOCK)), start, turn)

    def follow(s: Column, b: Column) -> Column:
        moved = F.transform(b["loss"], lambda r: F.struct((r["begin"] + s["at"]).alias("begin"), (r["end"] + s["at"]).alias("end")))
        return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["loss"], F.array(moved)).alias("loss"))

    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(pieces) / _BLOCK).cast("int") - 1))
    start = F.struct(longs(F.lit(0)).alias("at"), F.array().cast(f"array<{array}>").alias("loss"))
    return F.when(pieces.isNotNull(), F.flatten(F.aggregate(F.transform(numbers, block), start, follow)["loss"]))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        two = F.split(F.substring(p, len(OPEN) + 1, 2147483647), r"\[INST\]")
        return F.struct(unescaped(two[0]).alias("role"), unescaped(two[1]).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(
        F.transform(loss, lambda r: unescaped(F.substr(formatted, (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")))), ""
    )


#: Layouts of rows that are one turn: an example with all its fields, and the role and the text of a turn.
TURN_LAYOUTS = (
    ('{"role": "", "text": ""}', "role", "text"),
    ('{"role": "", "content": ""}', "role", "content"),
    ('{"from": "", "value": ""}', "CASE `from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE `from` END", "value"),
)
TURN_NAMES = ("role", "text", "content", "from", "value")


def skeleton(value: Column, kind: DataType) -> Column:
    """A value's nested fields, with a flag in place of every leaf; a null leaf keeps its path, and what holds no field of a layout is a leaf."""
    if isinstance(kind, StructType) and any(f.name in TURN_NAMES for f in kind):
        return F.struct(*(skeleton(value[f.name], f.dataType).alias(f.name) for f in kind))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and any(f.name in TURN_NAMES for f in kind.elementType):
        return F.transform(value, lambda x: skeleton(x, kind.elementType))
    return value.isNotNull()


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn) and the fields of a turn as (conv_id, turns), one row a conversation; the fields' fingerprint chooses their mapping."""
    fields = [f for f in rows.schema if f.name not in ("conv_id", "turn")]
    fitting = [x for x in TURN_LAYOUTS if set(json.loads(x[0])) <= {f.name for f in fields}]
    if not fitting:
        raise ValueError(f"no mapping for turns of {sorted(f.name for f in fields)}")
    known = rows.sparkSession.range(1).select(*(fingerprint(F.parse_json(F.lit(x[0])), TURN_NAMES).alias(f"f{i}") for i,
            x in enumerate(fitting))).first()
    mark = fingerprint(F.to_variant_object(F.struct(*(skeleton(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))),
        TURN_NAMES)
    unknown = F.raise_error(F.lit("a turn whose layout has no mapping")).cast("string")

    def mapped(i: int) -> Column:
        return reduce(lambda rest, x: F.when(F.col("mark_") == x[0], F.expr(x[1][i]).cast("string")).otherwise(rest),
            zip(known, fitting, strict=True), unknown)

    marked = rows.withColumn("mark_", mark)
    said = marked.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(mapped(1), F.lit("")).alias("role"),
        F.coalesce(mapped(2), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    turns = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return said.groupBy("conv_id").agg(ordered.alias("said")).select("conv_id", turns.alias("turns"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, as counts and digests."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, t.* FROM VALUES (0L, 'user', '{hard}'), (1L, 'assistant', '{hard}') AS t(turn, role, text)")
    chat = format_chat(turns_of_rows(rows.unionByName(more)))
    back = chat.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
sized AS (
  SELECT *, length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'))
    + length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) + 13 AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
