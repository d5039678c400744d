"""Chat formatting: records of many layouts to canonical turns, and turns to one marked-up text.

A record is JSON. The nested paths of its fields, without their types, make its fingerprint; the fingerprint
selects a declarative mapping (which path holds the turns, the role, the text), so prompt and response,
instruction, message-list and one-turn-a-row layouts all become (conv_id, turn, role, text). Turns of a
conversation are then rendered through a template whose control strings are escaped inside texts, and a mask
marks the assistants' texts. `read_back` splits a rendered text into the very same turns.

Escapes: a backslash and every character that can begin a control string become a backslash and a letter,
so no control string can stand inside an escaped text, and unescaping restores it exactly.

Defined results: a null text or role is empty; turns of a conversation stand by turn, then position in the
record, role and text (ties and repeated rows all stay); a null conv_id is a conversation of its own; a
record of an unknown layout, or that is no JSON, has a null layout and no turns, and is kept in
`canonical_turns`; columns that clash with the operator's own are read by name from the record only. A
record over LONGEST bytes that can't be parsed is an error; rows that are columns already don't pass through JSON.
A conversation is one text, so one row: the only state that grows with it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "### ", ": ", " </turn>\n"
#: A character, and the letter that stands for it behind a backslash.
ESCAPES = {"\\": "b", "#": "h", "<": "l", ":": "c"}
ASSISTANT = "assistant"
#: Bytes of a record up to which null means that it is no JSON.
LONGEST = 16_000_000
#: Other layouts' names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: the record's field paths, as `fingerprint` reads them. turns: SQL over the variant `r` that gives
    an array of structs (turn long, role string, text string)."""

    name: str
    paths: str
    turns: str


def _turn(turn: str, role: str, text: str) -> str:
    return f"named_struct('turn', cast({turn} as bigint), 'role', {role}, 'text', {text})"


def _field(path: str, kind: str = "string") -> str:
    return f"try_variant_get(r, '$.{path}', '{kind}')"


def _each(items: str, role: str, text: str) -> str:
    fields = f"array<struct<{role}: string, {text}: string>>"
    return f"transform(try_variant_get(r, '$.{items}', '{fields}'), (x, i) -> {_turn('i', f'x.{role}', f'x.{text}')})"


def _pair(user: str, assistant: str, system: str = "") -> str:
    first = f"{_turn('0', repr('system'), system)}, " if system else ""
    return f"array({first}{_turn('1', repr('user'), user)}, {_turn('2', repr('assistant'), assistant)})"


_INSTRUCTION = f"concat_ws('\\n', {_field('instruction')}, nullif({_field('input')}, ''))"

LAYOUTS = (
    Layout("turn_row", "conv_id,role,text,turn", f"array({_turn(_field('turn', 'bigint'), _field('role'), _field('text'))})"),
    Layout("messages", "conv_id,messages[content,role]", _each("messages", "role", "content")),
    Layout("conversations", "conv_id,conversations[from,value]", _each("conversations", "from", "value")),
    Layout("prompt_response", "conv_id,prompt,response", _pair(_field("prompt"), _field("response"))),
    Layout("prompt_completion", "completion,conv_id,prompt", _pair(_field("prompt"), _field("completion"))),
    Layout("system_prompt_response", "conv_id,prompt,response,system", _pair(_field("prompt"), _field("response"), _field("system"))),
    Layout("instruction_output", "conv_id,instruction,output", _pair(_field("instruction"), _field("output"))),
    Layout("instruction_input_output", "conv_id,input,instruction,output", _pair(_INSTRUCTION, _field("output"))),
)


def paths_of(record: Column) -> Column:
    """Nested field paths of a variant, names in order, without types: ``conv_id,messages[content,role]``."""
    shape = F.schema_of_variant(record)
    bare = F.regexp_replace(shape, r": (?:[A-Z_]+(?:\([0-9, ]+\))?)(?=[,>])", "")  # leaves
    bare = F.regexp_replace(bare, r": ARRAY<OBJECT<", "[")
    bare = F.regexp_replace(bare, r": OBJECT<", "{")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^OBJECT<|>$", ""), ">>", "]"), r"(, )", ",")


def fingerprint(record: Column) -> Column:
    return F.sha2(paths_of(record), 256)


def escaped(text: Column) -> Column:
    for char, letter in ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescaped(text: Column) -> Column:
    for char, letter in reversed(ESCAPES.items()):  # the backslash last
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def canonical_turns(records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turn, position, role, text): a row a turn, and one without a turn for an unmapped record."""
    # Parsing also gives null for what is too long for it: no such record may vanish.
    too_long = F.raise_error(F.lit(f"a record of more than {LONGEST} bytes can't be parsed")).cast("string")
    checked = F.when(F.try_parse_json(F.col(payload)).isNull() & (F.octet_length(F.col(payload)) > LONGEST), too_long).otherwise(F.col(payload))
    parsed = records.select(checked.alias("payload")).select(F.try_parse_json("payload").alias("r"), "payload")
    marked = parsed.withColumn("fingerprint", fingerprint(F.col("r")))
    return mapped_turns(marked, layouts, F.expr("try_variant_get(r, '$.conv_id', 'bigint')"))


def mapped_turns(marked: DataFrame, layouts: tuple[Layout, ...], conv_id: Column) -> DataFrame:
    """canonical_turns of records r with their fingerprint: it selects the mapping."""
    layout, turns = F.lit(None).cast("string"), F.expr("cast(null as array<struct<turn: bigint, role: string, text: string>>)")
    for known in reversed(layouts):
        chosen = F.col("fingerprint") == hashlib.sha256(known.paths.encode()).hexdigest()
        layout, turns = F.when(chosen, known.name).otherwise(layout), F.when(chosen, F.expr(known.turns)).otherwise(turns)
    role = F.coalesce(F.col("t.role"), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return (
        marked.select(conv_id.alias("conv_id"), layout.alias("layout"), turns.alias("turns"))
        .select("conv_id", "layout", F.posexplode_outer("turns").alias("position", "t"))
        .select("conv_id", "layout", F.col("t.turn").alias("turn"), "position", F.when(F.col("layout") == "conversations", F.coalesce(names[role], role)).otherwise(role).alias("role"), F.coalesce(F.col("t.text"), F.lit("")).alias("text"))
    )


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the text of each conversation, and where the assistants' texts stand in
    it, as (turn, start within the turn's part, length) in code points."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "position", "role", "text")))
    head = lambda x: F.concat(F.lit(ROLE_OPEN), escaped(x["role"]), F.lit(ROLE_CLOSE))
    parts = F.transform("turns", lambda x: F.concat(head(x), escaped(x["text"])))
    spans = F.transform("turns", lambda x, i: F.struct(i.alias("turn"), (F.char_length(head(x)) + 1).alias("start"), F.char_length(escaped(x["text"])).alias("length"), (x["role"] == ASSISTANT).alias("loss")))
    mapped = turns.where(F.col("layout").isNotNull() & F.col("position").isNotNull())
    return (
        mapped.groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", F.concat(F.array_join(parts, TURN_CLOSE), F.lit(TURN_CLOSE)).alias("formatted"), F.filter(spans, lambda x: x["loss"]).alias("loss_mask"))
    )


def parts_of(formatted: Column) -> Column:
    """The formatted turns without their end marks; the last end mark leaves an empty rest, which goes."""
    return F.filter(F.split(formatted, TURN_CLOSE, -1), lambda x: x != "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""

    def turn(part: Column) -> Column:
        colon = F.locate(ROLE_CLOSE, part) if isinstance(part, str) else F.position(F.lit(ROLE_CLOSE), part)
        return F.struct(unescaped(F.substring(part, F.lit(len(ROLE_OPEN) + 1), colon - len(ROLE_OPEN) - 1)).alias("role"), unescaped(F.substring(part, colon + len(ROLE_CLOSE), F.char_length(part))).alias("text"))

    return F.transform(parts_of(formatted), turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the mask, nothing between the pieces."""
    parts = parts_of(formatted)
    return F.array_join(F.transform(loss_mask, lambda m: unescaped(F.substring(F.get(parts, m["turn"]), m["start"], m["length"]))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as records of the one-turn-a-row layout."""
    return conversations.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("payload"))


def turns_of_rows(conversations: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """canonical_turns of rows whose columns are a record's fields: each row's field paths make its fingerprint, which selects the
    mapping, and that reads the columns. The texts don't pass through JSON, so they may have any length."""
    rows = conversations.select(F.struct("conv_id", "turn", "role", "text").alias("r"))
    # Paths don't depend on values, so a record without its texts has the same ones.
    bare = F.to_variant_object(F.struct(*[F.when(F.col(f"r.{c}").isNotNull(), F.lit("")).alias(c) for c in rows.schema["r"].dataType.names]))
    return mapped_turns(rows.withColumn("fingerprint", fingerprint(bare)), tuple(Layout(x.name, x.paths, of_columns(x.turns)) for x in layouts if fits(x, rows.schema["r"].dataType.names)), F.col("r.conv_id").cast("bigint"))


def fits(layout: Layout, columns: list[str]) -> bool:
    """Whether a layout's mapping can read these columns."""
    return set(re.findall(r"'\$\.(\w+)'", layout.turns)) <= set(columns)


def of_columns(turns: str) -> str:
    """A layout's mapping, over a struct `r` instead of a variant."""
    return re.sub(r"try_variant_get\(r, '\$\.(\w+)', '([^']+)'\)", r"try_cast(r.\1 as \2)", turns)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.to_json(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("payload"))
    rendered = render(turns_of_rows(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(extra)))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (
        rendered.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    )


#: The same digests of the rows themselves; the formatted length follows from the template and its escapes.
OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 2, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) + 4 + 2 + 9 AS chars
  FROM said
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""
