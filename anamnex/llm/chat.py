"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a table, or of each JSON object, are reduced to those that the layouts know, sorted and
hashed. The hash selects a declarative mapping, which turns prompts, instructions or messages into canonical turns.
Turns are written into one template:

    <|turn|>role\\ntext<|end|>\\n

Roles and texts are escaped first (`&` `<` `[` and, in roles, the line feed become character references), so that no
control string can stand inside them and reading is exact. loss_spans lists the places (code points from 0, length) of
assistant texts in the formatted string, in order.

Of a list, the paths of all elements count. JSON that fits no layout is not lost: its id is returned with what is wrong.

Null texts and roles count as empty; a null conversation id is one conversation of its own. Rows of equal turn number
go by role, then text; null turn numbers come first. Repeated rows stay. Columns of no layout are ignored. Very long texts
are formatted whole. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled

TURN, END = "<|turn|>", "<|end|>\n"
ASSISTANT = "assistant"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the fields that mark it; turns: SQL for the turns, or None where each row is one turn."""

    name: str
    paths: tuple[str, ...]
    turns: str | None


def _pair(user: str, assistant: str, system: str | None = None) -> str:
    parts = [f"named_struct('role', 'user', 'text', {user})", f"named_struct('role', 'assistant', 'text', {assistant})"]
    if system:
        return f"concat(if(coalesce({system}, '') = '', cast(array() as {TURNS_TYPE}), array(named_struct('role', 'system', 'text', {system}))), array({', '.join(parts)}))"
    return f"array({', '.join(parts)})"


def _list(field: str, role: str, text: str) -> str:
    return f"transform({field}, x -> named_struct('role', x.{role}, 'text', x.{text}))"


_INPUT = "concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))"
LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), None),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Layout("message texts", ("messages", "messages[].role", "messages[].text"), _list("messages", "role", "text")),
    Layout("turns", ("turns", "turns[].role", "turns[].text"), _list("turns", "role", "text")),
    Layout("from and value", ("conversations", "conversations[].from", "conversations[].value"), _list("conversations", "`from`", "value")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("instruction with input", ("input", "instruction", "output"), _pair(_INPUT, "output")),
    Layout("instruction with system", ("input", "instruction", "output", "system"), _pair(_INPUT, "output", "system")),
    Layout("prompt and completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("prompt and response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("prompt with system", ("prompt", "response", "system"), _pair("prompt", "response", "system")),
    Layout("question and answer", ("answer", "question"), _pair("question", "answer")),
)
KNOWN_PATHS = frozenset(p for x in LAYOUTS for p in x.paths)
LIST_FIELDS = tuple(sorted({p[:-2] for p in (q.split(".")[0] for q in KNOWN_PATHS) if p.endswith("[]")}))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in ([f"{at}.{f.name}" if at else f.name] + field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return []


def fingerprint(paths) -> str:
    """Hash of the known ones among field paths."""
    return hashlib.sha256("|".join(sorted(KNOWN_PATHS.intersection(paths))).encode()).hexdigest()


BY_PRINT = {fingerprint(x.paths): x for x in LAYOUTS}


class UnknownLayoutError(ValueError):
    """No mapping fits the fields; register a Layout for them."""


def _canonical_role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.element_at(names, low), role)


def turn_rows(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text), a row each, of a table in any known layout."""
    layout = BY_PRINT.get(fingerprint(field_paths(df.schema)))
    if layout is None:
        own = [p for p in field_paths(df.schema) if p != conv_id]
        layout = BY_PRINT.get(fingerprint(own))
    if layout is None:
        raise UnknownLayoutError(f"no layout has the fields {sorted(KNOWN_PATHS.intersection(field_paths(df.schema)))}")
    if layout.turns is None:
        return df.select(F.col(conv_id).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return _exploded(df.select(F.col(conv_id).alias("conv_id"), F.expr(layout.turns).alias("turns")))


def json_turn_rows(df: DataFrame, json: str, conv_id: str = "conv_id") -> DataFrame:
    """As turn_rows, but the layout is chosen for each JSON object, with a column problem.

    It is null for turns. An object that gives none is one row without turn, role and text, whose problem says why:
    'null', 'no JSON object', 'unknown layout' or 'no turns'. format_turns passes over such rows.
    """
    j = F.col(json)
    known = F.array(*(F.lit(p) for p in sorted(KNOWN_PATHS)))
    paths = F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))
    for name in LIST_FIELDS:
        items = F.from_json(F.get_json_object(j, f"$.{name}"), "array<string>")
        inner = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        paths = F.concat(paths, F.coalesce(F.transform(inner, _prefixed(f"{name}[].")), F.array().cast("array<string>")))
    mark = F.sha2(F.array_join(F.array_sort(F.array_intersect(F.array_distinct(paths), known)), "|"), 256)
    fields: dict[str, set[str]] = {}
    for p in KNOWN_PATHS:
        top, _, low = p.partition("[].")
        fields.setdefault(top, set()).update({low} - {""})
    schema = ", ".join(f"`{k}` array<struct<{','.join(f'`{x}`:string' for x in sorted(v))}>>" if v else f"`{k}` string" for k, v in sorted(fields.items()) if k not in ("conv_id", "turn"))
    broken = F.when(j.isNull(), "null").when(F.json_object_keys(j).isNull(), "no JSON object")
    parsed = df.select(F.col(conv_id).alias("__id"), broken.alias("__broken"), mark.alias("__mark"), F.from_json(j, schema).alias("__j")).select("__id", "__broken", "__mark", "__j.*")
    chosen = F.lit(None).cast(TURNS_TYPE)
    for print_, layout in BY_PRINT.items():
        if layout.turns:
            chosen = F.when(F.col("__mark") == print_, F.expr(layout.turns).cast(TURNS_TYPE)).otherwise(chosen)
    made = settled(parsed, "__turns", F.when(F.col("__broken").isNull(), chosen))
    problem = F.coalesce(F.col("__broken"), F.when(F.col("__turns").isNull(), "unknown layout").when(F.size("__turns") == 0, "no turns"))
    rows = made.select(F.col("__id").alias("conv_id"), problem.alias("problem"), F.posexplode_outer("__turns").alias("turn", "t"))
    return rows.select("conv_id", *_turn_columns(F.col("problem").isNull()), "problem")


def _prefixed(prefix: str):
    return lambda key: F.concat(F.lit(prefix), key)


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", *_turn_columns(F.lit(True)))


def _turn_columns(there: Column) -> list[Column]:
    role, text = F.coalesce(_canonical_role(F.col("t.role")), F.lit("")), F.coalesce("t.text", F.lit(""))
    return [F.col("turn").cast("long").alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text")]


#: Character references, in the order of writing; reading goes the other way.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, ref in ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(ref))
    return text


def unescaped(text: Column) -> Column:
    for plain, ref in reversed(ESCAPES):
        text = F.replace(text, F.lit(ref), F.lit(plain))
    return text


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length) of canonical turn rows."""
    if "problem" in rows.columns:
        rows = rows.where("problem IS NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(TURN), escaped(F.col("role"), role=True), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    at = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    rows = rows.select("conv_id", F.row_number().over(order).alias("k"), "piece", (F.col("role") == ASSISTANT).alias("loss"), at.alias("start"), F.length("body").cast("long").alias("length"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "piece", "loss", "start", "length"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    joined = F.array_join(F.transform("t", lambda x: x["piece"]), "")
    return settled(grouped, "formatted", joined).select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from the template."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(df: DataFrame) -> DataFrame:
    """What the formatted strings say, as counts and hashes."""
    df = settled(df, "turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
