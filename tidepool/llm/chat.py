"""Chat formatting: layouts known by the fingerprint of their nested fields.

A layout is told by the hash of its sorted field paths. The hash selects a
declarative mapping that turns a record, or the rows of a conversation, into
canonical turns, an array of (role, text). Turns are rendered by a template with control strings; control
strings inside roles and texts are escaped so that the output can be read back.
Only DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"

# Control strings after their first character. None may stand in a text.
CONTROLS = {
    "<": r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)",
    r"\[": r"(/?INST\])",
}


def _said(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turn(role: str, text: Column) -> Column:
    return _said(F.lit(role), text)


def _pair(user: Column, answer: Column) -> Column:
    return F.array(_turn("user", user), _turn("assistant", answer))


# Names of speakers in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def _listed(items: Column, role: str, text: str) -> Column:
    turn = lambda t: F.struct(_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))
    return F.coalesce(F.transform(items, turn), F.lit([]).cast(TURNS))


def _instruction(task: Column, more: Column | None, answer: Column) -> Column:
    if more is not None:
        more = F.coalesce(more, F.lit(""))
        task = F.when(more == "", task).otherwise(F.concat(F.coalesce(task, F.lit("")), F.lit("\n\n"), more))
    return _pair(task, answer)


Mapping = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Layout:
    """Field paths, the mapping from a getter of fields to turns, and the field that orders the rows of a conversation."""

    fields: tuple[str, ...]
    turns: Mapping
    order: str | None = None


# The most specific layout comes first; of equal ones, the first listed.
LAYOUTS = (
    Layout(("role", "text", "turn"), lambda f: F.array(_said(f("role"), f("text"))), "turn"),
    Layout(("messages", "messages[].content", "messages[].role"), lambda f: _listed(f("messages"), "role", "content")),
    Layout(("conversations", "conversations[].from", "conversations[].value"), lambda f: _listed(f("conversations"), "from", "value")),
    Layout(("input", "instruction", "output"), lambda f: _instruction(f("instruction"), f("input"), f("output"))),
    Layout(("instruction", "output"), lambda f: _instruction(f("instruction"), None, f("output"))),
    Layout(("prompt", "response"), lambda f: _pair(f("prompt"), f("response"))),
    Layout(("completion", "prompt"), lambda f: _pair(f("prompt"), f("completion"))),
    Layout(("answer", "question"), lambda f: _pair(f("question"), f("answer"))),
)


def paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths; elements of an array are ``name[]``."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            name = f"{at}.{f.name}" if at else f.name
            yield name
            yield from paths(f.dataType, name)
    elif isinstance(kind, T.ArrayType):
        yield from paths(kind.elementType, at + "[]")


def fingerprint(names: Iterable[str]) -> str:
    """Hash of sorted field paths."""
    return hashlib.sha256("|".join(sorted(set(names))).encode()).hexdigest()[:16]


# Layouts by the fingerprint of their fields.
MAPPINGS = {fingerprint(layout.fields): layout for layout in LAYOUTS}


def fingerprint_of(found: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Fingerprint of the most specific layout whose field paths are all in an array; NULL if there is none.

    Other paths do not count, so extra fields change nothing.
    """
    told = F.lit(None).cast("string")
    for layout in reversed(layouts):
        own = F.array_sort(F.array_intersect(found, F.array(*[F.lit(n) for n in layout.fields])))
        told = F.when(F.size(own) == len(layout.fields), F.substring(F.sha2(F.array_join(own, "|"), 256), 1, 16)).otherwise(told)
    return told


def layout_of(schema: T.StructType) -> Layout:
    """The layout of a table, looked up by the fingerprint of its nested field paths; an error if it has none."""
    found = set(paths(schema))
    own = next((layout.fields for layout in LAYOUTS if found.issuperset(layout.fields)), ())
    layout = MAPPINGS.get(fingerprint(own))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(found)}")
    return layout


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table in any known layout, chosen by the fingerprint of its schema.

    Extra columns, also ones of other layouts, are not looked at: the most
    specific layout decides, of equal ones the first of ``LAYOUTS``. NULL
    fields are empty texts, and a NULL list has no turns. In the layout with
    one row per turn, rows are gathered per key in the order of their number,
    NULL first; equal numbers by role, then text, so repeated rows stay side by
    side, and NULL keys are a conversation of their own. Other layouts keep
    one row per row. A table of an unknown layout is an error.
    """
    layout = layout_of(df.schema)
    turns = layout.turns(lambda name: F.col(name))
    if layout.order is None:
        return df.select(F.col(key), turns.alias("turns"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(layout.order).alias("order"), turns.alias("turns"))))
    return df.groupBy(F.col(key)).agg(F.flatten(F.transform(rows, lambda r: r["turns"])).alias("turns"))


# Lists of turns in JSON records, and the fields of their elements.
LISTS = {"messages": ("role", "content"), "conversations": ("from", "value")}


def from_json(df: DataFrame, column: str, turns: str = "turns", layout: str = "layout") -> DataFrame:
    """Add canonical turns of JSON records, whose layouts may differ from row to row.

    ``layout`` is the fingerprint of the most specific layout whose paths are
    all there; those inside a list may be in any of its elements. NULL, text
    that is no JSON object, unknown layouts and lists that hold anything but
    objects have NULL turns. Other columns stay, those of these names go.
    """
    text = F.col(column)
    none = F.lit([]).cast("array<string>")
    found = F.coalesce(F.json_object_keys(text), none)
    for name in LISTS:
        items = F.from_json(F.get_json_object(text, f"$.{name}"), "array<map<string,string>>")
        inner = F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), none)))
        inner = F.transform(F.array_distinct(inner), lambda k: F.concat(F.lit(name + "[]."), k))
        found = F.concat(found, F.coalesce(inner, none))
    single = [one for one in LAYOUTS if one.order is None]
    told = fingerprint_of(found, single)
    out = F.lit(None).cast(TURNS)
    for one in single:
        out = F.when(told == fingerprint(one.fields), one.turns(lambda n: _json_field(text, n))).otherwise(out)
    return df.withColumns({layout: told, turns: out})


def _json_field(text: Column, name: str) -> Column:
    field = F.get_json_object(text, f"$.{name}")
    if name not in LISTS:
        return field
    inner = ",".join(f"`{n}`:string" for n in LISTS[name])
    return F.from_json(field, f"array<struct<{inner}>>")


def escape(text: Column) -> Column:
    """Put one more backslash into each control string, so that none is left."""
    for first, rest in CONTROLS.items():
        text = F.regexp_replace(text, rf"({first})(\\*){rest}", r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    for first, rest in CONTROLS.items():
        text = F.regexp_replace(text, rf"({first})\\(\\*){rest}", "$1$2$3")
    return text


def _escape_role(role: Column) -> Column:
    """Roles are one line: backslashes are doubled and line breaks written as ``\\n``."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\"))


def render(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask`` to rows with canonical turns.

    Each turn is the start mark, its role, a line break, its text, the end mark
    and a line break. ``loss_mask`` has one flag per turn: whether its text is
    learned from. NULL or no turns give the empty text and mask. Other columns
    stay; those named like a new one are replaced.
    """
    one = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    listed = F.coalesce(F.col(turns), F.lit([]).cast(TURNS))
    return df.withColumns(
        {
            "formatted": F.array_join(F.transform(listed, one), ""),
            "loss_mask": F.transform(listed, lambda t: t["role"] == learn),
        }
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        text = F.substring(p, cut + 1, F.length(p) - cut - len(END) - 1)
        return F.struct(_unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learned(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.zip_with(read_back(formatted), mask, lambda t, m: F.when(m, t["text"]).otherwise(F.lit("")))
    return F.array_join(kept, "")
