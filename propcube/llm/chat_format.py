"""Chat formatting by schema fingerprints.

Every layout of conversations is named by a fingerprint: the hash of its
sorted nested field paths, as far as some known layout uses them (other fields
are ignored). A fingerprint selects a declarative mapping (which path holds the
turns, which fields are the prompt, the input and the answer, or which columns
make a table with a row for each turn), and the mapping makes canonical turns:
array<struct<role, text>>. ``canonical`` does this for a typed table, by its
schema; ``canonical_json`` for a column of JSON objects of mixed layouts, row by
row. ``layout`` names the mapping; ``unknown_layouts`` counts rows without one.

Template: each turn is ``<s>[INST]role[/INST]text</s>``. A control string
inside a role or text gets a backslash after its first character, and one that
already looks so gets one more, so texts never contain a control string and
reading back restores them exactly. Loss spans cover the assistant's texts.

All steps are DataFrame functions. Defined results: null role or text is
empty; equal turn numbers are ordered by role, then text; a null turn number
comes first; a null id is a conversation of its own; a conversation without
turns formats to the empty text; an unknown layout gives null turns, and they
format to null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<role:string,text:string>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\])"
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: ``turns`` with its ``role`` and ``text``
    fields, or (field, role) pairs in order (``join`` names fields whose text
    is appended to the one before, after a blank line), or ``order``: a row is
    one turn of its conversation, with columns ``role`` and ``text``."""
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    join: tuple[str, ...] = ()
    order: str = ""

    def paths(self) -> tuple[str, ...]:
        if self.order:
            return tuple(sorted((self.order, self.role, self.text)))
        if self.turns:
            return tuple(sorted((f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")))
        return tuple(sorted([f for f, _ in self.fields] + list(self.join)))

    def apply(self, col) -> Column:
        """Canonical turns; ``col(path)`` gives a field of the row."""
        if self.turns:
            return F.transform(col(self.turns), lambda t: turn(t[self.role], t[self.text]))
        parts = []
        for field, role in self.fields:
            text = F.coalesce(col(field), F.lit(""))
            for more in self.join if role == "user" else ():
                extra = F.coalesce(col(more), F.lit(""))
                text = F.when(extra != "", F.concat(text, F.lit("\n\n"), extra)).otherwise(text)
            parts.append((field, role, turn(F.lit(role), text)))
        given = F.array(*[F.when((F.lit(role) != "system") | (F.coalesce(col(f), F.lit("")) != ""), t)
                          for f, role, t in parts])
        return F.filter(given, lambda t: t.isNotNull())


#: The layouts that are known, by name.
MAPPINGS = {
    "turn_rows": Mapping(role="role", text="text", order="turn"),
    "messages": Mapping("messages", "role", "content"),
    "conversations": Mapping("conversations", "from", "value"),
    "turns": Mapping("turns", "role", "text"),
    "instruction": Mapping(fields=(("instruction", "user"), ("output", "assistant"))),
    "instruction_input": Mapping(fields=(("instruction", "user"), ("output", "assistant")), join=("input",)),
    "prompt": Mapping(fields=(("prompt", "user"), ("response", "assistant"))),
    "completion": Mapping(fields=(("prompt", "user"), ("completion", "assistant"))),
    "question": Mapping(fields=(("question", "user"), ("answer", "assistant"))),
    "system_prompt": Mapping(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
}


def turn(role: Column, text: Column) -> Column:
    low = F.coalesce(role.cast("string"), F.lit(""))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), low), low)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; elements of arrays are ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    import hashlib
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths()): name for name, m in MAPPINGS.items()}
#: The paths that some layout uses.
KNOWN = sorted({p for m in MAPPINGS.values() for p in m.paths()})


def canonical(df: DataFrame, id_col: str) -> DataFrame:
    """(conv_id, turns, layout) of a typed table; the fingerprint of its other
    columns' known paths selects the mapping."""
    paths = [p for p in schema_paths(df.drop(id_col).schema) if p in KNOWN]
    name = BY_FINGERPRINT.get(fingerprint(paths))
    mapping = MAPPINGS.get(name)
    if mapping and mapping.order:
        return gathered(df, id_col, mapping).withColumn("layout", F.lit(name))
    turns = mapping.apply(lambda p: F.col(p)) if mapping else F.lit(None).cast(f"array<{TURN}>")
    return df.select(F.col(id_col).alias("conv_id"), turns.cast(f"array<{TURN}>").alias("turns"),
                     F.lit(name).cast("string").alias("layout"))


def unknown_layouts(conversations: DataFrame) -> DataFrame:
    """(unknown, total): rows whose layout is not known, of all."""
    return conversations.agg(F.count_if(F.col("layout").isNull()).alias("unknown"), F.count(F.lit(1)).alias("total"))


def gathered(df: DataFrame, id_col: str, m: Mapping) -> DataFrame:
    """Turn rows to one row per conversation; roles stay as they are."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.struct(F.col(m.order).alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("role", m.role), ("text", m.text))]).alias("t"))
    every = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return every.select("conv_id", F.transform("ts", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def json_fingerprint(col: Column) -> Column:
    """Fingerprint of a JSON object's own known paths; null if it is none."""
    keys = F.json_object_keys(F.when(F.try_parse_json(col).isNotNull(), col))
    none = F.array().cast("array<string>")

    def inside(name: str) -> Column:  # fields of the elements of a list
        elements = F.from_json(F.get_json_object(col, f"$.{name}"), "array<map<string,string>>")
        fields = F.flatten(F.transform(elements, lambda e: F.coalesce(F.map_keys(e), none)))
        return F.coalesce(F.transform(fields, lambda k: F.concat(F.lit(f"{name}[]."), k)), none)

    lists = sorted({m.turns for m in MAPPINGS.values() if m.turns})
    paths = F.array_intersect(F.concat(keys, *map(inside, lists)), F.array(*[F.lit(p) for p in KNOWN]))
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turns, layout) of rows whose layouts differ; unknown ones have
    null turns."""
    found, layout = F.lit(None).cast(f"array<{TURN}>"), F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("__json")).withColumn("__print", json_fingerprint(F.col("__json")))
    for name, m in MAPPINGS.items():
        if m.order:
            continue  # a JSON object is a whole conversation
        if m.turns:
            kind = f"struct<{m.turns}:array<struct<`{m.role}`:string,`{m.text}`:string>>>"
        else:
            kind = f"struct<{','.join(f'`{f}`:string' for f in m.paths())}>"
        parsed = F.from_json(F.col("__json"), kind)
        made = m.apply(lambda p, parsed=parsed: parsed[p]).cast(f"array<{TURN}>")
        own = F.col("__print") == fingerprint(m.paths())
        found, layout = F.when(own, made).otherwise(found), F.when(own, F.lit(name)).otherwise(layout)
    return rows.select("conv_id", found.alias("turns"), layout.alias("layout"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the text and the [start, end) code points
    of the assistant's texts in it."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn")))
    rows = conversations.select("conv_id", pieces.alias("p"))
    # running lengths: where each turn's body starts, without joining strings again and again
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    rows = rows.withColumn("sizes", F.transform("p", size))
    ends = F.aggregate("sizes", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    rows = rows.withColumn("at", ends)
    spans = F.transform("p", lambda x, i: F.struct(
        (F.get("at", i) + F.length(x["head"])).alias("start"),
        (F.get("at", i) + F.length(x["head"]) + F.length(x["body"])).alias("end"), x["learn"].alias("learn")))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"]))
    return rows.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """Turns from a formatted text: split at the marks, which cannot occur
    inside roles or texts, then unescape."""
    parts = F.split(text, r"<s>\[INST\]", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(
        unescape(F.substring_index(p, ROLE_END, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, ROLE_END) + len(ROLE_END),
                             F.length(p) - F.instr(p, ROLE_END) - len(ROLE_END) - len(CLOSE) + 1)).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(made: DataFrame) -> DataFrame:
    """What a formatted table says when read back."""
    rows = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                       read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
