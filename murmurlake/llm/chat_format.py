"""Chat formatting by schema fingerprints: native DataFrame expressions only.

A record is a JSON text of some layout. The nested field paths of its shape are hashed; the hash selects a declared mapping
that turns the layout into canonical turns (role, text). A template then marks turns, and escapes its own control
characters inside roles and texts reversibly, so that no text can end its turn or open another.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout: its shape as field paths, Spark SQL over the variant `v` giving its turns, and, where it lists turns, their fields."""

    name: str
    shape: str
    turns: str
    fields: tuple[str, ...] = ()


def _listed(name: str, field: str, role: str, text: str, also: str = "") -> Layout:
    inner = ", ".join(sorted([role, text, *([also] if also else [])]))
    kinds = f"{role} string, {text} string" + (f", {also} bigint" if also else "")
    order = f"array_sort({{0}}, (x, y) -> int(sign(x.{also} - y.{also})))" if also else "{0}"
    got = order.format(f"variant_get(v, '$.{field}', 'array<struct<{kinds}>>')")
    listed = (role, text, also)
    return Layout(name, f"OBJECT<{field}: ARRAY<OBJECT<{inner}>>>", f"transform({got}, x -> named_struct('role', x.{role}, 'text', x.{text}))", listed)


def _pair(name: str, asks: tuple[str, ...], answer: str, system: str = "") -> Layout:
    fields = sorted([*asks, answer, *([system] if system else [])])
    get = lambda f: f"variant_get(v, '$.{f}', 'string')"
    ask = f"concat_ws('\\n\\n', {', '.join(f"nullif({get(f)}, '')" for f in asks)})"
    turns = [f"named_struct('role', 'system', 'text', {get(system)})"] if system else []
    turns += [f"named_struct('role', 'user', 'text', {ask})", f"named_struct('role', 'assistant', 'text', {get(answer)})"]
    return Layout(name, f"OBJECT<{', '.join(fields)}>", f"array({', '.join(turns)})")


#: The declared mappings. A further layout is one more row here.
LAYOUTS = (
    _listed("turn rows", "turns", "role", "text", also="turn"),
    _listed("turns", "turns", "role", "text"),
    _listed("messages", "messages", "role", "content"),
    _listed("from and value", "conversations", "from", "value"),
    _pair("prompt and completion", ("prompt",), "completion"),
    _pair("prompt and response", ("prompt",), "response"),
    _pair("question and answer", ("question",), "answer"),
    _pair("instruction", ("instruction",), "output"),
    _pair("instruction with input", ("instruction", "input"), "output"),
    _pair("system, prompt and response", ("prompt",), "response", system="system"),
)
#: Names that some data sets give to the three roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, CLOSE = "### ", "</turn>\n"
#: Bytes from which a record that does not parse stops the job. A variant holds 128 MB, and no text becomes 16 times as long.
LARGE = 8 << 20
_CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escaped(c: Column) -> Column:
    """Backslash, <, # and : become two plain characters each; nothing that marks a turn is left."""
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    """The inverse. Each backslash opens a code, so codes can be undone one kind after the other, backslash last."""
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def shape_of(v: Column) -> Column:
    """The nested field paths of a variant: its schema without scalar types and with nulls like any scalar."""
    s = F.schema_of_variant(v)
    s = F.regexp_replace(s, r": DECIMAL\(\d+,\d+\)", "")
    return F.regexp_replace(s, r": (?!OBJECT<|ARRAY<)[A-Z_]+", "")


def _role(c: Column) -> Column:
    names = F.create_map(*[F.lit(y) for kv in ROLE_NAMES.items() for y in kv])
    return F.coalesce(names[F.coalesce(c, F.lit(""))], c, F.lit(""))


def _parts(role: Column, text: Column) -> list[Column]:
    """Of a turn: what stands before its text, the escaped text, whether that is a target."""
    return [F.concat(F.lit(OPEN), escaped(role), F.lit(": ")).alias("head"), escaped(text).alias("body"), (role == "assistant").alias("target")]


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """df with `fingerprint` (64-bit hash of field paths, null for no JSON), `layout` and `turns`.

    Null roles and texts become empty; known other names of the roles become user and assistant. A record of no known
    layout, or that is no JSON, or null, keeps its row with null layout and turns. Empty lists of turns have no element
    to take paths from and count as unknown. A record of more than LARGE bytes that does not parse, as one beyond the size
    of a variant, is an error: it would be lost without a word otherwise. Repeated records are formatted each; an empty table gives no
    rows. Further columns stay, but for those that carry the names of results, which give way.
    """
    text = F.col(f"`{record}`")
    v = F.when(F.octet_length(text) > LARGE, F.parse_json(text)).otherwise(F.try_parse_json(text))
    name = "v"
    while name in df.columns:
        name += "_"
    df = df.withColumn(name, v).withColumn("fingerprint", F.when(F.col(name).isNotNull(), F.xxhash64(shape_of(F.col(name)))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(LAYOUTS):
        hit = F.col("fingerprint") == F.xxhash64(F.lit(x.shape))
        layout, turns = F.when(hit, F.lit(x.name)).otherwise(layout), F.when(hit, F.expr(x.turns.replace("variant_get(v,", f"variant_get({name},")).cast(TURNS)).otherwise(turns)
    clean = F.transform("turns", lambda x: F.struct(_role(x.role).alias("role"), F.coalesce(x.text, F.lit("")).alias("text")))
    return df.withColumns({"layout": layout, "turns": turns}).withColumn("turns", clean).drop(name)


def format_chats(df: DataFrame, record: str = "record") -> DataFrame:
    """canonical_turns plus `formatted` and `loss_runs`.

    formatted: for each turn `### role: text</turn>` and a line end, role and text escaped. loss_runs: for each turn a struct
    (skip, take): of the turn's code points, the first `skip` are no target, the next `take` (an assistant's escaped text,
    0 for other roles) are. No turns give an empty string. One record is one row and must fit in a task's memory.
    """
    df = canonical_turns(df, record)
    return _joined(df.withColumn("parts", F.transform("turns", lambda x: F.struct(*_parts(x.role, x.text)))))


def _joined(df: DataFrame) -> DataFrame:
    """`formatted` and `loss_runs` from `parts`."""
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(CLOSE))), "")
    runs = F.transform("parts", lambda p: F.struct(F.length(p.head).alias("skip"), F.when(p.target, F.length(p.body)).otherwise(0).alias("take")))
    return df.withColumns({"formatted": whole, "loss_runs": runs}).drop("parts")


def read_back(df: DataFrame) -> DataFrame:
    """From `formatted` and `loss_runs` alone: `read_turns` as they were, and `loss_text`, the unescaped text under the mask."""
    pieces = F.split("formatted", CLOSE.replace("<", r"\<"))
    df = df.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    head = len(OPEN)
    turn = lambda p: F.struct(unescaped(F.substring_index(F.substr(p, F.lit(head + 1)), ": ", 1)).alias("role"), unescaped(F.substr(p, F.locate(": ", p, head) + F.lit(2))).alias("text"))
    loss = F.zip_with("pieces", "loss_runs", lambda p, r: F.substr(p, r.skip + F.lit(1), r["take"]))
    return df.withColumns({"read_turns": F.transform("pieces", turn), "loss_text": F.array_join(F.transform(loss, unescaped), "")}).drop("pieces")


def layout_of_rows(rows: DataFrame, key: str = "conv_id") -> Layout:
    """The declared layout whose listed turns have the field paths of the table's rows without `key`, by the hash of these paths."""
    paths = sorted(n for n in rows.columns if n != key)
    declared = {xxhash.xxh64_intdigest(", ".join(sorted(f for f in x.fields if f)), 42): x for x in reversed(LAYOUTS) if x.fields}
    found = declared.get(xxhash.xxh64_intdigest(", ".join(paths), 42))
    if found is None:
        raise ValueError(f"no declared layout has turns of the fields {paths}")
    return found


def format_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """A table with one row for each turn, of any declared layout that lists turns, as format_chats gives records: (key, fingerprint,
    layout, formatted, loss_runs).

    The schema is the same for all rows, so its field paths are hashed once and select the mapping; no JSON or variant is made, and
    a conversation may be as long as a string can (2 GB); a longer one is an error. Turns are formatted row by row and then joined in
    order of (turn number, role, text); a layout without turn numbers in order of (role, text). Null roles and texts are empty, null keys
    are one conversation, repeated rows are turns each. Fields of no declared layout are an error: select those of the layout.
    """
    layout = layout_of_rows(rows, key)
    named = [F.col(f"`{n}`") if n else F.lit(0) for n in layout.fields]
    role, text = F.coalesce(named[0].cast("string"), F.lit("")), F.coalesce(named[1].cast("string"), F.lit(""))
    turn = F.struct(named[2].cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), *_parts(_role(role), text))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("parts"))
    return _joined(grouped.withColumns({"fingerprint": F.xxhash64(F.lit(layout.shape)), "layout": F.lit(layout.name)}))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one JSON record for each conv_id, its turns in order of (turn, role, text)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ordered = F.transform("turns", lambda x, i: F.struct(F.coalesce(i.cast("bigint"), F.lit(0)).alias("turn"), x.role.alias("role"), x.text.alias("text")))
    return grouped.select("conv_id", F.to_json(F.struct(ordered.alias("turns"))).alias("record"))
