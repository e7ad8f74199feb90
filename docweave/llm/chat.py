"""Chat formatting by schema fingerprints.

A source's layout is known by the nested paths of the fields it has, like
``messages[].role``. The paths that some layout knows are sorted and hashed;
the fingerprint selects a declarative mapping to canonical turns (position,
role, text). ``from_frame`` reads typed tables, whose schema is fingerprinted
once; ``from_json`` reads JSON records of mixed layouts, fingerprinted record by record. Both use the same layouts.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
texts and roles every ``<|`` gets a backslash (``<\\|``, and one more where
there are some already), so no control string can arise in a text and the
step can be undone. The loss mask is a list of spans (turn number, first
code point in the turn's block, length) that cover the assistant's texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LEARN = "assistant"
#: Names that sources use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<position:long,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``items``: (array, role field, text field). ``fields``: (role, fields
    whose non-empty texts are joined by an empty line). ``rows``: (id,
    position, role, text) of a table with a row for each turn."""

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.items:
            array, role, text = self.items
            return sorted([f"{array}[].{role}", f"{array}[].{text}"])
        return sorted(f for _, names in self.fields for f in names)


LAYOUTS = (
    Layout("rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("dialog", items=("dialog", "speaker", "text")),
    Layout("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _known(layouts) -> tuple[list[str], dict[str, set[str]]]:
    """Top-level scalar fields and, for each array, the item fields that some layout knows."""
    scalars = sorted({f for x in layouts for f in x.paths if "[]." not in f})
    arrays: dict[str, set[str]] = {}
    for x in layouts:
        if x.items:
            arrays.setdefault(x.items[0], set()).update(x.items[1:])
    return scalars, arrays


def frame_paths(schema: T.StructType, layouts=LAYOUTS) -> list[str]:
    """Nested paths of a schema, as far as some layout knows them."""
    scalars, arrays = _known(layouts)
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            own = {x.name for x in f.dataType.elementType.fields}
            out += [f"{f.name}[].{x}" for x in sorted(own & arrays.get(f.name, set()))]
        elif f.name in scalars:
            out.append(f.name)
    return sorted(out)


def layout_of(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout with the schema's fingerprint. Where known fields of other
    layouts are there too, the first layout that has all its paths."""
    paths = frame_paths(schema, layouts)
    by_print = {fingerprint(x.paths): x for x in layouts}
    if found := by_print.get(fingerprint(paths)):
        return found
    for x in layouts:
        if set(x.paths) <= set(paths):
            return x
    raise ValueError(f"no layout has the fields {paths}")


def _role(col: Column) -> Column:
    return reduce(lambda c, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(c), ROLES.items(), F.coalesce(col, F.lit("")))


def _turn(position, role: Column, text: Column) -> Column:
    return F.struct(position.cast("long").alias("position"), role.cast("string").alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: Layout, get, item) -> Column:
    """Canonical turns of a record; ``get`` reads a field as text, ``item`` an
    array of (role, text) structs."""
    if layout.items:
        array = F.coalesce(item(*layout.items), F.array().cast("array<struct<role:string,text:string>>"))
        return F.transform(array, lambda x, i: _turn(i, _role(x["role"]), x["text"]))
    turns = []
    for k, (role, names) in enumerate(layout.fields):
        parts = F.filter(F.array(*[get(n) for n in names]), lambda x: x.isNotNull() & (x != "")) if len(names) > 1 else None
        turns.append(_turn(F.lit(k), F.lit(role), get(names[0]) if parts is None else F.array_join(parts, "\n\n")))
    return F.array(*turns)


def from_frame(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """``conv_id, layout, turns`` of a typed table. In a table with a row for
    each turn, roles stay as they are and turns are in order of position, null
    first, then role and text; rows that repeat stay. In other tables a row is
    a conversation and roles get their canonical names.

    Null roles and texts are empty; rows with a null id are one conversation
    (in a table of turns) or one each; an empty table gives no rows; columns
    that the layout does not name are not read."""
    layout = layout_of(df.schema, layouts)
    if layout.rows:
        conv, position, role, text = layout.rows
        rows = df.select(F.col(conv).cast("long").alias("conv_id"),
                         _turn(F.col(position), F.coalesce(F.col(role).cast("string"), F.lit("")), F.col(text)).alias("turn"))
        return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
                .select("conv_id", F.lit(layout.name).alias("layout"), "turns"))

    def item(array, role, text):
        return F.transform(F.col(array), lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.lit(layout.name).alias("layout"),
                     _mapped(layout, lambda n: F.col(n).cast("string"), item).alias("turns"))


def _under(array: str):
    return lambda field: F.concat(F.lit(f"{array}[]."), field)


def from_json(df: DataFrame, record_col: str, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """``conv_id, fingerprint, layout, turns`` of JSON records, each by its own
    fingerprint; where known fields of other layouts are there too, by the
    first layout that has all its paths, as a typed table (``layout_of``).

    A record that is null, malformed or has no layout's paths has a null
    layout and null turns; a null id is carried; repeated records stay; an
    empty table gives no rows; other columns are not read."""
    layouts = [x for x in layouts if not x.rows]
    scalars, arrays = _known(layouts)
    v = F.try_parse_json(F.col(record_col))

    def shape(name):
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    paths = [F.when(shape(n).isNotNull() & (shape(n) != "VOID"), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
             for n in scalars]
    for name, fields in arrays.items():
        own = F.array_intersect(F.regexp_extract_all(shape(name), F.lit(r"(\w+): "), 1), F.array(*map(F.lit, sorted(fields))))
        own = F.transform(own, _under(name))
        paths.append(F.when(shape(name).startswith("ARRAY<OBJECT<"), own).otherwise(F.array().cast("array<string>")))
    found = F.array_sort(F.flatten(F.array(*paths)))
    digest = F.sha2(F.array_join("paths", "\n"), 256)

    def get(name):
        return F.try_variant_get(v, f"$.{name}", "string")

    def item(array, role, text):
        got = F.try_variant_get(v, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(got, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))
    turns, named = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.when(v.isNotNull(), found).alias("paths"), F.col(record_col))
    rows = rows.select("conv_id", "paths", digest.alias("fingerprint"), F.col(record_col))
    exact = F.col("fingerprint").isin([fingerprint(x.paths) for x in layouts])
    for x in reversed(layouts):                 # of several that fit, the first one's is kept
        fits = F.size(F.array_except(F.array(*map(F.lit, x.paths)), F.col("paths"))) == 0
        hit = F.when(exact, F.col("fingerprint") == fingerprint(x.paths)).otherwise(fits)
        turns = F.when(hit, _mapped(x, get, item)).otherwise(turns)
        named = F.when(hit, F.lit(x.name)).otherwise(named)
    return rows.select("conv_id", "fingerprint", named.alias("layout"), turns.alias("turns"))


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", "<$1|")


def _escape_role(col: Column) -> Column:
    return escape(F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(col: Column) -> Column:
    return F.replace(F.replace(unescape(col), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(convs: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of ``(conv_id, turns)``. Null or
    empty turns give an empty text and mask."""
    turns = F.coalesce("turns", F.array().cast(TURNS))
    safe = F.transform(turns, lambda t: F.struct(_escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"),
                                                 (t["role"] == LEARN).alias("learn")))
    convs = convs.select("conv_id", safe.alias("safe"))
    block = F.transform("safe", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    spans = F.transform("safe", lambda t, i: F.struct(
        i.alias("turn"), (F.char_length(t["role"]) + 1).alias("start"), F.char_length(t["text"]).alias("length"), t["learn"].alias("learn")))
    spans = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    return convs.select("conv_id", F.array_join(block, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id, turns, loss`` from the formatted text and the mask alone:
    turns are structs of role and text; loss is the list of texts under the
    mask, unescaped."""
    mark = F.split("formatted", r"<\|im_start\|>")
    blocks = F.slice(mark, F.lit(2), F.greatest(F.size(mark) - 1, F.lit(0)))
    tail = len(END) + 1

    def turn(b):
        head = F.substring_index(b, "\n", 1)
        n = F.char_length(head)
        return F.struct(_unescape_role(head).alias("role"),
                        unescape(F.substring(b, n + 2, F.char_length(b) - n - 1 - tail)).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("blocks", s["turn"]), s["start"] + 1, s["length"])))
    return (chats.withColumn("blocks", blocks)
            .select("conv_id", "formatted", F.transform("blocks", turn).alias("turns"), loss.alias("loss")))
