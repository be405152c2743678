"""Chat formatting by schema fingerprints.

Records come in many layouts. A record's fingerprint is the hash of the sorted
nested paths that hold a value, of those that a mapping names; it selects a
declarative mapping, which says where the turns are: single fields (prompt,
response, ...) each said by a role, or a list of messages with role and text
fields. A mapping's paths may lie at the top or within any struct column
(`data.messages[].content`); fields that no mapping names are passed over. The
canonical turns are then written with a template, one piece a turn.

A record whose fingerprint is no mapping's own takes the mapping of most paths
that it fills whole, else the first whose missing fields are all it lacks:
those are null and count as empty texts. A null or empty list has no turns.
Where no mapping fits, turns is null; unknown() counts such records.

Template of a turn: TURN role newline text END newline. Inside role and text
`\\` is written `\\\\`, `<` is `\\l` and `[` is `\\b` (in roles newline is `\\n`), so
no control string survives there, and unescape() gives each text back. A
piece carries the span of its text under the loss mask (assistant turns).

Everything is DataFrame functions. Null text or role is empty; rows with a
null id form one conversation; repeated turns stay, and turns of equal number
are ordered by role and text; an empty table gives no rows. Texts are taken
whole; very long conversations are written piece by piece: only a caller's
digest of a whole conversation needs it in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

TURN, END = "<|turn|>", "<|end|>"
TRAINED = ("assistant",)
#: Other names of the roles (fixed values).
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """fields: (role, field) in order; or items: a list field with the names of
    its role, text and (if any) order fields. aliases: whether its roles may go
    by other names."""

    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    aliases: bool = True

    def paths(self, under: str = "") -> list[str]:
        if self.fields:
            return sorted(under + f for _, f in self.fields)
        return sorted(f"{under}{self.items}[].{x}" for x in (self.role, self.text, self.order) if x)


#: The known layouts.
MAPPINGS = (
    Mapping((("user", "prompt"), ("assistant", "response"))),
    Mapping((("user", "prompt"), ("assistant", "completion"))),
    Mapping((("user", "question"), ("assistant", "answer"))),
    Mapping((("user", "instruction"), ("assistant", "output"))),
    Mapping((("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping((("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping((("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping(items="messages", role="role", text="content"),
    Mapping(items="conversations", role="from", text="value"),
    Mapping(items="turns", role="role", text="text", order="turn", aliases=False),
)


def _paths(name: str, value: Column, kind: T.DataType) -> dict[str, tuple[Column, T.DataType]]:
    """For every nested path its presence (a list has the fields of its items if
    it has items) and type."""
    if isinstance(kind, T.StructType):
        return {p: x for f in kind for p, x in _paths(f"{name}.{f.name}", value.getField(f.name), f.dataType).items()}
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return {f"{name}[].{f.name}": (F.size(value) > 0, f.dataType) for f in kind.elementType}
    return {name: (value.isNotNull(), kind)}


def _structs(name: str, value: Column, kind: T.DataType) -> list[tuple[str, Column]]:
    """The struct columns, at any depth, in which a mapping may lie."""
    if not isinstance(kind, T.StructType):
        return []
    return [(f"{name}.", value), *(x for f in kind for x in _structs(f"{name}.{f.name}", value.getField(f.name), f.dataType))]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fingerprint(present: dict[str, Column], paths: list[str]) -> Column:
    """The hash of those of paths (sorted) that hold a value in the record."""
    held = [F.when(F.coalesce(present[p], F.lit(False)), F.lit(p)) for p in sorted(paths)]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*held)), "\n")) if held else F.xxhash64(F.lit(""))


def fingerprint_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _turns(m: Mapping, at) -> Column:
    """The canonical turns of a record by a mapping; at gives a field's column."""
    said = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    if m.fields:
        return F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), said(at(f)).alias("text")) for k, (r, f) in enumerate(m.fields)])
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = (lambda x: F.coalesce(names[F.lower(x)], x, F.lit(""))) if m.aliases else said
    turn = (lambda x, k: x[m.order].cast("long")) if m.order else (lambda x, k: k.cast("long"))
    made = F.transform(at(m.items), lambda x, k: F.struct(turn(x, k).alias("turn"), role(x[m.role].cast("string")).alias("role"), said(x[m.text]).alias("text")))
    made = F.coalesce(made, F.array().cast(TURNS))
    return F.array_sort(made) if m.order else made


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def canonical_turns(records: DataFrame, key: str) -> DataFrame:
    """key, fingerprint and turns (array of turn, role, text) of records whose
    columns other than key hold one of the known layouts."""
    kinds = {f.name: f.dataType for f in records.schema if f.name != key}
    found = {p: x for c, kind in kinds.items() for p, x in _paths(c, _column(c), kind).items()}
    places = [("", None), *(x for c, kind in kinds.items() for x in _structs(c, _column(c), kind))]
    known = []
    for m in MAPPINGS:
        for under, struct in places:
            paths = m.paths(under)
            if all(p in found and not isinstance(found[p][1], (T.ArrayType, T.MapType)) for p in paths):
                known.append((paths, _turns(m, _column if struct is None else struct.getField).cast(TURNS)))
    named = sorted({p for paths, _ in known for p in paths})
    present = {p: found[p][0] for p in named}
    own = fingerprint(present, named)
    case = None
    for test, order in (
        (lambda paths: own == fingerprint_of(paths), known),
        (lambda paths: fingerprint(present, paths) == fingerprint_of(paths), sorted(known, key=lambda k: -len(k[0]))),
        (lambda paths: fingerprint(present, [p for p in named if p not in paths]) == fingerprint_of([]), known),
    ):
        for paths, turns in order:
            case = F.when(test(paths), turns) if case is None else case.when(test(paths), turns)
    return records.select(_column(key), own.alias("fingerprint"), (F.lit(None).cast(TURNS) if case is None else case).alias("turns"))


def unknown(canonical: DataFrame) -> DataFrame:
    """How many records have a fingerprint without a mapping."""
    return canonical.filter(F.col("turns").isNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column, line: bool = False) -> Column:
    """Pairs of backslashes part the text; no other escape spans them."""
    back = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    whole = (lambda p: F.replace(back(p), F.lit("\\n"), F.lit("\n"))) if line else back
    return F.array_join(F.transform(F.split(text, r"\\\\"), whole), "\\")


def format_turns(canonical: DataFrame, key: str) -> DataFrame:
    """One row a turn: key, nth (from 0), piece, and the loss span in the piece
    (loss_start, loss_end in characters; null outside the mask)."""
    rows = canonical.select(F.col(f"`{key}`"), F.posexplode("turns").alias("nth", "t"))
    role = F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit("\\n"))
    text = escape(F.col("t.text"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    trained = F.col("t.role").isin(*TRAINED)
    start = F.when(trained, F.length(head))
    return rows.select(F.col(f"`{key}`"), F.col("nth").cast("long"), F.concat(head, text, F.lit(END + "\n")).alias("piece"), start.alias("loss_start"), F.when(trained, start + F.length(text)).alias("loss_end"))


def read_pieces(pieces: DataFrame) -> DataFrame:
    """Role, text and loss text (null outside the mask) of formatted pieces."""
    inner = F.expr(f"substring(piece, {len(TURN) + 1}, length(piece) - {len(TURN) + len(END) + 1})")
    cut = F.instr(F.col("_inner"), "\n")
    return (
        pieces.withColumn("_inner", inner)
        .withColumn("role", unescape(F.substring_index("_inner", "\n", 1), line=True))
        .withColumn("text", unescape(F.substring(F.col("_inner"), cut + 1, F.length("_inner"))))
        .withColumn("loss_text", F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("piece"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))))
        .drop("_inner")
    )


def whole(pieces: DataFrame, key: str) -> DataFrame:
    """One row a conversation: formatted, and its loss spans."""
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = F.transform(F.filter("parts", lambda p: p["s"].isNotNull()), lambda p: F.struct((p["at"] + p["s"]).alias("start"), (p["at"] + p["e"]).alias("end")))
    parts = F.array_sort(F.collect_list(F.struct("nth", F.col("at"), F.col("loss_start").alias("s"), F.col("loss_end").alias("e"), "piece")))
    return pieces.withColumn("at", before).groupBy(key).agg(parts.alias("parts")).select(key, F.array_join("parts.piece", "").alias("formatted"), spans.alias("loss_spans"))
