"""Deeply nested records as related flat tables: structural variants found by a tree automaton.

A bottom-up tree automaton runs while the JSON text is parsed: every object is left as soon as its fields are
known, and its state is computed from its labels and the states of what they hold. States are canonical
strings, hence the same in every task: 't' a text, 'T' a list of texts, '-' nothing (null, absent, empty), '{..}' an
object with the states of its fields, '[..]' a list with the distinct states in it. Beside its state an object keeps
that state's first layer, the states of its fields, and by this it is routed to its level's subtype.

From the root the levels of interest are then walked top-down. Every object on a level becomes a row with the
supertype's keys (record, level, own and ancestors' places, parent's node id), its subtype and its texts.
write_typed() routes the rows of one parse to one table per level and subtype.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The levels of a law body, from the outermost, and each level's text and number fields.
LEVELS = ("조문단위", "항", "호", "목")
LEVEL_FIELDS = {
    "조문단위": ("조문내용", "조문번호"),
    "항": ("항내용", "항번호"),
    "호": ("호내용", "호번호"),
    "목": ("목내용", "목번호"),
}
ROOT_PATH = ("법령", "조문")
UNIT_FLAG = "조문여부"
UNIT_TITLE = "조문제목"
BRANCH = "조문가지번호"

# The short place names of the four levels in the results.
PLACES = ("jo_pos", "hang_pos", "ho_pos", "mok_pos")

STATE_CHARS = 4096  # longer states are known by their hash, so that depth doesn't square memory

_SPACE = re.compile(r"\s+")


def clean_key(key: str) -> str:
    return _SPACE.sub("", key)


def plain_text(value) -> str | None:
    """Text of a scalar, a list (joined by line ends, at any depth) or an object's 'content'; entities resolved, outer white space cut; null for nothing."""
    if value is None:
        return None
    if isinstance(value, (Shape, list)):
        lines, stack = [], [value]
        while stack:  # depth isn't bounded
            v = stack.pop()
            if isinstance(v, Shape):
                stack.append(v.fields.get("content"))
            elif isinstance(v, list):
                stack.extend(reversed(v))
            elif t := plain_text(v):
                lines.append(t)
        return "\n".join(lines) or None
    text = html.unescape(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)).replace(" ", " ")
    return re.sub(r"[ \t]+\n", "\n", text).strip() or None


@dataclass(slots=True)
class Shape:
    """An object in the automaton: its cleaned fields, its state, and that state's first layer {label: state}."""

    fields: dict
    state: str
    layer: dict


def field_kind(shape: Shape, label: str) -> str:
    """A field's kind by its state: '-' nothing, 't' a text, 'o' an object, 'T' a list of texts, 'm' a list in which objects are, 'l' another list."""
    state, value = shape.layer.get(label, "-"), shape.fields.get(label)
    if state in ("-", "t", "T"):
        return state
    if isinstance(value, Shape):
        return "o"
    return "m" if any(isinstance(x, Shape) for x in value) else "l"


def state_of(value) -> str:
    if isinstance(value, Shape):
        return value.state
    if value is None or value == "" or value == []:
        return "-"
    if isinstance(value, list):
        open_lists: list[tuple[Iterator, set[str]]] = [(iter(value), set())]
        while True:  # depth isn't bounded
            rest, kinds = open_lists[-1]
            for x in rest:
                if isinstance(x, list) and x:
                    open_lists.append((iter(x), set()))
                    break
                kinds.add(state_of(x))
            else:
                open_lists.pop()
                kinds = sorted(kinds - {"-"})
                state = "T" if kinds == ["t"] else _bounded("[" + "|".join(kinds) + "]")
                if not open_lists:
                    return state
                open_lists[-1][1].add(state)
    return "t"


def _bounded(state: str) -> str:
    return state if len(state) <= STATE_CHARS else "#" + hashlib.sha256(state.encode("utf-8", "surrogatepass")).hexdigest()


def leave_object(pairs: list[tuple[str, object]]) -> Shape:
    """The automaton's transition, called for each object after all it holds: labels without white space (a later label of the same name wins) and their states; fields that hold nothing don't count."""
    fields = {clean_key(k): v for k, v in pairs}
    states = {k: s for k, v in fields.items() if (s := state_of(v)) != "-"}
    return Shape(fields, _bounded("{" + ",".join(sorted(f"{k}:{s}" for k, s in states.items())) + "}"), states)


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def _load_deep(text: str):
    """What json.loads gives with leave_object, without recursion; ValueError for what isn't complete JSON."""
    holders: list[list] = []  # of open lists their members, of open objects their (label, value) pairs
    labels: list[str | None] = []  # the label that waits for its value; None in lists
    n, i = len(text), 0
    skip = lambda k: _BLANK.match(text, k).end()

    def label(k: int) -> tuple[str, int]:
        if text[k : k + 1] != '"':
            raise ValueError("no label")
        name, k = json.decoder.scanstring(text, k + 1, True)
        k = skip(k)
        if text[k : k + 1] != ":":
            raise ValueError("no colon")
        return name, skip(k + 1)

    i = skip(i)
    while True:
        c = text[i : i + 1]
        if c in ("[", "{") and c:
            i = skip(i + 1)
            if text[i : i + 1] != ("]" if c == "[" else "}"):
                name = None
                if c == "{":
                    name, i = label(i)
                holders.append([])
                labels.append(name)
                continue
            value, i = [] if c == "[" else leave_object([]), i + 1
        elif c == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
        elif m := _SCALAR.match(text, i):
            value, i = json.loads(m.group()), m.end()
        else:
            raise ValueError("no value")
        while True:  # the value goes into what holds it; what ends with it goes on in turn
            i = skip(i)
            if not holders:
                if i != n:
                    raise ValueError("more text")
                return value
            of_object = labels[-1] is not None
            holders[-1].append((labels[-1], value) if of_object else value)
            c = text[i : i + 1]
            i = skip(i + 1)
            if c == ",":
                if of_object:
                    labels[-1], i = label(i)
                break
            if c != ("}" if of_object else "]"):
                raise ValueError("torn")
            value = holders.pop()
            labels.pop()
            value = leave_object(value) if of_object else value


def load_body(text: str):
    """The JSON of a body, its objects as Shapes, however deep; ValueError for what isn't complete JSON."""
    try:
        return json.loads(text, object_pairs_hook=leave_object)
    except RecursionError:
        return _load_deep(text)


def subtype(level: int, shape: Shape) -> str:
    """The subtype of an object of a level, read off its state's first layer: what text it has and what is below it.

    '전문' heads (units that aren't articles) are of their own kind, told by their flag. Below: 'one' a lone object, 'many' a list.
    """
    text, _ = LEVEL_FIELDS[LEVELS[level]]
    kind = "head" if level == 0 and plain_text(shape.fields.get(UNIT_FLAG)) not in (None, "조문") else "item"
    has = {"-": "bare", "t": "text"}.get(field_kind(shape, text), "texts")
    if level + 1 == len(LEVELS):
        return f"{kind}_{has}"
    below = {"o": "one", "m": "many"}.get(field_kind(shape, LEVELS[level + 1]), "leaf")
    return f"{kind}_{has}_{below}"


def _members(value) -> Iterator[tuple[int, Shape]]:
    """Objects with their places from 1; a lone object is 1; in a list, what isn't an object keeps its place but gives nothing."""
    if isinstance(value, Shape):
        yield 1, value
    elif isinstance(value, list):
        yield from ((i, x) for i, x in enumerate(value, 1) if isinstance(x, Shape))


def readable(body: str | None):
    """The JSON of a record's text; None for null, torn or foreign texts."""
    try:
        return load_body(body) if body else None
    except ValueError:
        return None


def walk(body: str | None) -> Iterator[tuple]:
    """Rows (level, places, shape) of one record's text; nothing for null, torn or foreign texts."""
    return walk_root(readable(body))


def walk_root(root) -> Iterator[tuple]:
    tops = [root]
    for label in ROOT_PATH:
        tops = [x for t in tops if isinstance(t, Shape) for _, x in _members(t.fields.get(label))]
    stack = [(0, (), t) for t in reversed(tops)]
    while stack:
        level, places, holder = stack.pop()
        for place, shape in _members(holder.fields.get(LEVELS[level])):
            at = (*places, place)
            yield level, at, shape
            if level + 1 < len(LEVELS):
                stack.append((level + 1, at, shape))


NODE_SCHEMA = "record_id long, node_level string, subtype string, state string, jo_pos int, hang_pos int, ho_pos int, mok_pos int, node_id string, parent_id string, label_no string, branch_no string, flag string, title string, text string"
_ARROW = pa.schema([("record_id", pa.int64()), *[(n, pa.string()) for n in ("node_level", "subtype", "state")], *[(p, pa.int32()) for p in PLACES], *[(n, pa.string()) for n in ("node_id", "parent_id", "label_no", "branch_no", "flag", "title", "text")]])
BATCH_ROWS = 20_000


def _node_id(record, at: tuple[int, ...]) -> str:
    return f"{record}:" + ".".join(map(str, at))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for record, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for level, at, shape in walk(body.as_py()):
                text, number = (plain_text(shape.fields.get(f)) for f in LEVEL_FIELDS[LEVELS[level]])
                unit = [plain_text(shape.fields.get(f)) for f in (BRANCH, UNIT_FLAG, UNIT_TITLE)] if level == 0 else [None] * 3
                rows.append((record, LEVELS[level], subtype(level, shape), shape.state, *(at + (0,) * (4 - len(at))), _node_id(record, at), _node_id(record, at[:-1]) if level else None, number, *unit, text))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def nested_nodes(records: DataFrame, record_id: str, body: str) -> DataFrame:
    """The supertype table: one row per object of the four levels, without any shuffle.

    Null ids are kept as ids of their own kind (null); repeated rows give repeated nodes; empty tables give none; a
    record is handled in one piece, however deep or long, since JSON can't be cut before it's parsed. state tells the
    automaton's state in full, subtype what it's routed by.
    """
    return records.select(F.col(record_id).cast("long").alias("record_id"), F.col(body).cast("string").alias("body")).mapInArrow(_parse, NODE_SCHEMA)


def subtypes(level: int) -> list[str]:
    """The names of a level's subtypes: a fixed, finite set, as a state's first layer has finitely many kinds."""
    lasts = [""] if level + 1 == len(LEVELS) else ["_leaf", "_one", "_many"]
    return [f"{kind}_{has}{last}" for kind in ("item", "head")[: 1 + (level == 0)] for has in ("bare", "text", "texts") for last in lasts]


def write_typed(nodes: DataFrame, root: str) -> None:
    """Route the rows of nested_nodes to one folder a level and subtype under root, in one pass."""
    nodes.write.partitionBy("node_level", "subtype").parquet(root)


def typed_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """One table a level and, beneath it, one a subtype ('항/item_text_many') of what write_typed wrote; all keep node_id and parent_id.

    Each reads its own folders only, and the columns that its type has; a subtype that never occurred is an empty table.
    """
    schema = T.StructType.fromDDL(NODE_SCHEMA)
    schema = T.StructType([*[f for f in schema if f.name not in ("node_level", "subtype")], schema["node_level"], schema["subtype"]])
    nodes = spark.read.schema(schema).parquet(root)
    out = {}
    for level, name in enumerate(LEVELS):
        common = ["record_id", "node_id", *(["parent_id"] if level else []), *PLACES[: level + 1]]
        own = ["label_no", *([] if level else ["branch_no", "flag", "title"]), "text"]
        table = nodes.where(F.col("node_level") == name)
        out[name] = table.select(*common, "subtype", *own)
        for sub in subtypes(level):
            out[f"{name}/{sub}"] = table.where(F.col("subtype") == sub).select(*common, *[f for f in own if not (f == "text" and "_bare" in sub)])
    return out
