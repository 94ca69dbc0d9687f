"""Chat formatting: heterogeneous records to canonical turns to a marked-up text with a loss mask.

A record's schema is fingerprinted: a hash of its sorted nested field paths selects a declarative mapping
(data, not code) which says where turns, roles and texts are. Turns are then rendered by a template whose
control strings cannot occur inside texts: they are escaped there, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Where the canonical parts of a record are.

    paths: those that a record must have; it may have others. items: the path of an array of turns, or None.
    role, text: fields of a turn. fixed: (role, path) pairs for records with one field for each turn; further paths
    in a tuple are joined by a blank line, empty ones left out. roles: renames of roles. turn: for records that are
    one turn each, the field with its place.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    turn: str | None = None


#: Layouts known at the start; callers may pass more.
LAYOUTS = (
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_only", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("messages", ("messages[].content", "messages[].role"), items="messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("row", ("role", "text", "turn"), text="text", turn="turn"),
)


#: Fingerprints that a worker remembers.
MOST_KNOWN = 10_000


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """A hash of the set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def field_paths(value: object) -> list[str]:
    """The paths of all leaves of a parsed record; ``[]`` stands for the items of an array, ``[0]`` for one without any, ``{}`` for an object without fields.

    Walked with a stack of its own, so that nesting of any depth is read.
    """
    out, open_ = [], [("", value)]
    while open_:
        prefix, v = open_.pop()
        if isinstance(v, dict) and v:
            open_ += [(f"{prefix}.{k}" if prefix else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            open_ += [(f"{prefix}[]", x) for x in v]
        else:
            out.append(prefix + ("[0]" if isinstance(v, list) else "{}" if isinstance(v, dict) else ""))
    return out


def _fits(layout: Layout, paths: set[str]) -> bool:
    """All of the layout's paths are there and are leaves, and its items are objects; an empty array of items fits as well."""
    if layout.items is not None and {p for p in paths if p == layout.items or p.startswith((f"{layout.items}[", f"{layout.items}."))} == {f"{layout.items}[0]"}:
        return True
    if not paths.issuperset(layout.paths) or any(p.startswith((f"{q}.", f"{q}[", f"{q}{{")) for p in paths for q in layout.paths):
        return False
    return layout.items is None or all(p.startswith(f"{layout.items}[].") for p in paths if p == layout.items or p.startswith(f"{layout.items}["))


def layout_of(paths: list[str], layouts: tuple[Layout, ...], known: dict[str, Layout | None]) -> Layout | None:
    """The layout of these paths' fingerprint: of those that fit one with turns, then the one with the most paths, then the first. ``known`` remembers fingerprints."""
    mark = fingerprint(paths)
    if mark not in known:
        if len(known) >= MOST_KNOWN:
            known.clear()
        known[mark] = max((x for x in layouts if _fits(x, set(paths))), key=lambda x: (set(paths).issuperset(x.paths), len(x.paths)), default=None)
    return known[mark]


def _said(value: object) -> str:
    """A leaf as text: null is empty, numbers and truth values are as in JSON, half of a surrogate pair is U+FFFD."""
    if value is None:
        return ""
    out = value if isinstance(value, str) else json.dumps(value)
    return out if out.isascii() else out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    rename = dict(layout.roles)
    if layout.turn is not None:
        role, said = _said(record.get(layout.role)), _said(record.get(layout.text))
        return [(rename.get(role, role), said)]
    if layout.items is not None:
        both = [(_said(t.get(layout.role)), _said(t.get(layout.text))) for t in record.get(layout.items) or []]
        return [(rename.get(role, role), said) for role, said in both]
    # Behind the first part empty ones are left out; a single part stays as it is.
    return [(role, "\n\n".join(x for x in (_said(record.get(p)) for p in paths) if x)) for role, paths in layout.fixed]


def _parsed(text: str | None) -> object:
    """The JSON value of ``text``; None where it is none, or is nested deeper than the parser goes."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """conv_id, turn, role, text of records that are JSON texts of any known layout.

    Null fields are empty texts, numbers and truth values their JSON text, fields that the layout does not name are
    ignored; a turn that is no 64-bit whole number is null. A record without turns (an empty array), a null or
    malformed one, one that is no object, one that is nested deeper than the parser goes, and one of no known layout
    give no turn: :func:`unmapped` lists the last four kinds. Repeated records are turned into turns one by one; an
    empty table gives an empty one; further columns are ignored.
    """

    def run(batches):
        known: dict[str, Layout | None] = {}
        for pdf in batches:
            rows = []
            for cid, text in zip(pdf["conv_id"].astype("Int64"), pdf["record"], strict=True):
                value = _parsed(text)
                layout = layout_of(field_paths(value), layouts, known) if isinstance(value, dict) else None
                if layout:
                    at = value.get(layout.turn) if layout.turn is not None else 0
                    first = at if isinstance(at, int) and not isinstance(at, bool) and -(1 << 63) <= at < 1 << 63 else None
                    rows += [(cid, first if first is None else first + i, r, t) for i, (r, t) in enumerate(_turns(value, layout))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pd.DataFrame({"conv_id": pd.array(cols[0], "Int64"), "turn": pd.array(cols[1], "Int64"), "role": pd.Series(cols[2], dtype=object), "text": pd.Series(cols[3], dtype=object)})

    return records.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(record).alias("record")).mapInPandas(run, "conv_id long, turn long, role string, text string")


def table_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn: its columns' fingerprint selects the layout, for all rows at once.

    Null roles and texts stay null; a table that no layout of single turns fits is refused.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    paths = [f"{x.name}[]" if isinstance(x.dataType, nested) else x.name for x in rows.schema if x.name != conv_id]
    layout = layout_of(paths, tuple(x for x in layouts if x.turn is not None), {})
    if layout is None:
        raise ValueError(f"no layout fits the columns {', '.join(rows.columns)}")
    role = F.col(layout.role)
    renamed = F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in layout.roles], role)
    return rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(layout.turn).cast("long").alias("turn"), renamed.alias("role"), F.col(layout.text).alias("text"))


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, record: str = "record") -> DataFrame:
    """The records that no layout fits, with their fingerprint (null where they are no objects, or cannot be parsed).

    A column ``fingerprint`` of ``records`` is replaced.
    """

    @F.pandas_udf("fingerprint string, fits boolean")
    def print_of(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, Layout | None] = {}
        rows = []
        for text in texts:
            value = _parsed(text)
            paths = field_paths(value) if isinstance(value, dict) else None
            rows.append((None, False) if paths is None else (fingerprint(paths), layout_of(paths, layouts, known) is not None))
        return pd.DataFrame(rows, columns=["fingerprint", "fits"])

    judged = records.withColumn("fingerprint", print_of(F.col(record)))
    return judged.where("not fingerprint.fits").withColumn("fingerprint", F.col("fingerprint.fingerprint"))


#: The template's control strings.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that other templates give a meaning; they are escaped inside texts as well.
CONTROL = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _java_quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}<>/-" else c for c in s)


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Backslashes are doubled; one backslash goes behind the first character of every control string, overlapping ones too."""
    heads: dict[str, list[str]] = {}
    for c in control:
        heads.setdefault(c[0], []).append(_java_quoted(c[1:]))
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    for head, rests in heads.items():
        out = F.regexp_replace(out, f"{_java_quoted(head)}(?={'|'.join(rests)})", _java_quoted(head) + r"\\")
    return out


def unescape(text: str) -> str:
    """The inverse of :func:`escaped`."""
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted text, a segment for each turn: conv_id, turn, formatted, loss_start, loss_end.

    The segments of a conversation, joined in the order of turn (null first), then of role and text, are its text; ``loss_start`` and ``loss_end`` (code points within the segment, equal where
    nothing counts) are the loss mask. A null role or text is empty; a null conv_id is a conversation of its own;
    repeated rows are turns of their own; an empty table gives an empty one; further columns are ignored.
    """
    one = turns.select("conv_id", "turn", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)).alias("__head"), escaped(F.col("text")).alias("__body"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("__loss"))
    start = F.length("__head")
    return one.select("conv_id", "turn", F.concat("__head", "__body", F.lit(END + "\n")).alias("formatted"), start.alias("loss_start"), (start + F.when(F.col("__loss"), F.length("__body")).otherwise(0)).alias("loss_end"))


#: A turn within a conversation's text: control strings cannot occur in roles and texts, so the next END ends it.
_SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse_text(text: str, done: bool = True) -> tuple[list[tuple[str, str, int, int]], int]:
    """The turns of a conversation's text, by its marks alone, and how many characters they take.

    Each is (role, text, start and end of its escaped text). What is left over is refused if the text is ``done``.
    """
    out, at = [], 0
    while m := _SEGMENT.match(text, at):
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if done and at < len(text):
        raise ValueError("not a text of this template")
    return out, at


class _Digest:
    """Digests of one conversation, read from its text as that grows."""

    def __init__(self):
        self.turns, self.said, self.loss_chars, self.loss, self.chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0

    def read(self, text: str, mask: list[tuple[int, int]]) -> None:
        """``text``: some whole turns; ``mask``: stretches of it under the loss mask, in order."""
        for role, said, *_ in parse_text(text)[0]:
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for a, b in mask:
            under = unescape(text[a:b])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.chars += len(text)


#: Characters of a conversation's text that are joined before they are parsed, at least one turn.
JOIN_CHARS = 1 << 20


def digest_segments(segments: DataFrame) -> DataFrame:
    """Per conversation, from its text and mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are sorted by conversation and turn and joined to the conversation's text, which is then parsed at its
    marks, whatever segments it came from; stretches of ``JOIN_CHARS`` at a time, so that a conversation of any length
    needs the memory of one batch. Turns of one number are in the order of role and text, which the sort reads from
    the segments themselves, so that each text is shuffled once.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now, state, held, size, mask = object(), None, [], 0, []

        def close():
            nonlocal held, size, mask
            if held:
                state.read("".join(held), mask)
            held, size, mask = [], 0, []

        def row():
            return (now, state.turns, state.said.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars)

        for pdf in batches:
            rows = []
            for cid, text, a, b in zip(pdf["conv_id"].astype("Int64"), pdf["formatted"], pdf["loss_start"], pdf["loss_end"], strict=True):
                cid = None if cid is pd.NA else int(cid)
                if state is None or cid != now:
                    if state is not None:
                        close()
                        rows.append(row())
                    now, state = cid, _Digest()
                held.append(text)
                if b > a:
                    mask.append((size + a, size + b))
                size += len(text)
                if size >= JOIN_CHARS:
                    close()
            yield _digests(rows)
        if state is not None:
            close()
            yield _digests([row()])

    text = F.col("formatted")
    body = F.instr(text, BODY)
    role, said = F.substring(text, len(TURN) + 1, body - len(TURN) - 1), F.substring(text, body + len(BODY), F.length(text) - body - len(BODY) - len(END))
    unescaped = lambda x: F.regexp_replace(x, r"\\(\\?)", "$1")
    rows = segments.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", unescaped(role), unescaped(said)).select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, schema)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})
