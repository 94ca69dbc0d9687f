"""Many patterns in one pass over a text: an automaton of their terms finds candidates, and only these meet their patterns.

Every pattern of a dictionary has terms one of which each of its matches holds. The terms make one automaton
(Aho and Corasick, 1975), as flat arrays: the next state by state and class of byte, the next state with an output on the way of
failures, and the patterns of each state's term. It is built once, sent to the tasks if it is small enough, and run
over a batch of texts at once, all of them a byte further in each step. A dictionary that is too large to be sent meets the texts in a join on the
first characters of its terms. What a text may match is then tried by Spark, in the order of the dictionary.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.names import own_name
from fathomline.operators.lineage import kept

#: Bytes of an automaton that is sent to the tasks; a larger dictionary is joined.
MOST_BYTES = 64 << 20
#: Bytes of a text that are one row of a step; a longer text is several rows, each with as much before it as the longest term takes.
STRETCH = 512
#: Terms have at least so many characters; a pattern without such a term is tried on every text.
LEAST_TERM = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else, as patterns without regard to case match."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _alternatives(pattern: str) -> list[str]:
    """What stands between the ``|`` that are in no group and no class."""
    out, depth, in_class, at, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("\\Q", i):  # quoted up to \E
            i = pattern.find("\\E", i) + 1 or len(pattern)
        elif c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def _closing(pattern: str, i: int) -> int:
    """Behind the group or class that begins at ``i``."""
    depth, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            if c == "]":
                in_class = False
                if not depth:
                    return i + 1
        elif c == "[":
            in_class = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(pattern)


def _longest_run(alternative: str) -> str:
    """The longest run of characters that every match holds, as far as it can be told: groups, classes and what is optional end a run."""
    runs, now, i = [], "", 0
    while i < len(alternative):
        c = alternative[i]
        literal = None
        if c == "\\":
            c = alternative[i + 1 : i + 2]
            i += 2
            if c and not c.isalnum():
                literal = c
            elif c == "Q":  # quoted up to \E
                end = alternative.find("\\E", i)
                end = len(alternative) if end < 0 else end
                now += alternative[i:end]
                i = end + 2
                continue
            elif c and c in "bB":
                continue  # a place, not a character: the run goes on
            elif c and c in "xupP0123456789NkcR":
                return ""  # what follows belongs to the escape: nothing is taken from here
        elif c in "([":
            i = _closing(alternative, i)
        elif c in "^$":
            i += 1
            continue
        elif c == ".":
            i += 1
        else:
            literal = c
            i += 1
        after = alternative[i : i + 1]
        if after and after in "?*{":
            optional = after != "{" or alternative[i + 1 : i + 2] == "0"
            if literal is not None and not optional:
                now += literal
            literal = None
            i = alternative.find("}", i) + 1 if after == "{" else i + 1
            if alternative[i : i + 1] in ("?", "+"):
                i += 1
        elif after == "+":
            i += 1
            if alternative[i : i + 1] in ("?", "+"):
                i += 1
            runs.append(now + (literal or ""))
            now = ""
            continue
        if literal is None:
            runs.append(now)
            now = ""
        else:
            now += literal
    return max([*runs, now], key=len)


def required_terms(pattern: str) -> tuple[str, ...] | None:
    """Terms, in lower case, one of which every match of ``pattern`` holds whatever its case; None where that cannot be told."""
    bare = pattern
    while bare.startswith(("(?i)", "(?s)", "(?m)")):
        bare = bare[4:]
    terms = []
    for one in _alternatives(bare):
        term = lowered(_longest_run(one))
        if len(term) < LEAST_TERM:
            return None
        terms.append(term)
    return tuple(dict.fromkeys(terms))


@dataclass(frozen=True)
class Automaton:
    """Classes of bytes, the next state by state * classes + class, the next state with an output, and the entries of each state from ``starts`` on."""

    classes: np.ndarray
    goto: np.ndarray
    link: np.ndarray
    starts: np.ndarray
    entries: np.ndarray
    longest: int

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.classes, self.goto, self.link, self.starts, self.entries))

    @classmethod
    def of(cls, terms: Sequence[tuple[str, int]]) -> Automaton:
        """``terms``: each with the number of its entry. Terms may repeat, empty ones are left out."""
        coded = [(t.encode("utf-8", "surrogatepass"), e) for t, e in terms if t]
        used = sorted({b for t, _ in coded for b in t})
        classes = np.zeros(256, np.uint16)
        classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        owns: list[list[int]] = [[]]
        for term, entry in coded:
            node = 0
            for b in term:
                c = int(classes[b])
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                    owns.append([])
                node = below
            owns[node].append(entry)
        goto = np.zeros((len(children), width), np.int32)
        failure, link = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        for c, node in children[0].items():
            goto[0, c] = node
        open_ = deque(children[0].values())
        while open_:  # breadth first: a state's failure is nearer to the root, so its row is complete
            node = open_.popleft()
            back = failure[node]
            goto[node] = goto[back]
            link[node] = back if owns[back] else link[back]
            for c, below in children[node].items():
                failure[below] = goto[back, c]
                goto[node, c] = below
                open_.append(below)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in owns]))).astype(np.int64)
        entries = np.array([e for x in owns for e in x], np.int32)
        return cls(classes, goto.reshape(-1), link, starts, entries, max((len(t) for t, _ in coded), default=1))

    def find(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """For each text the entries that have a term in it, in ascending order."""
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = self.classes[_LOWER[np.frombuffer(b"".join(raw), np.uint8)]].astype(np.int64)
        sizes = np.array([len(r) for r in raw], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(raw)), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.maximum(0, place * STRETCH - (self.longest - 1))
        length = np.minimum(sizes[owner], (place + 1) * STRETCH) - start
        order = np.argsort(-length, kind="stable")
        owner, at, length = owner[order], (begins[owner] + start)[order], length[order]
        width, state = len(self.goto) // len(self.link), np.zeros(len(owner), np.int64)
        hit = (np.diff(self.starts) > 0) | (self.link > 0)
        rows, states = [], []
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))  # stretches longer than i
            state[:n] = self.goto[state[:n] * width + data[at[:n] + i]]
            found = np.flatnonzero(hit[state[:n]])
            if len(found):
                rows.append(owner[found])
                states.append(state[found])
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        if not rows:
            return out
        pair = np.unique(np.concatenate(rows) * len(self.link) + np.concatenate(states))
        row, at_state = pair // len(self.link), pair % len(self.link)
        got_rows, got = [], []
        while len(row):  # from a state to the shorter terms that end with it
            n = np.diff(self.starts)[at_state]
            first = np.repeat(self.starts[at_state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got_rows.append(np.repeat(row, n))
            got.append(self.entries[first])
            at_state = self.link[at_state]
            row, at_state = row[at_state > 0], at_state[at_state > 0]
        many = int(self.entries.max()) + 1
        both = np.unique(np.concatenate(got_rows) * many + np.concatenate(got))
        row, entry = both // many, (both % many).astype(np.int32)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for r, e in zip(row[np.concatenate(([0], cuts))], np.split(entry, cuts), strict=True):
            out[r] = e
        return out


def with_candidates(df: DataFrame, text: str, patterns: Sequence[str], out: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``out``: the numbers of the patterns that may match the text, ascending; patterns without a term are always among them.

    Null texts have none. An automaton of more than ``most_bytes`` is not sent: texts meet the terms in a join on their
    first characters, keyed by a number of the row, and rows come back in another order.
    """
    known = [(i, required_terms(p)) for i, p in enumerate(patterns)]
    always = [i for i, t in known if t is None]
    terms = [(t, i) for i, ts in known for t in ts or ()]
    ones = F.array(*[F.lit(i) for i in always]).cast("array<int>")
    if not terms:
        return df.withColumn(out, F.when(F.col(text).isNotNull(), ones))
    if sum(len(t.encode("utf-8", "surrogatepass")) for t, _ in terms) * 4 <= most_bytes and (machine := Automaton.of(terms)).size <= most_bytes:
        sent = df.sparkSession.sparkContext.broadcast(machine)

        @F.pandas_udf("array<int>")
        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(sent.value.find(list(texts)), dtype=object)

        found = hits(F.col(text))
    else:
        return _joined(df, text, terms, ones, out)
    return df.withColumn(out, F.when(F.col(text).isNotNull(), F.array_sort(F.array_union(found, ones)) if always else found))


def _joined(df: DataFrame, text: str, terms: list[tuple[str, int]], ones: Column, out: str) -> DataFrame:
    """Candidates of a dictionary that is too large to be sent: an equality join on the first two characters of its terms."""
    spark, row, low = df.sparkSession, own_name(df.columns, "n"), own_name(df.columns, "l")
    rows = kept(df.withColumn(row, F.monotonically_increasing_id()))
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = spark.createDataFrame([(t[:LEAST_TERM], t, i) for t, i in terms], "gram string, term string, entry int")
    one = rows.select(row, lower.alias(low))
    starts = F.array_distinct(F.array_union(F.regexp_extract_all(low, F.lit("(?s).{2}"), F.lit(0)), F.regexp_extract_all(F.substring(low, 2, 2147483647), F.lit("(?s).{2}"), F.lit(0))))
    asked = one.select(row, low, F.explode(starts).alias("gram"))
    met = asked.join(listed, "gram").where(F.contains(F.col(low), F.col("term"))).groupBy(row).agg(F.collect_set("entry").alias(out))
    back = rows.join(met, row, "left")
    return back.withColumn(out, F.when(F.col(text).isNotNull(), F.array_sort(F.array_union(F.coalesce(F.col(out), F.array().cast("array<int>")), ones)))).drop(row)


def constant(rows: list[dict], schema: str) -> Column:
    """A constant array of structs. It is parsed from one string, once, and so takes one node of a plan whatever its length."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def matches(candidates: Column, text: Column, patterns: Column) -> Column:
    """Those of ``candidates`` whose pattern (``patterns``: a constant array with a field ``p``) matches the text, in their order."""
    return F.filter(candidates, lambda i: F.rlike(text, F.get(patterns, i)["p"]))


def first_match(df: DataFrame, text: str, patterns: Sequence[str], out: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``out``: the number of the first pattern that matches the text, without regard to case, or null. Columns stay, whatever their names."""
    own = own_name([*df.columns, out], "c")
    listed = constant([{"p": f"(?i){p}"} for p in patterns], "p:string")
    found = with_candidates(df, text, patterns, own, most_bytes)
    return found.withColumn(out, F.get(matches(F.col(own), F.col(text), listed), F.lit(0))).drop(own)
