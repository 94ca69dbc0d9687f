"""Token counts by a unigram model, with dynamic programming shared along a trie of pre-tokens.

Distinct pre-tokens are inserted into a trie. A node stands for a prefix and holds its forward score and the number
of pieces of its best segmentation, which depend on the prefix alone: they are computed once, when the node is made,
from those of the nodes above it, whatever number of pre-tokens go through it. The count at a pre-token's last node is
its own. Documents look their words up.

The vocabulary is that of an installed tokenizer file (nothing is trained): pieces are byte strings with a
rank, and the score of a piece is -log(rank + 2), a Zipf law over the ranks.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import small_batches

#: Nodes of a worker's trie; on overflow it forgets all and begins again.
MOST_NODES = 1_500_000
#: Bytes from which a word makes no nodes: hardly another one shares them, and a single word could fill a worker's memory.
LONG_WORD = 4096

_loaded: dict[str, TrieCounter] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def load_pieces(path: str) -> dict[bytes, float]:
    """Scores of all pieces of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 2) for a, b in map(bytes.split, f)}


class TrieCounter:
    """Nodes are numbers, in the order in which they are made; a child is found by its parent's number and its byte."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.tails = {p[i:] for p in pieces for i in range(len(p))}  # what a piece can end with
        self.longest = max(map(len, pieces), default=1)
        self.forget()

    def forget(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.known: dict[bytes, int] = {}

    @property
    def nodes(self) -> int:
        return len(self.score)

    def learn(self, words: list[bytes]) -> None:
        """Inserts ``words`` and stores their counts. Of equal best scores the one with fewer pieces counts; a byte that no piece covers is one token with a very low score."""
        pieces, tails, known, child, score, count = self.pieces, self.tails, self.known, self.child, self.score, self.count
        for word in words:
            path, node = [0], 0
            for end, byte in enumerate(word, 1):
                edge = node << 8 | byte
                below = child.get(edge)
                if below is None:
                    best, n = score[node] - 1e3, count[node] + 1
                    for start in range(end - 1, -1, -1):
                        piece = word[start:end]
                        if piece not in tails:
                            break
                        s = pieces.get(piece)
                        if s is not None:
                            before = path[start]
                            s += score[before]
                            if s > best or (s == best and count[before] + 1 < n):
                                best, n = s, count[before] + 1
                    below = child[edge] = len(score)
                    score.append(best)
                    count.append(n)
                node = below
                path.append(node)
            known[word] = count[node]

    def alone(self, word: bytes) -> int:
        """The count of a word by the same recurrence, without nodes: only the scores that a piece can still reach are held, whatever the word's length."""
        pieces, tails, width = self.pieces, self.tails, self.longest + 1
        score, count = [0.0] * width, [0] * width
        for end in range(1, len(word) + 1):
            best, n = score[(end - 1) % width] - 1e3, count[(end - 1) % width] + 1
            for start in range(end - 1, max(-1, end - width), -1):
                piece = word[start:end]
                if piece not in tails:
                    break
                s = pieces.get(piece)
                if s is not None:
                    s += score[start % width]
                    m = count[start % width] + 1
                    if s > best or (s == best and m < n):
                        best, n = s, m
            score[end % width], count[end % width] = best, n
        return count[len(word) % width]

    def totals(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text; a word is counted with a space before it."""
        cut = [[b" " + w for w in t.split()] for t in texts]  # bytes.split: at the six ASCII separators alone
        long = {w: self.alone(w) for w in {w for c in cut for w in c if len(w) >= LONG_WORD}}
        new = {w for c in cut for w in c if len(w) < LONG_WORD}
        missing = new - self.known.keys()
        if self.nodes + sum(map(len, missing)) > MOST_NODES and self.nodes > 1:
            self.forget()
            missing = new
        self.learn(list(missing))
        known = self.known
        return [(len(c), sum(long[w] if len(w) >= LONG_WORD else known[w] for w in c)) for c in cut]


def _counter(path: str) -> TrieCounter:
    if path not in _loaded:
        _loaded[path] = TrieCounter(load_pieces(path))
    return _loaded[path]


def _stretches(texts: Iterator[str | None], most: int = 1_000_000):
    held, n = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    yield held


def count_tokens(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row of ``docs``, without a shuffle.

    Null and empty texts have 0 of either; texts count in whole, a megabyte of them at a time, and words of any length, the long ones without nodes. Of segmentations with
    equal scores the one with fewer pieces counts. Repeated rows are counted one by one, a null doc_id stays null; an
    empty table gives an empty one; further columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        for pdf in batches:
            both = [x for part in _stretches(iter(pdf["text"])) for x in _counter(path).totals(part)]
            n = np.array(both, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": n[:, 0], "n_tokens": n[:, 1]})

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_words long, n_tokens long")
