"""Operator 2: token counts by a linear longest-match automaton.

Greedy word-piece: a word's first piece is the longest word-initial entry of
the vocabulary that starts it, each further piece the longest continuing entry
that starts the rest.  The vocabulary is a trie with two roots.  A node whose
next byte leads nowhere has a failure link to the node of what is left after
the greedy pieces of its string are popped, and the number of those pieces is
precomputed; so a word costs one pass over its bytes and no piece is built
(Song et al., "Fast WordPiece Tokenization", 2021).

The automaton is bounded by the vocabulary and travels with the function.  No
row leaves its task.  Words repeat, so counts are kept up to a fixed number of
words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHE = 1 << 19
_START, _MORE, _NONE = 0, 1, -1


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing entries of a ranks file of a byte-level vocabulary.

    Entries that begin with a space start a word (without that space); the
    space alone, which the empty word-initial piece would be, is left out and
    every other entry continues one.
    """
    with open(path, "rb") as f:
        entries = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [e[1:] for e in entries if e[:1] == b" " and len(e) > 1], [e for e in entries if e[:1] != b" "]


class Automaton:
    """Transitions, failure links and popped counts of the vocabulary's trie."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        step: dict[int, int] = {}
        final, above, by = [False, False], [_NONE, _NONE], [0, 0]
        for root, entries in ((_START, initial), (_MORE, continuing)):
            for e in entries:
                u = root
                for c in e:
                    v = step.get(u << 8 | c)
                    if v is None:
                        v = step[u << 8 | c] = len(final)
                        final.append(False)
                        above.append(u)
                        by.append(c)
                    u = v
                if u != root:
                    final[u] = True
        fail, pops = [_NONE] * len(final), [0] * len(final)
        depth = [0] * len(final)
        for v in range(2, len(final)):
            depth[v] = depth[above[v]] + 1
        for v in sorted(range(2, len(final)), key=depth.__getitem__):
            if final[v]:
                fail[v], pops[v] = _MORE, 1
                continue
            z, n, c = fail[above[v]], pops[above[v]], by[v]
            while z != _NONE and (z << 8 | c) not in step:
                n += pops[z]
                z = fail[z]
            if z != _NONE:
                fail[v], pops[v] = step[z << 8 | c], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 (the unknown piece) where the greedy way ends in nothing."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            v = step.get(u << 8 | c)
            while v is None:
                n += pops[u]
                u = fail[u]
                if u == _NONE:
                    return 1
                v = step.get(u << 8 | c)
            u = v
        while u != _MORE:
            n += pops[u]
            u = fail[u]
            if u == _NONE:
                return 1
        return n

    def __getstate__(self) -> tuple:
        return (np.fromiter(self.step, np.int64), np.fromiter(self.step.values(), np.int32), np.array(self.fail, np.int32),
                np.array(self.pops, np.int32))

    def __setstate__(self, state: tuple) -> None:
        self.step = dict(zip(state[0].tolist(), state[1].tolist(), strict=True))
        self.fail, self.pops = state[2].tolist(), state[3].tolist()


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = n = self.count(word)
        return n


def token_counts(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, n_words, n_tokens) per document row.

    Words are runs of other characters than the six ASCII spaces, in UTF-8.  A
    word that the vocabulary cannot spell is one token.  Null and empty texts
    have none; null ids and repeated rows stay; other columns are not read.
    """
    automaton = Automaton(*vocabulary)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(automaton)
        for b in batches:
            found = []
            for t in b.column(1).cast(pa.binary()):
                w = (t.as_py() or b"").split()
                found.append((len(w), sum(map(counts.__getitem__, w))))
            a = np.array(found, np.int64).reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(a[:, 0]), pa.array(a[:, 1])], ["id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", doc_id)
