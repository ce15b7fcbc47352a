"""Token counts by a linear longest-match automaton.

A trie over the vocabulary's byte strings gets a failure link per node, and the number of pieces that following
the link pops; a word's greedy longest-match length is then the sum of pops along one walk over its bytes.
A word is split as a space and its bytes, the way the vocabulary holds word starts.  Bytes that the vocabulary
lacks count as a piece each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import raw, read

VOCABULARY, REMEMBERED = "/opt/tokenizers/byte_bpe_50k.tiktoken", 200_000


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a rank file: a line is a base64 string, a space and a number."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """step: node << 8 | byte -> child; fail and pops: where a node goes when no child fits, and how many pieces that ends."""

    def __init__(self, pieces: Iterable[bytes]):
        known = set(pieces) | {bytes([b]) for b in range(256)}
        known.discard(b"")
        self.step, full = {}, [False]
        for piece in sorted(known):
            node = 0
            for b in piece:
                child = self.step.get(node << 8 | b)
                if child is None:
                    child = len(full)
                    full.append(False)
                    self.step[node << 8 | b] = child
                node = child
            full[node] = True
        children: list[list] = [[] for _ in full]
        for key, child in self.step.items():
            children[key >> 8].append((key & 255, child))
        self.fail, self.pops, queue = [-1] * len(full), [0] * len(full), [0]
        for node in queue:
            for b, child in children[node]:
                queue.append(child)
                if full[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                z, n = self.fail[node], self.pops[node]
                while z >= 0 and z << 8 | b not in self.step:
                    n += self.pops[z]
                    z = self.fail[z]
                self.fail[child], self.pops[child] = (self.step[z << 8 | b], n) if z >= 0 else (-1, n)

    @classmethod
    def of(cls, step: dict, fail: list, pops: list) -> Automaton:
        """One whose tables are made already."""
        out = cls.__new__(cls)
        out.step, out.fail, out.pops = step, fail, pops
        return out

    def length(self, text: bytes) -> int:
        """Pieces of the greedy longest match."""
        step, fail, pops, node, n = self.step, self.fail, self.pops, 0, 0
        for b in text:
            while (child := step.get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
            node = child
        while node:
            n += pops[node]
            node = fail[node]
        return n


def counted(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, one row per row of docs (doc_id, text).

    Words are runs of anything but ASCII white space.  A null or empty text has none.  Repeated rows come out
    repeated; other columns are not read; an empty table gives no rows.  The automaton is made once, from a
    vocabulary of fixed size, and goes to each worker as plain tables.
    """
    made = Automaton(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((made.step, made.fail, made.pops))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton.of(*shared.value), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in raw(batch, "text"):
                words = text.split()
                sizes = [seen.get(w) for w in words]
                if None in sizes:
                    for i, size in enumerate(sizes):
                        if size is None:
                            w = words[i]
                            if (size := seen.get(w)) is None:
                                size = automaton.length(b" " + w)
                                if len(w) < 64:
                                    seen[w] = size
                            sizes[i] = size
                    if len(seen) > REMEMBERED:
                        seen.clear()
                n_words.append(len(words))
                n_tokens.append(sum(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return counted(read(spark, sf_dir, "documents"), vocabulary(path))
