"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens that following the link pops. A word's greedy
longest-match length is then counted in one pass over its characters, without building a piece and without going back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id

#: Words whose counts a worker remembers, and their longest length; more are counted anew.
REMEMBERED, LONGEST = 400_000, 64
#: What a word starts with in the vocabulary.
WORD_START = "▁"


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file; read on the driver, as executors may not have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class Automaton:
    """Counts greedy longest-match tokens. A character that no piece covers counts as its UTF-8 bytes."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        weight = [0]
        for p in pieces:
            node = 0
            for c in p:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                node = self.next[node][c]
            if node:
                weight[node] = 1
        for c, node in self.next[0].items():  # single characters always match
            weight[node] = weight[node] or len(c.encode("utf-8", "surrogatepass"))
        self.fail, self.pops = [0] * len(weight), [0] * len(weight)
        queue = [(n, 0, c) for c, n in self.next[0].items()]
        for node, parent, c in queue:  # breadth first: shorter strings are done
            if weight[node]:
                self.pops[node] = weight[node]
            else:
                z, n = self.fail[parent], self.pops[parent]
                while c not in self.next[z]:
                    if not z:
                        n += len(c.encode("utf-8", "surrogatepass"))
                        break
                    n, z = n + self.pops[z], self.fail[z]
                self.fail[node], self.pops[node] = self.next[z].get(c, 0), n
            queue += [(m, node, d) for d, m in self.next[node].items()]

    def count(self, word: str) -> int:
        follow, fail, pops, node, n = self.next, self.fail, self.pops, 0, 0
        for c in word:
            while (to := follow[node].get(c)) is None:
                if not node:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                    break
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            n += pops[node]
            node = fail[node]
        return n


class _Counts(dict):
    def __init__(self, pieces: list[str], start: str):
        self.automaton, self.start = Automaton(pieces), start

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(self.start + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def _counter(pieces: list[str], start: str):
    kept: list[_Counts] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Counts(pieces, start))
        get = kept[0].__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", word_start: str = WORD_START) -> DataFrame:
    """id_col, n_words and n_tokens of each row. Words are what white space parts; null and blank texts have 0 of both.

    Rows with null or repeated ids are counted like others; other columns of docs are ignored. An empty vocabulary counts UTF-8 bytes.
    """
    rows = docs.select(as_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(pieces, word_start), "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
