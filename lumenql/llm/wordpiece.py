"""Token counts of greedy longest-match word pieces in linear time.

The vocabulary is one trie with two roots, for pieces that start a word and for pieces that go on.
Where a node has no edge for the next character, its failure link leads to the node reached after
cutting off the longest pieces of what was matched; how many pieces that cuts off is stored with
the link. So a word is read once, pieces are counted and never built.

Defined results: null and empty texts have no words; a word with no full segmentation counts as
one piece, the unknown one. Words are runs of word characters or single other non-blank ones.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame

from .common import map_texts

_WORD = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """first: pieces that start a word; other: pieces that go on one."""

    def __init__(self, first: list[str], other: list[str], kept: int = 1_000_000):
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, first), (1, other)):
            for p in pieces:
                node = root
                for c in p:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    node = self.edges[node][c]
                final[node] = node > 1
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        level = [(0, c, v) for c, v in self.edges[0].items()] + [(1, c, v) for c, v in self.edges[1].items()]
        while level:
            for parent, c, v in level:
                if final[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.edges[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.edges[z][c], popped
            level = [(v, c, w) for _, _, v in level for c, w in self.edges[v].items()]
        self.words: dict[str, int] = {}
        self.kept = kept

    def pieces(self, word: str) -> int:
        """Number of pieces of a word, 0 if it can't be segmented."""
        node, count = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for c in word:
            while (to := edges[node].get(c)) is None:
                if fail[node] < 0:
                    return 0
                count += pops[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            count += pops[node]
            node = fail[node]
        return count

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces, and unknown words of a text; each distinct word is read once a task."""
        words = _WORD.findall(text) if text else []
        if len(self.words) > self.kept:
            self.words = {}
        got = list(map(self.words.get, words))
        if None in got:
            for w in set(words).difference(self.words):
                self.words[w] = self.pieces(w)
            got = list(map(self.words.__getitem__, words))
        unknown = got.count(0)
        return len(words), sum(got) + unknown, unknown


@cache
def automaton(first: tuple[str, ...], other: tuple[str, ...]) -> Automaton:
    """One automaton a Python worker: tasks that follow in the same worker reuse it and its bounded word cache."""
    return Automaton(first, other)


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Starting and going-on pieces of a sentence-piece model: those with and without its word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    mark = "▁"
    return [p[1:] for p in pieces if p.startswith(mark) and len(p) > 1], [p for p in pieces if not p.startswith(mark)]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_tokens, n_unknown of each row. The vocabulary (fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        machine = automaton(*map(tuple, shared.value))

        def step(keys, texts):
            rows = [machine.count(t) for t in texts]
            return {key: keys, "n_words": [r[0] for r in rows], "n_tokens": [r[1] for r in rows], "n_unknown": [r[2] for r in rows]}

        return step

    return map_texts(docs, [key, "text"], make, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
