"""Token counts by linear greedy longest match (Song et al., 2021).

The vocabulary is a trie over characters. Every node has a failure link, the node reached after the longest pieces have
been cut off its left end, and the precomputed number of pieces that are cut off on the way. A word is then measured in
one pass over its characters: follow the trie, and on a miss follow failure links and add their counts. No piece is built.

Texts are lower-cased and split into runs of letters, single digits and runs of other visible characters. A word is
followed by its end mark, and is one unknown token if greedy matching gets stuck.

Defined cases: a null or empty text, or one of blanks only, has 0 words and 0 tokens. Repeated rows are counted each by
itself. Texts and words are read whole, whatever their length.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm.arrow import with_columns

END = "</w>"
WORD = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")
#: Words whose lengths a task keeps; beyond it forgets them and measures again.
KEPT_WORDS = 300_000


class Automaton:
    """Trie of a vocabulary with failure links and popped-token counts.

    Symbols are characters, and END as one symbol. child: (node, symbol) to node; fail[node]: node after cutting, -1 if
    the node's text can't be cut; pops[node]: pieces cut on the way there.
    """

    def __init__(self, vocabulary: list[str], end: str = END):
        self.end = end
        self.child: dict[tuple[int, str], int] = {}
        parent, symbol, whole = [-1], [""], [False]
        for piece in vocabulary:
            symbols = [*piece[: -len(end)], end] if end and piece.endswith(end) else list(piece)
            at = 0
            for s in symbols:
                to = self.child.get((at, s))
                if to is None:
                    to = self.child[at, s] = len(parent)
                    parent.append(at), symbol.append(s), whole.append(False)
                at = to
            whole[at] = at > 0
        order = [0]
        kids: dict[int, list[int]] = {}
        for (at, _), to in self.child.items():
            kids.setdefault(at, []).append(to)
        for at in order:
            order.extend(kids.get(at, ()))
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        for node in order[1:]:
            if whole[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, n = self.fail[parent[node]], self.pops[parent[node]]
            while at >= 0 and (at, symbol[node]) not in self.child:
                n, at = n + self.pops[at], self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.child[at, symbol[node]], n

    def length(self, word: str) -> int:
        """Pieces of word followed by the end mark; 1 if it can't be cut into pieces."""
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for s in (*word, self.end) if self.end else word:
            while (to := child.get((at, s))) is None:
                if at == 0:
                    return 1
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n if at == 0 else 1


class Lengths(dict):
    """Word to its number of pieces, measured when first asked for; spell writes a word in the vocabulary's characters."""

    def __init__(self, automaton: Automaton, spell=str):
        self.automaton, self.spell = automaton, spell

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.automaton.length(self.spell(word))
        return n


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["model"]["vocab"])


def byte_characters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def count_tokens(docs: DataFrame, vocabulary: list[str], text: str = "text", byte_level: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words and n_tokens; the other columns stay. The vocabulary, a fixed file, goes to every task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        table = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        bytewise = lambda word: word.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
        known = Lengths(Automaton(shared.value), bytewise if byte_level else str)

        def work(texts: list) -> list:
            found = [WORD.findall(t.lower()) if t else () for t in texts]
            return [[len(words) for words in found], [sum(map(known.__getitem__, words)) for words in found]]

        return work

    return with_columns(docs, text, [("n_words", T.LongType()), ("n_tokens", T.LongType())], start, drop)
