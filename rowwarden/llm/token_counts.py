"""Token counts by greedy longest match, in time linear in the text, without building the pieces.

The vocabulary becomes a trie.  Every node has a failure link to the node that stays matched after the longest pieces
are popped from its front, and the number of pieces popped on the way, both computed beforehand.  A word is read once,
character by character: where the trie has no way on, the counts along the failure links are added.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rowwarden.llm.batches import Remembered, map_arrow, split_words

END = "\n"  # closes a word; no byte stands for it
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Bytes as printable characters, as byte-level vocabularies write them: printable bytes stand for themselves, the
#: others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHAR = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
CACHE_BYTES = 16 << 20    # of each of two generations of counted words
SCHEMA = "doc_id long, n_tokens long, n_words long, n_unknown long, n_chars long"


class LongestMatch:
    """``first``: pieces that may begin a word; ``inner``: pieces that may follow, the same ones where not given."""

    def __init__(self, first: Iterable[str], inner: Iterable[str] | None = None) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        final: set[int] = set()
        self.root, self.inner = (0, 0) if inner is None else (0, 1)
        for root, pieces in ((self.root, first), (self.inner, inner or ())):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                if piece:
                    final.add(node)
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        waiting = deque([self.root] if inner is None else [self.root, self.inner])
        while waiting:
            node = waiting.popleft()
            for c, child in self.next[node].items():
                if child in final:
                    self.fail[child], self.popped[child] = self.inner, 1
                else:
                    back, n = self.fail[node], self.popped[node]
                    while back is not None and c not in self.next[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    if back is not None:
                        self.fail[child], self.popped[child] = self.next[back][c], n
                waiting.append(child)

    def count(self, word: str) -> int | None:
        """The number of pieces of greedy longest match; None if some part is in no piece."""
        node, n = self.root, 0
        ways, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while (child := ways[node].get(c)) is None:
                if (back := fail[node]) is None:
                    return None
                n += popped[node]
                node = back
            node = child
        while node != self.inner:
            if (back := fail[node]) is None:
                return None if word else 0
            n += popped[node]
            node = back
        return n


def word_end_vocabulary(path: str) -> list[str]:
    """The pieces of a byte-level vocabulary file whose closing pieces end in ``</w>``, here in ``END``."""
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    return [p.removesuffix("</w>") + END * p.endswith("</w>") for p in pieces]


_automata: dict[str, tuple[LongestMatch, Remembered]] = {}


def _counter(path: str) -> tuple[LongestMatch, Remembered]:
    if path not in _automata:
        _automata[path] = LongestMatch(word_end_vocabulary(path)), Remembered(CACHE_BYTES, lambda word, _: 4 * len(word) + 250)
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: how many tokens the vocabulary at path ``vocabulary`` cuts its whole text into.

    The text is lower-cased and cut into contractions, letter runs, single digits and runs of other signs; each is cut
    into word pieces by greedy longest match, its last piece being one that ends words.  One that no pieces cover is a
    single unknown token.  ``n_words``: runs without white space.  Null and empty texts have no tokens.  Repeated rows
    give repeated rows, a null id stays null, other columns are not read.  No shuffle; a worker remembers the counts of
    a bounded number of bytes of words.
    """
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, known = _counter(vocabulary)
        out: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            text = text or ""
            tokens = unknown = 0
            words = [w for w in split_words(text) if w]
            for word in words:
                found = known.get(word)
                if found is None:
                    a = b = 0
                    for piece in PIECES.findall(word.lower()):
                        n = automaton.count(piece.encode().decode("latin-1").translate(AS_CHAR) + END)
                        a, b = a + (1 if n is None else n), b + (n is None)
                    found = a, b
                    known.put(word, found)
                tokens += found[0]
                unknown += found[1]
            for to, value in zip(out, (tokens, len(words), unknown, len(text)), strict=True):
                to.append(value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_tokens", "n_words", "n_unknown", "n_chars"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(picked, step, SCHEMA)
