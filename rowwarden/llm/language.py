"""Language identification: words first, character n-grams for the words that are not known.

Counts of words per language are taken over all labelled rows.  A word that makes up at least ``word_share`` of some
language's words is known, which bounds the known words of a language by 1 / ``word_share``; likewise n-grams.  A known
word adds its log frequency in every language.  An unseen word falls back to the longest n-grams known to the model,
letter by letter down to single letters.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import staged, tidied

LETTERS = regex.compile(r"\p{L}+")
LENGTHS = (4, 3, 2, 1)
CACHE_BYTES = 64 << 20   # of words that a task has judged
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_letter_words long, share_known double"


def count_words(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over whole texts; rows without text or language count nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(text.split())
            for lang, tokens in counts.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    for word in LETTERS.findall(token.lower()):
                        words[word] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())],
                    ["lang", "word", "n"])

    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return texts.mapInArrow(tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams_of(word: str, length: int) -> list[str]:
    """The n-grams of a word between two marks that stand for its ends; single letters without the marks."""
    if length == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i:i + length] for i in range(len(marked) - length + 1)]


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of all lengths from word counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = counts[lang]
                for length in LENGTHS:
                    for gram in grams_of(word, length):
                        own[gram] += n
            if sum(map(len, counts.values())) > 500_000:
                yield from emit(counts)
                counts.clear()
        yield from emit(counts)

    def emit(counts: dict) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(tidied(run), "lang string, gram string, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of the known words and n-grams in every language."""

    def __init__(self, words: list, grams: list, totals: dict[str, int]) -> None:
        self.langs = sorted(totals)
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.words = self._table(words, place, [totals[lang] for lang in self.langs])
        sums: dict[int, list[int]] = {k: [1] * len(place) for k in LENGTHS}
        for lang, gram, n in grams:
            sums[len(gram)][place[lang]] += n
        self.grams = {k: self._table([g for g in grams if len(g[1]) == k], place, sums[k]) for k in LENGTHS}

    @staticmethod
    def _table(rows: list, place: dict[str, int], totals: list[int]) -> dict[str, np.ndarray]:
        floor = np.array([math.log(0.5 / (t + 1)) for t in totals])
        table: dict[str, np.ndarray] = {}
        for lang, key, n in rows:
            if key not in table:
                table[key] = floor.copy()
            table[key][place[lang]] = math.log((n + 0.5) / (totals[place[lang]] + 1))
        return {k: (v - v.mean()).astype(np.float32) for k, v in table.items()}

    def word(self, word: str) -> tuple[np.ndarray, bool]:
        """What a word says for each language, and whether it is known as a word."""
        known = self.words.get(word)
        if known is not None:
            return known, True
        said = np.zeros(len(self.langs), np.float32)
        marked, at = f"^{word}$", 0
        while at < len(marked):
            for length in LENGTHS:
                gram = marked[at:at + length]
                if len(gram) == length and (found := self.grams[length].get(gram)) is not None:
                    said += found
                    at += max(1, length - 1)
                    break
            else:
                at += 1
        return said, False


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", word_share: float = 5e-5,
        gram_share: float = 2e-4) -> Model:
    """Count over all rows with a language; only frequencies above the shares, a bounded number, reach the driver."""
    counts = staged(count_words(labelled, text_col, lang_col))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model([], [], {})
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, max(1.0, n * word_share))])
    words = counts.filter(F.col("n") >= least[F.col("lang")]).collect()
    letters = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, max(1.0, n * gram_share))])
    # Every word has at least one n-gram of each length up to its own, and a few at most.
    grams = count_grams(counts).filter(F.col("n") >= letters[F.col("lang")]).collect()
    return Model([tuple(r) for r in words], [tuple(r) for r in grams], totals)


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text, from the text alone.

    ``lang_pred`` is one of the learned languages, ties going to the first in alphabetical order, or ``und`` with score
    0 where the text is null, holds no letter, or no language was learned.  ``score``: the posterior probability of the
    prediction at equal priors, each word counted once.  Repeated rows give repeated rows, a null id stays null, other
    columns are not read.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        zero = np.zeros(len(own.langs), np.float64)
        remembered: dict[str, tuple] = {}
        room = CACHE_BYTES

        def of(token: str) -> tuple:
            nonlocal room
            found = remembered.get(token)
            if found is None:
                said, n, known = zero.copy(), 0, 0
                for word in LETTERS.findall(token.lower()):
                    more, is_known = own.word(word)
                    said, n, known = said + more, n + 1, known + is_known
                found = tuple(said.tolist()), n, known
                size = 4 * len(token) + 40 * len(zero) + 250
                if size <= room:
                    remembered[token] = found
                    room -= size
            return found

        for batch in batches:
            langs, scores, counts, shares = [], [], [], []
            for text in batch.column(2).to_pylist():
                parts = [of(t) for t in (text or "").split()]
                n = sum([p[1] for p in parts])
                counts.append(n)
                shares.append(sum([p[2] for p in parts]) / n if n else 0.0)
                if not n or not own.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = [math.fsum(x) for x in zip(*[p[0] for p in parts], strict=True)]
                best = max(range(len(total)), key=lambda i: (total[i], -i))
                langs.append(own.langs[best])
                scores.append(1 / math.fsum(math.exp(max(-700.0, x - total[best])) for x in total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs), pa.array(scores), pa.array(counts, pa.int64()), pa.array(shares)],
                ["doc_id", "held_out", "lang_pred", "score", "n_letter_words", "share_known"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidied(run), PREDICTED)


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learn from the documents outside fold 0 that have a language, and predict all."""
    part = fold(id_col, folds)
    model = fit(docs.filter(part != 0), text_col, lang_col)
    return predict(docs, model, part == 0, id_col, text_col)
