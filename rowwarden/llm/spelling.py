"""Spelling variants: words one edit apart, by dense comparison of padded code points in tiles.

Two words, the longer one of m letters, are one edit apart when their common prefix and suffix together reach m - 1.  The
edit then lies in one of the m places, and outside of an interval of places that holds it both words are equal.  So words
that agree before and behind an interval form a group; the places are halved until every group is small.  The letters of a
task's groups stand in padded matrices, and each block of rows is compared with the same block some rows further on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import LOWER, staged, tidied, utf8
from rowwarden.llm.runs import latin, portions, runs

PORTION = 16 << 20     # bytes of text whose words are counted at once
GROUP_ROWS = 512       # words of a group; one place alone can't have more than the 91 forms the letters allow
GROUP_CELLS = 1 << 22  # letters of a group's interval
TILE_CELLS = 1 << 23   # letters in the matrices of one step
WHOLE_RUN = 64         # bytes of a run from which on its checksum is taken by itself
_CRC = np.zeros(256, np.uint32)
for _bit in range(256):
    _one = _bit
    for _ in range(8):
        _one = _one >> 1 ^ 0xEDB88320 * (_one & 1)
    _CRC[_bit] = _one


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every run's bytes, each continued from the crc32 in ``before``."""
    lengths = ends - starts
    order = np.flatnonzero(lengths <= WHOLE_RUN)
    order = order[np.argsort(-lengths[order], kind="stable")]
    state, at, size = before[order] ^ np.uint32(0xFFFFFFFF), starts[order], lengths[order]
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -k, "left"))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.zeros(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > WHOLE_RUN):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(before[i]))
    return out


def _counted(batch: pa.RecordBatch, one_in: int, least_length: int) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    data = LOWER[data]
    starts, ends, text = runs(data, offsets, latin(data))
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
    sums = checksums(data, starts, ends, prefix[text])
    hit = sums % np.uint32(one_in) == 0 if one_in else np.zeros(len(sums), bool)
    shorter = []
    for i in np.flatnonzero(hit):
        word = data[starts[i]:ends[i]].tobytes().decode()
        at = int(sums[i]) % len(word)
        shorter.append(word[:at] + word[at + 1:])
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    kept = ~hit & (ends - starts - (leads[ends] - leads[starts]) >= least_length)
    starts, ends = starts[kept], ends[kept]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    letters = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).value_counts()
    rest = pa.array([w for w in shorter if len(w) >= least_length], pa.large_string()).value_counts()
    return pa.RecordBatch.from_arrays([pa.concat_arrays([whole.field(0), rest.field(0)]).cast(pa.string()),
                                       pa.concat_arrays([whole.field(1), rest.field(1)])], ["word", "n"])


def word_counts(docs: DataFrame, one_in: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of (doc_id, text): the words of all texts, one letter dropped from one in ``one_in`` (document, word)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                yield _counted(part, one_in, least_length)

    return docs.mapInArrow(tidied(step), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.inline(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi"))))


def _keyed(rows: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi) with ``key``: what the word has outside of places ``lo`` to ``hi`` of a longer word of m letters."""
    return rows.withColumn("key", F.expr("concat_ws(' ', m, lo, substring(word, 1, lo), right(word, m - 1 - hi))"))


def groups(words: DataFrame) -> DataFrame:
    """(key, word, n, m, lo, hi): every word in the groups where its near words are, none of them large.

    A word of m letters meets others of m letters, those one shorter, and in the groups of m + 1 those one longer.  Two near
    words share the group whose interval holds the end of their common prefix.
    """
    m = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m")
    whole = words.select("word", "n", m).withColumns({"lo": F.lit(0), "hi": F.col("m") - 1})
    open_, closed = _keyed(whole.select("word", "n", "m", _halves(F.col("lo"), F.col("hi")))), []
    while True:
        width = F.max(F.col("hi") - F.col("lo") + 1)
        sizes = open_.groupBy("key").agg(F.count("*").alias("rows"), width.alias("width"), F.max(F.col("m") == F.char_length("word")).alias("long"))
        crowd = staged(sizes.filter("long and width > 1").filter((F.col("rows") > GROUP_ROWS) | (F.col("rows") * F.col("width") > GROUP_CELLS)).select("key"))
        if crowd.isEmpty():
            return _union([*closed, open_])
        closed.append(open_.join(crowd, "key", "left_anti"))
        open_ = staged(_keyed(open_.join(crowd, "key", "left_semi").select("word", "n", "m", _halves(F.col("lo"), F.col("hi")))))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def matrices(words: list[str], lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each word from ``lo`` to before ``end``, padded: from the left, and backwards from the right."""
    sizes = end - lo
    letters = np.frombuffer("".join([w[a:b] for w, a, b in zip(words, lo.tolist(), end.tolist(), strict=True)]).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(words) else row
    forward = np.zeros((len(words), int(sizes.max(initial=0)) + 1), np.uint8)
    backward = np.zeros_like(forward)
    forward[row, place] = letters
    backward[row, np.repeat(sizes, sizes) - 1 - place] = letters
    return forward, backward


def near_rows(group: np.ndarray, words: list[str], m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group, rows sorted by group, whose words are one edit apart in a place that is the group's."""
    length = np.array([len(w) for w in words], np.int64)
    more = (hi < m - 1).astype(np.int64)       # a letter behind the interval shows whether the common prefix goes on
    longer = length == m
    forward, backward = matrices(words, lo, np.where(longer, hi + 1, hi) + more)
    width = hi - lo + more
    found = []
    at, d = np.arange(len(words)), 0
    while len(at):
        d += 1
        at = at[at + d < len(words)]
        at = at[group[at] == group[at + d]]
        rows = at[longer[at] | longer[at + d]]
        for begin in range(0, len(rows), 8192):
            one = rows[begin:begin + 8192]
            prefix = (forward[one] != forward[one + d]).argmax(axis=1)
            fits = np.flatnonzero(prefix <= (hi - lo)[one])
            one, prefix = one[fits], prefix[fits]
            suffix = (backward[one] != backward[one + d]).argmax(axis=1)
            one = one[prefix + suffix >= width[one]]
            found.append((one, one + d))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _best(words: list[str], n: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """For each row with near rows: the word, how many they are, and the one with most occurrences, ties to the smallest."""
    own, other = np.concatenate([one, two]), np.concatenate([two, one])
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(pa.array(words, pa.large_string())).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(own)]]))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in own[first]], pa.string()), pa.array(counts), pa.array(-n[other[first]]),
         pa.array([words[i] for i in other[first]], pa.string())], ["word", "n_near", "minus_n", "near"])


def compared(grouped: DataFrame) -> DataFrame:
    """(word, n_near, minus_n, near): one row per word and task step in which it has near words."""
    def tile(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        words = table.column("word").to_pylist()
        m, lo, hi, n = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi", "n"))
        return _best(words, n, *near_rows(keys, words, m, lo, hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            width = table.column("hi").to_numpy() - table.column("lo").to_numpy() + 3
            done = 0
            while done < len(cuts):                       # whole groups, as many as the matrices may hold
                at, to = int(cuts[done - 1]) if done else 0, done
                widest = 0
                while to < len(cuts):
                    widest = max(widest, int(width[cuts[to] - 1]))
                    if to > done and (cuts[to] - at) * widest > TILE_CELLS:
                        break
                    to += 1
                yield tile(table.slice(at, int(cuts[to - 1]) - at))
                done = to
            waiting = table.slice(int(cuts[-1])) if len(cuts) else table
        if waiting is not None and waiting.num_rows:
            yield tile(waiting)

    ordered = grouped.repartition("key").sortWithinPartitions("m", "key").select("key", "word", "n", "m", "lo", "hi")
    return ordered.mapInArrow(tidied(run), "word string, n_near long, minus_n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), no form being null: where the forms lead to.  The way still to go halves every round."""
    reached = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(reached.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts and the more frequent spelling that each leads to.

    Runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased.  Where ``one_in`` divides the crc32 h of
    ``<doc_id>:<run>``, the letter at h modulo the run's length is deleted (a null id is written as nothing; 0 turns this
    off).  Words: the results of at least ``least_length`` letters with at least ``least_count`` occurrences, n.  Near words
    differ by one inserted, deleted or replaced letter; n_near counts them.  ``form``: the near word of largest n, ties to
    the smallest, if it has at least twice the word's n, else null; ``form_n`` its n.  ``root``: the last word that forms
    lead to, the word itself without one; n at least doubles on the way, so it ends.

    Null and empty texts have no words; every row counts, copies too; an empty table gives no rows; other columns are not
    read.  What is shuffled: words with counts, words by group, one row per word and step of a task.  No group of more than
    ``GROUP_ROWS`` words is compared, as larger ones are split by further places without losing a pair.
    """
    picked = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"))
    words = staged(word_counts(picked, one_in, least_length, least_count))
    best = F.min(F.struct("minus_n", "near"))
    near = compared(groups(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    has_form = -F.col("best.minus_n") >= 2 * F.col("n")
    found = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.minus_n")).alias("form_n")))
    return found.join(roots(found.filter("form is not null")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
