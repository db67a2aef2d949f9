"""Lexical retrieval packing: documents that share rare terms fill the same training sequences.

Each task cuts its documents into shards of a bounded number and keeps a BM25 inverted index over the token ids of a
shard.  A document opens a window, the index returns the unused neighbours in order of score, and they fill the window
greedily; the one that no longer fits is cut, and its rest stays in the shard.  What is longer than a window fills whole
windows first.  So every window is full but the last of a task, which is cut into lengths that are powers of two.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rowwarden.llm.batches import IS_SPACE, LOWER, Remembered, tidied, utf8
from rowwarden.llm.runs import latin, runs

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
K1, B = 1.2, 0.75
#: Words whose lower-casing and normal form are the same in every library: Latin letters of one code point, then ASCII
#: signs but for the apostrophe, which may begin a contraction.
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
CACHE_BYTES = 40 << 20    # of each of two generations of encoded letters, signs and other words
_EMPTY = np.zeros(0, np.uint32)
_ready: dict[str, "WordEncoder"] = {}


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z, and of those from U+00C0 to U+00FF, where two signs are no letters."""
    inside = latin(data)
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    inside[signs] = inside[signs + 1] = False
    return inside


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with the capitals among the plain letters made small."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[second] += np.where((data[second] <= 0x9E) & (data[second] != 0x97), np.uint8(32), np.uint8(0))
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Stretches of bytes, in order and apart, as numbers into an array of the distinct ones."""
    edges = np.zeros(len(data) + 1, np.int8)
    some = ends > starts
    edges[starts[some]] += 1
    edges[ends[some]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class WordEncoder:
    """Ids of a word-level BPE file: no token reaches across white space, so what is distinct in a batch is encoded once.

    The letters and the signs of plain words are encoded apart, in one call by the same model without its normaliser; all
    other words go through the file's own tokenizer.  A bounded number of bytes of both is remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"].get("end_of_word_suffix")
        self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        if suffix:
            self.closes[[i for p, i in spec["model"]["vocab"].items() if p.endswith(suffix)]] = True
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {
            "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.word_level = bool(suffix)
        self.units, self.others = (Remembered(CACHE_BYTES, lambda word, ids: len(word) + len(ids) + 200) for _ in range(2))

    def _units(self, wanted: list[str]) -> list[bytes]:
        """Ids of letters or signs, as bytes."""
        found = self.units.every(wanted)
        fresh = [i for i, f in enumerate(found) if f is None and wanted[i]]
        if fresh:
            ids = np.array(self.bare.encode_batch_fast([" ".join([wanted[i] for i in fresh])], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(fresh):
                raise ValueError("the vocabulary doesn't close every word with a piece of its own")
            raw, at = ids.tobytes(), 0
            for i, end in zip(fresh, ends, strict=True):
                found[i], at = raw[at:end], end
                self.units.put(wanted[i], found[i])
        return [f or b"" for f in found]

    def _others(self, wanted: list[str]) -> list[bytes]:
        """Ids of whole words by the file's own tokenizer, as bytes."""
        found = self.others.every(wanted)
        fresh = [i for i, f in enumerate(found) if f is None]
        for i, own in zip(fresh, self.full.encode_batch_fast([wanted[i] for i in fresh], add_special_tokens=False), strict=True):
            found[i] = np.array(own.ids, np.uint32).tobytes()
            self.others.put(wanted[i], found[i])
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = utf8(texts)
        n = len(offsets) - 1
        if not len(data):
            yield from [_EMPTY] * n
            return
        starts, ends, text = runs(data, offsets, ~IS_SPACE[data])
        letter = plain_letters(data)
        stops = np.flatnonzero(~letter)
        middle = np.minimum(np.append(stops, len(data))[np.searchsorted(stops, starts)], ends)
        # Behind its letters a plain word has signs only, and no "<|", which may begin a special token.
        later = np.flatnonzero(~_SIGN[data])
        signs_to = np.append(later, len(data))[np.searchsorted(later, middle)]
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        plain = (middle > starts) & (signs_to >= ends) & (np.append(marks, len(data))[np.searchsorted(marks, starts)] >= ends) & self.word_level
        small = lowered(data)
        letters, names = spans(small, starts[plain], middle[plain])
        signs, marks = spans(data, middle[plain], ends[plain])
        whole, words = spans(data, starts[~plain], ends[~plain])
        ids = [*self._units(names.to_pylist()), *self._units(marks.to_pylist()), *self._others(words.to_pylist()), b""]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        parts = np.full((len(starts), 2), len(ids) - 1)
        parts[plain, 0], parts[plain, 1], parts[~plain, 0] = letters, len(names) + signs, len(names) + len(marks) + whole
        own = sizes[parts]
        parts, each = parts.reshape(-1), own.reshape(-1)
        places = np.arange(each.sum()) + np.repeat(begin[parts] - (np.cumsum(each) - each), each)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(text, own.sum(axis=1), minlength=n).astype(np.int64))])
        every = flat[places]
        for a, b in itertools.pairwise(bounds.tolist()):
            yield every[a:b]


def word_encoder(path: str) -> WordEncoder:
    if path not in _ready:
        _ready[path] = WordEncoder(path)
    return _ready[path]


class Shard:
    """Unused rests of documents with a BM25 inverted index over their ids."""

    def __init__(self, items: list[tuple]) -> None:
        self.items = items
        n = len(items)
        counted = [np.unique(ids, return_counts=True) for _, _, ids, _ in items]
        self.terms = [t for t, _ in counted]
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term = np.concatenate(self.terms) if n else np.zeros(0, np.uint32)
        tf = np.concatenate([c for _, c in counted]).astype(np.float64) if n else np.zeros(0)
        doc = np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=1)
        # Terms of half the shard or more carry no weight, so their postings are not kept.
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
        lengths = np.array([len(ids) for _, _, ids, _ in items], np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(lengths.mean() if n else 1, 1)))
        keep = idf[term] > 0
        order = np.argsort(term[keep], kind="stable")
        self.doc, self.weight = doc[keep][order], weight[keep][order]
        self.begin = np.concatenate([[0], np.cumsum(np.where(idf > 0, df, 0))])
        self.used = np.zeros(n, bool)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed].astype(np.int64)
        a, b = self.begin[terms], self.begin[terms + 1]
        sizes = b - a
        at = np.arange(sizes.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        scores = np.bincount(self.doc[at], self.weight[at], minlength=len(self.items))
        scores[self.used] = -1
        return scores


def pack_shard(items: list[tuple], window: int, put: Callable, whole: bool) -> list[tuple]:
    """Fill windows from a shard.  Items are (doc_id, start, ids, doc_tokens), shorter than a window.

    Unless ``whole``, what doesn't fill a window is returned; else it is put into sequences of a power of two each.
    """
    shard = Shard(items)
    left = list(items)
    total = sum(len(x[2]) for x in items)
    for seed in range(len(items)):
        if shard.used[seed] or total < window:
            continue
        shard.used[seed] = True
        group, free = [left[seed]], window - len(left[seed][2])
        scores = shard.scores(seed) if free else None
        while free:
            best = int(scores.argmax())
            doc, start, ids, n = left[best]
            group.append((doc, start, ids[:free], n))
            if len(ids) > free:
                left[best] = (doc, start + free, ids[free:], n)
                free = 0
            else:
                shard.used[best] = True
                scores[best] = -1
                free -= len(ids)
        put(group)
        total -= window
    rest = [x for x, used in zip(left, shard.used, strict=True) if not used]
    if not whole:
        return rest
    size = window
    while rest:
        while size > total:
            size //= 2
        group, free = [], size
        while free:
            doc, start, ids, n = rest.pop(0)
            group.append((doc, start, ids[:free], n))
            if len(ids) > free:
                rest.insert(0, (doc, start + free, ids[free:], n))
            free -= min(free, len(ids))
        put(group)
        total -= size
    return []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, shard_docs: int = 768,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``window`` ids (a power of two).

    A document is its ids by the word-level BPE file at path ``tokenizer`` followed by ``end_id``; a null or empty text
    is ``end_id`` alone.  One row per piece: the document, where in it the piece starts, its length, the CRC-32 of its
    ids as little-endian 32-bit numbers, the ids of the whole document, the sequence and the place in it.  Every id
    lies in exactly one piece; sequences have no gaps.  All are ``window`` long, except that the last ids of a task
    are put into sequences of smaller powers of two.  Repeated rows and null ids are packed like any others, other
    columns are not read, an empty table gives no rows.  No shuffle: a shard is ``shard_docs`` rows that lie together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def put(group: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, n in group:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, at))
                at += len(ids)
            sequence += 1

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return batch

        waiting: list[tuple] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), 1024):
                for doc, own in zip(names[at:at + 1024], encoder.encode(batch.column(1).slice(at, 1024)), strict=True):
                    ids = np.concatenate([own, end])
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        put([(doc, start, ids[start:start + window], len(ids))])
                    if whole < len(ids):
                        waiting.append((doc, whole, ids[whole:].copy(), len(ids)))
                if len(waiting) >= shard_docs:
                    waiting = pack_shard(waiting, window, put, whole=False)
                if rows:
                    yield taken()
        if waiting:
            pack_shard(waiting, window, put, whole=True)
        if rows:
            yield taken()

    if window & (window - 1):
        raise ValueError("window must be a power of two")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidied(run), SCHEMA)
