"""Byte-level BPE of whole texts from content-defined chunks that are encoded once.

A rolling hash over 16 bytes chooses where a text is cut, so passages that documents share are cut alike wherever they
stand.  The inner part of a chunk is encoded once and its ids are reused for every later document of the task that
holds it.  At the joins the encoding may differ from that of the whole text, so the stretch around each join is encoded
again, and grows over as many chunks as it takes until both its ends lie where the encoding of the whole text provably
agrees with that of its parts: between a visible ASCII sign and a following blank or line feed, where no token can
reach across.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowwarden.llm.batches import tidied, utf8
from rowwarden.llm.token_counts import AS_CHAR

CHUNK_BITS = 9          # a cut every 512 bytes on average
BATCH_BYTES = 2 << 20   # texts encoded at once
CACHE_BYTES = 24 << 20  # of each of two generations of encoded chunks
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
AS_BYTE = {chr(c): b for b, c in AS_CHAR.items()}
_ready: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Where content-defined chunks end: positions whose hash of the 16 bytes before has its top bits zero."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cuts = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    return cuts[(cuts >= 16) & (cuts < len(data))]


def marks_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the inner parts of the chunks and the stretches around the joins begin and end, for texts that lie in a row."""
    blank = (data == 32) | (data == 10)
    safe = np.flatnonzero(blank[1:] & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    cuts = rolling_cuts(data)
    own = np.searchsorted(offsets, cuts, "right") - 1
    begin, end = offsets[own], offsets[np.minimum(own + 1, len(offsets) - 1)]
    # The hash sees 16 bytes, so from the sixteenth byte of a text on it is that of the text alone.
    inside = (cuts - begin >= 16) & (cuts < end)
    cuts, begin, end = cuts[inside], begin[inside], end[inside]
    # The last safe place up to a cut ends an inner part, the first one from the cut on begins the next.  Those of other
    # texts give way to the ends of the text, which are marks in any case.
    known = np.concatenate([[0], safe, [len(data)]])
    left = known[np.searchsorted(known, cuts, "right") - 1]
    right = known[np.searchsorted(known, cuts, "left")]
    return np.unique(np.concatenate([offsets, np.maximum(left, begin), np.minimum(right, end)]))


def pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """The inner parts of the chunks and the stretches around the joins, in order; together the whole text."""
    return list(itertools.pairwise(marks_of(data, np.array([0, len(data)])).tolist()))


def token_bytes(token: str) -> bytes:
    """The bytes a byte-level token stands for; one with a character that stands for no byte is taken as it is."""
    own = [AS_BYTE.get(c) for c in token]
    return token.encode() if None in own else bytes(own)


class ChunkCache:
    """Encoded chunks: number of ids, the ids as text, the decoded bytes (None where they equal the chunk).

    Two generations of bounded size; what is not met again while one fills up is forgotten.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [str(i) for i in range(size)]
        self.bytes = [token_bytes(self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.size = 0

    def encode(self, wanted: list[bytes]) -> dict[bytes, tuple]:
        found, missing = {}, []
        for chunk in dict.fromkeys(wanted):
            hit = self.young.get(chunk) or self.old.get(chunk)
            if hit is None:
                missing.append(chunk)
            else:
                found[chunk] = hit
                self._keep(chunk, hit)
        encoded = self.tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False)
        for chunk, own in zip(missing, [e.ids for e in encoded], strict=True):
            back = b"".join(map(self.bytes.__getitem__, own))
            if back != chunk:  # not the text itself: the library says what it decodes to
                back = self.tokenizer.decode(own, skip_special_tokens=False).encode()
            found[chunk] = hit = (len(own), ",".join(map(self.names.__getitem__, own)).encode(), None if back == chunk else back)
            self._keep(chunk, hit)
        return found

    def _keep(self, chunk: bytes, hit: tuple) -> None:
        if chunk not in self.young:
            self.young[chunk] = hit
            self.size += len(chunk) + len(hit[1]) + 200
            if self.size > CACHE_BYTES:
                self.old, self.young, self.size = self.young, {}, 0


def _cache(path: str) -> ChunkCache:
    if path not in _ready:
        _ready[path] = (ChunkCache(path),)
    return _ready[path][0]


def digests(cache: ChunkCache, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str]]:
    """Of each text: number of ids, digest of the ids, digest of the decoded text."""
    raw, marks = data.tobytes(), marks_of(data, offsets)
    every = [raw[a:b] for a, b in itertools.pairwise(marks.tolist())]
    known = cache.encode(every)
    for a, b in itertools.pairwise(np.searchsorted(marks, offsets).tolist()):
        own = every[a:b]
        hits = [known[p] for p in own]
        ids = b",".join([h[1] for h in hits if h[0]])
        decoded = b"".join([p if h[2] is None else h[2] for p, h in zip(own, hits, strict=True)])
        yield sum(h[0] for h in hits), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text with the byte-level tokenizer file at path ``tokenizer``.

    Returns per row the number of ids, the SHA-256 of the ids in decimal joined by commas, and that of the decoded text.
    Null counts as empty: no ids.  Special-token strings inside a text become their ids, as the tokenizers library does
    by default.  Repeated rows give repeated rows, a null id stays null, other columns are not read.  No shuffle:
    chunks are shared among the documents of a task; sending their ids between tasks would cost more than encoding.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
                to = min(to, batch.num_rows)
                rows = list(digests(cache, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = to

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidied(run), SCHEMA)
