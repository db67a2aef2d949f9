"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Counts come first: words over all training documents, and from them the subword ids of a public byte-level vocabulary.
The ids are put into classes by count and by whether they begin a word.  The model reads the ids before a place and
gives the class of the next one; within a class, ids have the frequencies of the corpus.  It learns from all training
documents, each in one of the rounds; trainers, more of them for more words, work on their parts side by side and their
parameters are averaged after each round.  In the last round every window is judged before it is learned from; that fixes
the model's weight beside the frequencies of whole words.  For scoring, a text's ids are cut into windows that overlap: each begins with context
that is only read, so every id is scored exactly once, with batched, masked attention.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import IS_SPACE, staged, staged_for_now, tidied, utf8
from rowwarden.llm.runs import coded, portions, runs

DIM, CLASSES, OWN_CLASS, OWN_ROW = 16, 64, 32, 2048
CONTEXT, SCORED = 16, 32          # ids of a window that are read only, and that are scored
SPAN = CONTEXT + SCORED
BATCH = 64                        # windows at once
ROUNDS, TRAINERS = 4, 8
TRAINER_WORDS = 2_000_000
KNOWN_SHARE = 4e-6                # words at least so frequent have their count sent to all tasks: 250,000 at most
LEXICON_BYTES = 48 << 20          # of the words that a task numbers for good
COUNTED, PORTION = 8 << 20, 2 << 20  # bytes of texts counted, and laid out, at once
QUEUED = 4096                     # windows that are mixed in training
LN10 = math.log(10)
WEIGHTS = np.arange(1, 32) / 32   # of the attention model in the mixture, to choose from
_encoders: dict[str, tuple] = {}


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Runs without ASCII white space, A-Z as a-z: all words of all texts as numbers into the distinct ones, those, and the
    text of each."""
    data, offsets = utf8(texts)
    inside = ~IS_SPACE[data]
    starts, stops, of = runs(data, offsets, inside)
    return *coded(data, inside, stops - starts), of


class Subwords:
    """Ids of words under a byte-pair ranks file, each word as it stands after a blank; the id after all ranks ends a text."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        text = " ".join(found)
        # In one call where no word holds white space of another kind, so that each begins at an id with a blank.
        if len(text.split()) == len(found):
            ids = np.array(self.coder.encode_ordinary(" " + text), np.int32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(found):
                return ids, np.diff(first, append=len(ids))
        plain = np.array([len(w.split()) == 1 for w in found], bool)
        if plain.any() and not plain.all():
            return self._mixed(found, plain)
        coded_words = [self.coder.encode_ordinary(" " + w) for w in found]
        return np.array([i for x in coded_words for i in x], np.int32), np.array([len(x) for x in coded_words], np.int64)

    def _mixed(self, found: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, parts = np.zeros(len(found), np.int64), []
        for side in (plain, ~plain):
            ids, sizes[side] = self.of([found[i] for i in np.flatnonzero(side)])
            parts.append(ids)
        flat, of = np.zeros(sizes.sum(), np.int32), np.repeat(plain, sizes)
        flat[of], flat[~of] = parts
        return flat, sizes


class Lexicon:
    """Numbers for words, with their ids and what is known of them laid out in arrays, for whole batches at a time.

    Once ``LEXICON_BYTES`` are taken, the words of each batch that are new are numbered for that batch only.
    """

    def __init__(self, coder: Subwords, often: dict[str, int]) -> None:
        self.coder, self.often = coder, often
        self.known = pa.array([], pa.large_string())
        self.room = LEXICON_BYTES
        self.flat, self.sizes, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)

    def _laid_out(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = self.coder.of(new)
        return (np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes]),
                np.concatenate([self.counts, np.array([self.often.get(w, 0) for w in new], float)]))

    def look_up(self, distinct: pa.Array) -> tuple:
        """Numbers of distinct words, and the arrays they point into: ids, first places, sizes, counts."""
        at = pc.index_in(distinct, value_set=self.known)
        fresh_words = distinct.filter(at.is_null())
        found = at.fill_null(-1).to_numpy().astype(np.int64)
        found[found < 0] = len(self.known) + np.arange(len(fresh_words))
        new = fresh_words.to_pylist()
        flat, sizes, counts = self._laid_out(new) if new else (self.flat, self.sizes, self.counts)
        taken = sum(map(len, new)) + 200 * len(new)
        if taken <= self.room:
            self.known = pa.concat_arrays([self.known, fresh_words])
            self.flat, self.sizes, self.counts = flat, sizes, counts
            self.room -= taken
        return found, flat, np.cumsum(sizes) - sizes, sizes, counts

    def lay_out(self, texts: pa.Array) -> Laid:
        """The ids of all texts in a row, the end after each text: the end is a word of one id."""
        own, distinct, of = words(texts)
        found, flat, starts, sizes, counts = self.look_up(distinct)
        n_words = np.bincount(of, minlength=len(texts))
        ends_at = np.cumsum(n_words + 1) - 1
        is_end = np.zeros(len(own) + len(texts), bool)
        is_end[ends_at] = True
        length = np.ones(len(is_end), np.int64)
        length[~is_end] = sizes[found][own]
        stop = np.cumsum(length)
        begin = stop - length
        # Place in ``flat`` of every id: that of its word's first, and on from there.
        ids = np.full(stop[-1] if len(stop) else 0, self.coder.end, np.int64)
        inner = np.ones(len(ids), bool)
        inner[begin[ends_at]] = False
        from_begin = np.zeros(len(is_end), np.int64)
        from_begin[~is_end] = starts[found][own]
        ids[inner] = flat[(np.arange(len(ids)) + np.repeat(from_begin - begin, length))[inner]]
        known = np.zeros(len(is_end))
        known[~is_end] = counts[found][own]
        number = np.full(len(is_end), -1, np.int64)
        number[~is_end] = own
        return Laid(ids, begin, stop[ends_at], n_words, is_end, known, np.repeat(np.arange(len(texts)), n_words + 1), number, distinct)


@dataclass
class Laid:
    """Texts as ids in a row: where words and ends begin in them, where texts end; of every word and end: whether it is an
    end, its count if known, its text, and its place among the distinct words (-1: an end)."""

    ids: np.ndarray
    begin: np.ndarray
    text_ends: np.ndarray
    n_words: np.ndarray
    is_end: np.ndarray
    count: np.ndarray
    text: np.ndarray
    number: np.ndarray
    distinct: pa.Array


def subwords(path: str, pattern: str) -> Subwords:
    if path not in _encoders:
        _encoders[path] = (Subwords(path, pattern),)
    return _encoders[path][0]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over whole texts; the end of each text counts as the word null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0, COUNTED):
                own, distinct, _ = words(part.column(0))
                n = np.append(np.bincount(own, minlength=len(distinct)), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([distinct.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(n, pa.int64())], ["word", "n"])

    return texts.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_ids(counts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """How often each subword id occurs; as many numbers as the vocabulary has ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path, pattern)
        total = np.zeros(coder.size, np.int64)
        for batch in batches:
            n, whole = (batch.column(i) for i in (1, 0))
            ids, sizes = coder.of(whole.drop_null().to_pylist())
            n, ends = n.to_numpy(), whole.is_null().to_numpy(zero_copy_only=False)
            np.add.at(total, ids, np.repeat(n[~ends], sizes))
            total[coder.end] += n[ends].sum()
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    total = np.zeros(subwords(path, pattern).size, np.int64)
    for row in counts.mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    return total


@dataclass
class Tables:
    """Class of every id, its input row, and its log probability within the class."""

    class_of: np.ndarray
    row_of: np.ndarray
    within: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, begins: np.ndarray) -> Tables:
        order = np.argsort(-counts, kind="stable")
        class_of = np.empty(len(counts), np.int64)
        class_of[order[:OWN_CLASS]] = np.arange(OWN_CLASS)
        bands = (CLASSES - OWN_CLASS) // 2
        for side in (False, True):  # within each side, classes of about equal mass by falling count
            own = order[OWN_CLASS:][begins[order[OWN_CLASS:]] == side]
            mass = np.cumsum(counts[own] + 1.0)
            band = np.minimum((mass / mass[-1] * bands).astype(int), bands - 1) if len(own) else mass.astype(int)
            class_of[own] = OWN_CLASS + bands * side + band
        row_of = OWN_ROW + class_of
        row_of[order[:OWN_ROW]] = np.arange(min(OWN_ROW, len(counts)))
        sums = np.bincount(class_of, counts + 1.0, minlength=CLASSES)
        within = np.log((counts + 1.0) / sums[class_of]).astype(np.float32)
        return cls(class_of, row_of, within, np.log((sums + 1.0) / (sums + 1.0).sum()).astype(np.float32))


Parameters = dict[str, np.ndarray]


def fresh(prior: np.ndarray) -> Parameters:
    """Parameters to start from: at first every class has its frequency in the corpus."""
    rng = np.random.default_rng(3)
    draw = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
    return {"rows": draw(OWN_ROW + CLASSES, DIM), "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM),
            "near": np.linspace(0, -2, SPAN, dtype=np.float32), "out": draw(DIM, CLASSES) * 0.2, "prior": prior.copy()}


_AGO = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
_LATER = _AGO < 0
_BACK, _NOW = np.maximum(_AGO[CONTEXT:], 0).ravel(), ~_LATER[CONTEXT:].ravel()
_SCALE = np.float32(DIM ** -0.5)
_ONES = np.ones(BATCH * SCORED, np.float32)


def ahead(p: Parameters) -> np.ndarray:
    """Query and key projection in one: an input row times this meets the other input rows as they are."""
    return p["q"] @ p["k"].T * _SCALE


def _mask(p: Parameters) -> np.ndarray:
    return np.where(_NOW, p["near"][_BACK], np.float32(-1e9)).reshape(SCORED, SPAN)


def _masked(scores: np.ndarray, mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``scores`` where places see neither what is later nor padding before a text; padding behind it is later."""
    scores += mask
    padded = np.flatnonzero(rows[:, 0] < 0)
    scores[padded] += np.where(rows[padded] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    return scores


def _exponentials(make: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows of scores and their sums.  The scores, made anew then, are shifted only if they are no small numbers."""
    e = make()
    with np.errstate(over="ignore"):
        np.exp(e, out=e)
        sums = e.reshape(-1, e.shape[-1]) @ _ONES[:e.shape[-1]]
    if len(sums) and not (sums.min() > 1e-20 and sums.max() < 1e20):
        e = make()
        e -= e.max(axis=-1, keepdims=True)
        np.exp(e, out=e)
        sums = e.reshape(-1, e.shape[-1]) @ _ONES[:e.shape[-1]]
    return e, sums[:, None]


def _attended(p: Parameters, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Attention over windows of input rows, -1 is padding: the state at the last ``SCORED`` places, and what led to it."""
    x = p["rows"].take(np.maximum(rows, 0), axis=0)
    late, keys = np.ascontiguousarray(x[:, CONTEXT:]), np.ascontiguousarray(x.transpose(0, 2, 1))
    q = (late.reshape(-1, DIM) @ ahead(p)).reshape(late.shape)
    a, sums = _exponentials(lambda: _masked(q @ keys, _mask(p), rows))
    late = late.reshape(-1, DIM)
    mean = (a @ x).reshape(-1, DIM)
    mean /= sums
    h = mean @ p["v"]
    h += late
    return {"x": x, "keys": keys, "late": late, "q": q, "a": a, "sums": sums, "mean": mean, "h": h}


def forward(p: Parameters, rows: np.ndarray, used: np.ndarray) -> dict[str, np.ndarray]:
    """Log probabilities of the next class at those of the last ``SCORED`` places of windows of input rows that are ``used``."""
    f = _attended(p, rows)
    z = f["h"][used] @ p["out"]
    z += p["prior"]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return f | {"z": z}


def gradients(p: Parameters, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, Parameters, np.ndarray]:
    """On windows whose scored places want ``classes`` (-1: none): the probability of each wanted class, gradients of their
    mean loss, and the input rows that ``rows`` among the gradients belongs to."""
    want = classes.reshape(-1)
    at = np.arange(len(want))
    f = _attended(p, rows)
    q, a, mean, h = f["q"], f["a"], f["mean"], f["h"]
    # Gradients at the classes are ``dz * each``, never multiplied out; places that want none have an ``each`` of nought.
    dz, sums = _exponentials(lambda: h @ p["out"] + p["prior"])
    chance = dz[at, want] / sums[:, 0]
    dz[at, want] -= sums[:, 0]
    each = np.where(want >= 0, 1 / max(1, np.count_nonzero(want >= 0)), 0).astype(np.float32)[:, None] / sums
    dh = dz @ p["out"].T
    dh *= each
    dmean = dh @ p["v"].T
    g = {"out": (h * each).T @ dz, "prior": each[:, 0] @ dz, "v": mean.T @ dh}
    # What a place's weights have in common is its gradient times its mean; ``a`` is without its sums.
    dmean /= f["sums"]
    common = np.einsum("ij,ij->i", dmean, mean)
    dmean = dmean.reshape(q.shape)
    ds = dmean @ f["keys"]
    ds -= common.reshape(len(rows), SCORED, 1)
    ds *= a
    dq = (ds @ f["x"]).reshape(-1, DIM)
    both = f["late"].T @ dq * _SCALE
    g |= {"q": both @ p["k"], "k": both.T @ p["q"]}
    dx = ds.transpose(0, 2, 1) @ q
    dx += a.transpose(0, 2, 1) @ dmean
    dh += dq @ ahead(p).T
    dx[:, CONTEXT:] += dh.reshape(q.shape)
    g["near"] = np.bincount(_BACK, (_ONES[:len(rows)] @ ds.reshape(len(rows), -1)) * _NOW, minlength=SPAN).astype(np.float32)
    # Padding has gradients of nought, so it doesn't matter that it counts as the first row here.
    own = np.maximum(rows, 0).ravel().astype(np.int16)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    g["rows"] = np.add.reduceat(dx.reshape(-1, DIM).take(order, axis=0), first, axis=0)
    return chance, g, own[first].astype(np.int64)


def framed(ids: np.ndarray, ends: np.ndarray, tables: Tables, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie in a row, each up to its place in ``ends``: input rows (-1: none), wanted classes (-1: none),
    the place of every id among all scored places, and windows of each text."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - begins
    counts = -(-sizes // SCORED)
    first = np.cumsum(counts) - counts
    # Scored places of all windows in a row, texts padded to whole windows.
    place = np.arange(len(ids)) + np.repeat(first * SCORED - begins, sizes)
    want = np.full(counts.sum() * SCORED, -1, np.int64)
    want[place] = tables.class_of[ids]
    given = np.full(len(want), -1, np.int64)
    before = np.concatenate([[end], ids[:-1]])
    before[begins] = end
    given[place] = tables.row_of[before]
    given, want = given.reshape(-1, SCORED), want.reshape(-1, SCORED)
    rows = np.full((len(given), SPAN), -1, np.int64)
    rows[:, CONTEXT:] = given
    rows[1:, :CONTEXT] = given[:-1, SCORED - CONTEXT:]
    rows[first, :CONTEXT] = -1
    return rows, want, place, counts


def windows(ids: np.ndarray, tables: Tables, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows (-1: none), wanted classes (-1: none) and scored ids of the windows of a text."""
    return *framed(ids, np.array([len(ids)]), tables, end)[:2], ids


def mixed_logs(alone: np.ndarray, weight: float, share: np.ndarray) -> np.ndarray:
    """Natural log probabilities of words: the attention model's ``alone``, mixed with their ``share`` of all tokens."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(alone + math.log(weight), np.log(share * (1 - weight)) if weight < 1 else -np.inf)


def occurrences(laid: Laid) -> np.ndarray:
    """How often each word occurs in its own text; an end does once."""
    _, found, n = np.unique(laid.text * (len(laid.distinct) + 1) + laid.number + 1, return_inverse=True, return_counts=True)
    return n[found]


def train(sample: DataFrame, tables: Tables, start: Parameters, path: str, pattern: str, trainers: int,
          known: tuple[dict[str, int], int, int] | None = None, judged: Callable[[DataFrame], None] | None = None) -> Parameters:
    """Rounds of side-by-side training on (part, text), parameters averaged by number of windows after each round.

    With ``known`` (counts of frequent words, of ends, of all tokens), what the last round's texts say of the mixture is given
    to ``judged``: for each place in ``WEIGHTS`` its log likelihood as (-1 - i, x), and (word, log, own, size) of the other words.
    """
    names = list(start)
    context = sample.sparkSession.sparkContext

    def run_with(shared, step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = subwords(path, pattern)
            own, fixed, counts_of = shared.value
            p = {k: v.copy() for k, v in own.items()}
            seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}
            lexicon, done, likely = Lexicon(coder, counts_of[0] if counts_of else {}), 0, np.zeros(len(WEIGHTS))
            for batch in batches:
                for part in portions(batch, 0, PORTION):
                    laid = lexicon.lay_out(part.column(0))
                    rows, want, place, counts = framed(laid.ids, laid.text_ends, fixed, coder.end)
                    chance = np.zeros(want.shape, np.float32)
                    # Whole texts at a time, up to some thousands of windows.
                    ends, at = np.cumsum(counts), 0
                    while at < len(rows):
                        to = int(ends[min(np.searchsorted(ends, at + QUEUED), len(ends) - 1)])
                        chance[at:to] = learn(p, seen, rows[at:to], want[at:to], step)
                        at = to
                    done += len(rows)
                    if counts_of:
                        logs = np.log(np.maximum(chance.reshape(-1)[place], np.float32(1e-30))) + fixed.within[laid.ids]
                        gained, other = judge(laid, np.add.reduceat(logs.astype(np.float64), laid.begin), *counts_of[1:])
                        likely += gained
                        yield other
            if done:
                flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float64)
                yield _evidence(i=np.arange(len(flat)), x=flat * done, w=np.full(len(flat), float(done)))
                if counts_of:
                    yield _evidence(i=-1 - np.arange(len(likely)), x=likely)
        return run

    p = start
    for step in range(ROUNDS):
        last = known is not None and step == ROUNDS - 1
        shared = context.broadcast((p, tables, known if last else None))
        part = sample.filter(F.col("round") == step).select("part", "text").repartition(trainers, "part").select("text")
        found = part.mapInArrow(tidied(run_with(shared, step)), EVIDENCE)
        means = lambda d: d.filter("i >= 0").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).collect()
        if last:
            with staged_for_now(found) as kept:
                judged(kept)
                rows = means(kept)
        else:
            rows = means(found)
        if rows:
            flat = np.zeros(len(rows), np.float32)
            flat[[r["i"] for r in rows]] = [r["x"] for r in rows]
            ends = np.cumsum([start[k].size for k in names])
            p = {k: flat[b - start[k].size:b].reshape(start[k].shape) for k, b in zip(names, ends, strict=True)}
        shared.unpersist()
    return p


EVIDENCE = "i long, x double, w double, word string, log float, own int, size int"
_EVIDENCE = pa.schema([("i", pa.int64()), ("x", pa.float64()), ("w", pa.float64()), ("word", pa.string()), ("log", pa.float32()),
                       ("own", pa.int32()), ("size", pa.int32())])


def _evidence(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([pa.array(given[f.name]).cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in _EVIDENCE],
                                      schema=_EVIDENCE)


def judge(laid: Laid, alone: np.ndarray, ends: int, total: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Log likelihood of words and ends at each of ``WEIGHTS``, and the words whose counts aren't known here.

    A text is left out of the counts that it is judged by, so a word that no other text holds has no share.
    """
    own, size = occurrences(laid), (laid.n_words + 1)[laid.text]
    n = np.where(laid.is_end, ends, laid.count)
    here = (n > 0) | laid.is_end
    share = np.maximum(n - own, 0)[here] / np.maximum(total - size[here], 1)
    other, met = np.flatnonzero(~here), share > 0
    # Logarithms of products of eight; with a share, none is near the least number there is.
    given, share = np.exp(alone[here][met]), share[met]
    eights = [np.pad(x, (0, -len(x) % 8), constant_values=1).reshape(8, -1) for x in (given, share)]
    return (np.array([np.log(np.prod(eights[0] * g + eights[1] * (1 - g), axis=0)).sum() for g in WEIGHTS])
            + alone[here][~met].sum() + np.count_nonzero(~met) * np.log(WEIGHTS),
            _evidence(word=laid.distinct.take(pa.array(laid.number[other])), log=alone[other], own=own[other], size=size[other]))


def fitted(judged: DataFrame, counts: DataFrame, total: int) -> float | None:
    """The weight under which the judged words are likeliest; None if none were."""
    likely = np.zeros(len(WEIGHTS))
    found = judged.filter("i < 0").groupBy("i").agg(F.sum("x").alias("x")).collect()
    for r in found:
        likely[-1 - r["i"]] += r["x"]
    share = F.greatest(F.col("n") - F.col("own"), F.lit(0)) / F.greatest(F.lit(total) - F.col("size"), F.lit(1))
    words_by = judged.filter("word is not null").join(counts.hint("shuffle_hash"), "word").select("log", share.alias("share"))
    each = [F.when(F.col("share") > 0, F.log(F.exp("log") * float(g) + F.col("share") * float(1 - g))).otherwise(F.col("log") + math.log(g)) for g in WEIGHTS]
    rest = words_by.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in each]).first()
    return float(WEIGHTS[np.argmax(likely + np.array(rest))]) if found else None


def learn(p: Parameters, seen: Parameters, rows: np.ndarray, classes: np.ndarray, step: int) -> np.ndarray:
    """Steps of Adagrad over windows, in a mixed order; returns the probability that each wanted class had before its step."""
    order = np.random.default_rng(step).permutation(len(rows))
    chance = np.zeros((len(rows), SCORED), np.float32)
    for at in range(0, len(order), BATCH):
        own = order[at:at + BATCH]
        got, g, touched = gradients(p, rows[own], classes[own])
        chance[own] = got.reshape(-1, SCORED)
        for name, d in g.items():
            where = touched if name == "rows" else slice(None)
            sums = seen[name][where] + d * d
            seen[name][where] = sums
            p[name][where] -= np.float32(0.08 if name == "rows" else 0.03) * d / np.sqrt(sums)
    return chance


class Scorer:
    """The model for scoring only: queries of every input row and the mask are computed once."""

    def __init__(self, p: Parameters, tables: Tables) -> None:
        self.tables = tables
        self.x = np.concatenate([p["rows"], np.zeros((1, DIM), np.float32)])  # the last stands for padding
        self.q, self.v, self.mask = self.x @ ahead(p), p["v"], _mask(p)
        self.out, self.prior, self.odds = p["out"], p["prior"], np.exp(p["prior"])

    def classes(self, rows: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Log probability of the wanted class at each scored place; at places that want none, of class 0."""
        x = self.x.take(rows, axis=0, mode="wrap")
        # Scores are small numbers, so their exponentials need no shift; a place always sees itself.
        s = _masked(self.q.take(rows[:, CONTEXT:], axis=0, mode="wrap") @ np.ascontiguousarray(x.transpose(0, 2, 1)), self.mask, rows)
        np.exp(s, out=s)
        h = (s @ x).reshape(-1, DIM)
        h /= (s.reshape(-1, SPAN) @ _ONES[:SPAN])[:, None]
        h = h @ self.v
        h += x[:, CONTEXT:].reshape(-1, DIM)
        z = h @ self.out
        at = np.maximum(want.reshape(-1), 0)
        got = z[np.arange(len(z)), at] + self.prior[at]
        np.exp(z, out=z)
        return (got - np.log(z @ self.odds)).reshape(want.shape)

    def ids(self, ids: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
        """Natural log probability of every id of texts that lie in a row, each up to its place in ``ends``."""
        rows, want, place, _ = framed(ids, ends, self.tables, end)
        logs = np.concatenate([self.classes(rows[at:at + BATCH], want[at:at + BATCH]) for at in range(0, len(rows), BATCH)])
        return logs.reshape(-1)[place] + self.tables.within[ids]


def score_texts(docs: DataFrame, held_out: Column, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` is false.  Tokens are runs without ASCII white space, A-Z as a-z, and one
    end per text.  ``base_score`` is the add-one unigram model over the training tokens; ``score`` the log10 probability
    of the same tokens by the attention model: of each word as its subword ids, mixed with its frequency in training as
    a whole word.  The attention model's weight is the one of ``WEIGHTS`` under which the training texts of the last round
    are likeliest, each of their windows judged before the model learns from it and by counts without its own text; it is a
    half if there are none.  A null or empty text is an end alone.  With no training rows the model knows no
    counts and all ids of a class are alike.  Repeated rows give repeated rows, a null id stays null, other columns are
    not read.
    """
    context = docs.sparkSession.sparkContext
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = staged(count_words(picked.filter(~F.col("held_out")).select("text")))
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    coder = subwords(path, pattern)
    tables = Tables.of(count_ids(counts, path, pattern), coder.begins)
    trainers = max(TRAINERS, math.ceil(total / TRAINER_WORDS))
    # Dealt by row, so that copies of a text, or rows that share an id, are spread over rounds and trainers.
    rows = picked.filter(~F.col("held_out") & F.col("text").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    dealt = lambda seed: F.xxhash64("doc_id", "text", "row", F.lit(seed))
    often = {r["word"]: r["n"] for r in counts.filter((F.col("n") >= max(2, KNOWN_SHARE * total)) & F.col("word").isNotNull()).collect()}
    ends = counts.filter("word is null").select("n").first()
    ends = ends["n"] if ends else 0
    whole = counts.filter("word is not null")
    weights: list[float | None] = []
    with staged_for_now(rows.select("text", F.pmod(dealt(9), F.lit(ROUNDS)).alias("round"), dealt(10).alias("part"))) as sample:
        model = train(sample, tables, fresh(tables.prior), path, pattern, trainers, (often, ends, total),
                      lambda judged: weights.append(fitted(judged, whole, total)))
    mix = ((weights[0] if weights else None) or 0.5) if total else 1.0
    shared = context.broadcast((model, tables, often, ends, total, distinct, mix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fixed, often, ends, total, distinct, mix = shared.value
        coder = subwords(path, pattern)
        scorer, lexicon = Scorer(own, fixed), Lexicon(coder, often)
        bottom = math.log10(total + distinct + 1)
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                names, texts, held = part.columns
                laid = lexicon.lay_out(texts)
                logs = scorer.ids(laid.ids, laid.text_ends, coder.end)
                alone = np.add.reduceat(logs.astype(np.float64), laid.begin)
                n = np.where(laid.is_end, ends, laid.count)
                here = (n > 0) | laid.is_end
                mixed = mixed_logs(alone, mix, n / max(1, total))
                sums = lambda x: np.bincount(laid.text, np.where(here, x, 0.0), minlength=len(texts))
                base = sums(np.log10(n + 1)) - (laid.n_words + 1) * bottom
                often_n = np.bincount(laid.text, here & (n > 0), minlength=len(texts)).astype(np.int64)
                # Words not known to be frequent: listed with each occurrence's own log probability.
                rare_at = np.flatnonzero(~here)
                cells = pa.StructArray.from_arrays([laid.distinct.take(pa.array(laid.number[rare_at])).cast(pa.string()), pa.array(alone[rare_at].astype(np.float32))], ["word", "log"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(laid.text[rare_at], minlength=len(texts)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(laid.n_words + 1), pa.array(often_n), pa.array(base), pa.array(sums(mixed) / LN10),
                     pa.ListArray.from_arrays(pa.array(offsets), cells), held],
                    ["doc_id", "n_tokens", "n_often", "base", "score", "rare", "held_out"])

    schema = ("doc_id long, n_tokens long, n_often long, base double, score double, rare array<struct<word:string,log:float>>, "
              "held_out boolean")
    scored = staged(picked.select("doc_id", "text", "held_out").mapInArrow(tidied(run), schema).withColumn("row", F.monotonically_increasing_id()))
    # The counts of the other words come by a join; a word that no training text holds counts as 0.
    asked = scored.select("row", F.inline("rare"))
    share_whole = (1 - mix) / max(1, total) * F.col("n")
    each = F.when(F.col("n").isNull(), (F.col("log") + math.log(mix)) / LN10).otherwise(F.log10(F.exp("log") * mix + share_whole))
    found = asked.join(whole.hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.sum(each).alias("rest"))
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
