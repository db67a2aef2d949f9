"""The attention model: words of a batch are encoded at once, and its gradients are those of its loss."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowwarden.llm import attention_lm as lm

ARGS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_words_are_encoded_at_once_as_each_by_itself(monkeypatch):
    coder = lm.subwords(*ARGS)
    rnd = random.Random(5)
    words = ["the", "don't", "a,b", "'s", "é", "x" * 300, "12.5%", "ß-9", *("".join(rnd.choices("abcé1',.", k=rnd.randint(1, 12))) for _ in range(500))]
    calls = []
    plain = coder.coder.encode_ordinary
    monkeypatch.setattr(coder.coder, "encode_ordinary", lambda text: calls.append(text) or plain(text), raising=False)
    # White space that is not ASCII belongs to a word.
    for given in (words, [*words, "a\u00a0b", "\u2003", "\x1c", "\u00a0c"], ["\u00a0"], []):
        del calls[:]
        ids, sizes = coder.of(given)
        assert len(calls) == 1 or given is not words
        each = [plain(" " + w) for w in given]
        assert sizes.tolist() == [len(x) for x in each] and ids.tolist() == [i for x in each for i in x]


def test_texts_are_laid_out_like_their_words_one_by_one(monkeypatch):
    coder = lm.subwords(*ARGS)
    monkeypatch.setattr(lm, "LEXICON_BYTES", 1500)
    lexicon = lm.Lexicon(coder, {"the": 9})
    rnd = random.Random(6)
    for _ in range(3):
        texts = [None, "", " \t", "The the\nTHE", *(" ".join(rnd.choices(["the", "Ähre", "of", f"w{rnd.random()}"], k=9)) for _ in range(20)), "end"]
        laid = lexicon.lay_out(pa.array(texts))
        split = [(t or "").encode().lower().decode().split() for t in texts]
        assert laid.ids.tolist() == [i for own in split for w in [*own, None] for i in ([coder.end] if w is None else coder.of([w])[0].tolist())]
        assert laid.count.tolist() == [9 * (w == "the") for own in split for w in [*own, None]]
        assert laid.n_words.tolist() == [len(own) for own in split] and laid.ids[laid.text_ends - 1].tolist() == [coder.end] * len(texts)
        inner = laid.number[~laid.is_end]
        assert laid.distinct.take(pa.array(inner)).to_pylist() == [w for own in split for w in own]


@pytest.mark.parametrize("far", [1, 60])  # with scores so large that exponentials must be shifted, too
def test_gradients_are_those_of_the_loss(far):
    rng = np.random.default_rng(1)
    tables = lm.Tables.of(rng.integers(0, 50, 3000), rng.random(3000) < 0.5)
    p = {k: v.astype(float) for k, v in lm.fresh(tables.prior).items()}
    p["near"] = p["near"] * far
    p["prior"] = p["prior"] * far
    rows, want, _, _ = lm.framed(rng.integers(0, 40, 150), np.array([70, 71, 150]), tables, 7)
    used = np.flatnonzero(want.reshape(-1) >= 0)

    def loss():
        return -lm.forward(p, rows, used)["z"][np.arange(len(used)), want.reshape(-1)[used]].mean()

    chance, g, touched = lm.gradients(p, rows, want)
    z = lm.forward(p, rows, used)["z"]
    assert np.allclose(np.log(chance[used]), z[np.arange(len(used)), want.reshape(-1)[used]], atol=1e-4)
    for name, d in g.items():
        flat = p[name].reshape(-1)
        own = (touched[:, None] * lm.DIM + np.arange(lm.DIM)).ravel() if name == "rows" else np.arange(flat.size)
        for i in rng.choice(len(own), min(12, len(own)), replace=False):
            old, at = flat[own[i]], own[i]
            flat[at] = old + 1e-4
            up = loss()
            flat[at] = old - 1e-4
            slope = (up - loss()) / 2e-4
            flat[at] = old
            assert d.reshape(-1)[i] == pytest.approx(slope, abs=2e-5, rel=1e-3), name


def test_the_weight_of_the_model_is_what_texts_it_has_not_seen_call_for(spark):
    """Every word follows from the one before and none occurs once, so frequencies alone say little of them."""
    rnd = random.Random(8)
    after = {w: [*"abcdefgh"][(i * 3 + 1) % 8] for i, w in enumerate("abcdefgh")}
    rows = []
    for i in range(600):
        own = [rnd.choice("abcdefgh")]
        for _ in range(150):
            own.append(after[own[-1]])
        rows.append((i, " ".join(own)))
    held = F.col("doc_id") >= 540
    found = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held, *ARGS).filter("held_out").collect()
    assert len(found) == 60
    assert sum(r["score"] for r in found) > 0.6 * sum(r["base_score"] for r in found)


def test_a_text_is_judged_by_the_counts_of_the_others():
    lexicon = lm.Lexicon(lm.subwords(*ARGS), {"the": 9})
    laid = lexicon.lay_out(pa.array(["the the new", "the", ""]))
    alone = np.log(np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]))
    likely, other = lm.judge(laid, alone, 5, 100)
    share = [7 / 96, 7 / 96, 4 / 96, 8 / 98, 4 / 98, 4 / 99]
    by_hand = [sum(np.log(g * a + (1 - g) * u) for a, u in zip([0.1, 0.2, 0.4, 0.5, 0.6, 0.7], share, strict=True)) for g in lm.WEIGHTS]
    assert np.allclose(likely, by_hand)
    assert [(r["word"], round(r["log"], 4), r["own"], r["size"]) for r in other.to_pylist()] == [("new", round(np.log(0.3), 4), 1, 4)]


def test_the_fitted_weight_takes_words_of_unknown_counts_into_account(spark):
    judged = lm._evidence(i=-1 - np.arange(len(lm.WEIGHTS)), x=np.log(1 - lm.WEIGHTS))
    rare = lm._evidence(word=["x"] * 3, log=[np.log(0.5)] * 3, own=[1] * 3, size=[2] * 3)
    whole = spark.createDataFrame([("x", 1), ("y", 4)], "word string, n long")
    at = lambda *b: lm.fitted(spark.createDataFrame([r for x in b for r in x.to_pylist()], lm.EVIDENCE), whole, 50)
    assert at(judged) == lm.WEIGHTS[0] and at(judged, rare) == 0.75 and at() is None


def test_what_only_training_reads_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowwarden.llm.batches.staging_folder", lambda _: str(tmp_path / f"llm-{len([*tmp_path.iterdir()])}-{random.random()}"))
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    found = lm.score_texts(docs, F.col("doc_id") < 4, *ARGS)
    assert found.count() == 40 and len([*tmp_path.iterdir()]) == 2
