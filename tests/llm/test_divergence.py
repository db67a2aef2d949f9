"""Source divergence against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowwarden.llm import divergence

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, v long, value long, h string"


def plain(rows, least=10, top=10):
    groups, found = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ABC))
        groups[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = set()

    def far(p, q):
        return (p - q) ** 2 // (p + q)

    for lang in {k[0] for k in groups}:
        kept = {t for t, n in found[lang].items() if n >= least}
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        every, p = shares(sum(own.values(), Counter())), {s: shares(c) for s, c in own.items()}
        for s, counts in own.items():
            parts = {"pair": [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s],
                     "term": [(far(p[s][t], every[t]), t) for t in kept if counts[t] and p[s][t] > every[t]]}
            for part, values in parts.items():
                for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def answer(spark, rows, **options):
    table = spark.createDataFrame([(i, *r, "x", 1, 2, 3, "y") for i, r in enumerate(rows)], SCHEMA)
    found = [tuple(r) for r in divergence.divergence(table, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_all_cases_as_counted_plainly(spark):
    draw = random.Random(3)
    words = ["Der", "DER", "über", "Ärger", "naïve", "日本", "a1b", "x", "the", "of", "z" * 5000, "É", "é", "\x7f", "_", "ﬀ", "𝒳"]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(30))), draw.choice(["de", "en", None, ""]), draw.choice(["a", "b", "ä", None, "Z"]))
            for _ in range(400)]
    rows += rows[:120] + [("the of the", "en", "a")] * 300                      # copies, one text with many of them
    rows += [(None, "en", "without"), ("", "fr", "alone"), ("1 2 3", "it", "p"), (None, "it", "q"), ("few words", "it", "r")]
    rows += [("the " * 50_000, "de", "a")]
    assert answer(spark, rows) == plain(rows)


def test_tiles_of_few_sources_and_terms_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_PER_TILE", 2)
    monkeypatch.setattr(divergence, "TERMS_PER_TILE", 5)
    monkeypatch.setattr(divergence, "PORTION", 200)
    draw = random.Random(4)
    words = [chr(97 + i) * j for i in range(12) for j in (1, 2, 3)]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(12))), "en", f"s{draw.randrange(9)}") for _ in range(300)]
    assert answer(spark, rows, least_docs=4, top=3) == plain(rows, 4, 3)


def test_no_rows_and_one_group(spark):
    assert answer(spark, []) == set()
    assert answer(spark, [("one group", "en", "a")] * 12) == set()


@pytest.mark.parametrize("big", [5 * 10 ** 9, 4 * 10 ** 18 // 10 ** 9])
def test_shares_are_exact_for_large_counts(spark, big):
    row = spark.sql(f"select {big}L n, {big * 3}L total, 7L v").select(divergence._share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (big + 2) // (big * 3 + 14)


def test_a_tile_of_sources_without_common_terms():
    left = [(5, np.array([1, 2]), np.array([9, 30])), (7, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    right = [(11, np.array([3]), np.array([100]))]
    far = divergence._far
    assert [x[2] for x in divergence.compare_tile(left, right, False, True, 4)] == [
        far(9, 11) + far(30, 11) + far(5, 100) + far(5, 11), far(7, 100) + 3 * far(7, 11)]
