"""Spelling variants against a comparison of every word with every other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowwarden.llm import spelling

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, key string, form string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, one_in=97, least_length=5, least_count=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ABC)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), forms[w] and words[forms[w]]))
    return out


def answer(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    found = spelling.variants(table, **options).collect()
    assert len(found) == len({r["word"] for r in found})
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


def texts(draw, words, n):
    weight = [draw.choice([1, 1, 2, 4, 9, 40]) for _ in words]
    return [(i if i % 7 else None, draw.choice([" ", "-", "1", "ß ", "\n"]).join(draw.choices(words, weight, k=draw.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("rows_most", "cells"), [(512, 1 << 22), (3, 1 << 22), (512, 12)])
def test_all_words_as_compared_plainly(spark, monkeypatch, rows_most, cells):
    monkeypatch.setattr(spelling, "GROUP_ROWS", rows_most)
    monkeypatch.setattr(spelling, "GROUP_CELLS", cells)
    monkeypatch.setattr(spelling, "PORTION", 3000)
    draw = random.Random(7)
    words = {"".join(draw.choices("abÉé÷", k=draw.randrange(3, 9))) for _ in range(250)} | {"aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"}
    words |= {"z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 150, "É" * 90, "É" * 91}
    rows = texts(draw, sorted(words), 120)
    rows += rows[:20] + [(5, None), (None, None), (6, ""), (7, "日本語 Ābcde ſtraße"), (8, "Wörter wörter WÖRTER " * 2000)]
    for one_in in (97, 3):
        assert answer(spark, rows, one_in=one_in) == plain(rows, one_in)


def test_ties_chains_and_an_empty_table(spark):
    rows = [(1, "abcde " * 3 + "abcdf " * 7 + "abcdg " * 7 + "abcxg " * 20 + "aacxg " * 45 + "plain " * 4)]
    found = {r[0]: r for r in answer(spark, rows, one_in=0)}
    assert found["abcde"][1:3] == ("abcdf", "abcdf") and found["abcdg"][1:3] == ("abcxg", "aacxg") and found["plain"] == ("plain", None, "plain", 4, 0, None)
    assert {tuple(r) for r in found.values()} == plain(rows, 0)
    assert answer(spark, []) == set() and answer(spark, [(1, "few rare words")]) == set()


def test_checksums_go_on_from_the_prefix():
    parts = [b"a", b"", b"word", b"x" * 64, b"y" * 65, "Ä".lower().encode(), b"z" * 1000]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(parts))], np.uint32)
    got = spelling.checksums(data, ends - [len(p) for p in parts], ends, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + p) for i, p in enumerate(parts)]
