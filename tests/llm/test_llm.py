"""The operators against plain versions of themselves on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowwarden.llm import (attention_lm, byte_bpe, components, language, line_chunks, main_text, near_duplicates, nearest,
                           packing, quality, token_counts)

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_texts():
    rng = random.Random(5)
    stock = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(stock, k=n))
    base = prose(120).split()
    near = [" ".join(base[:i] + [f"new{i}"] + base[i + 1:]) for i in range(3, 100, 12)]
    passage = prose(60)
    return [None, "", " \n\t ", "a", "one two three", " ".join(base), " ".join(base), *near, "Straße É ñandú 日本語 don't <|endoftext|> x y\x1cz",
            prose(40) + "\n" + passage, passage + "\n" + prose(40), "w" * 3000, "ascii \x1cfs\x1d x\x1fy", prose(6000), *[prose(k) for k in (5, 30, 80, 200)]]


ROWS = [(i, t, ("en", "de", None)[i % 3], i) for i, t in enumerate(made_texts())] + [(3, "a", "en", 0), (None, "of nobody", "en", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_tokens int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = set(token_counts.word_end_vocabulary(path))

    def pieces(word):
        n = 0
        while word:
            size = next((k for k in range(min(len(word), 200), 0, -1) if word[:k] in vocabulary), None)
            if size is None:
                return 1
            word, n = word[size:], n + 1
        return n

    def plain(text):
        return sum(pieces(p.encode().decode("latin-1").translate(token_counts.AS_CHAR) + token_counts.END)
                   for p in token_counts.PIECES.findall((text or "").lower()))

    found = token_counts.token_counts(docs, path)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in found.collect()) == sorted((i or -1, plain(t)) for i, t, *_ in ROWS)
    assert token_counts.token_counts(empty, path).count() == 0


def test_longest_match_with_separate_inner_pieces():
    automaton = token_counts.LongestMatch(["ab", "a", "abcd"], ["c", "cd", "b"])
    assert [automaton.count(w) for w in ("", "a", "ab", "abc", "abcd", "abcdc", "acdb", "x", "abx", "ba")] == [0, 1, 1, 2, 1, 2, 3, None, None, None]


def test_byte_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = byte_bpe.load(path)
    found = by_id(byte_bpe.encode_documents(docs, path))
    for i, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want = [len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))]
        assert list(found[i])[1:] == want
    assert byte_bpe.encode_documents(empty, path).count() == 0
    own = byte_bpe.ChunkCache(path).bytes
    assert [x.decode("utf-8", "replace") for x in own] == tokenizer.decode_batch([[i] for i in range(len(own))], skip_special_tokens=False)


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.word_encoder(path).full
    rows = packing.pack_documents(docs, path, end_id=1, window=64).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in ROWS}
    pieces = {}
    for r in rows:
        own = np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], np.uint32)
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["length"] == len(own) > 0
        pieces.setdefault(r["doc_id"], Counter()).update(range(r["start"], r["start"] + r["length"]))
    times = Counter(i for i, *_ in ROWS)
    assert pieces == {i: Counter(dict.fromkeys(range(len(x)), times[i])) for i, x in want.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        size = sum(n for _, n in parts)
        assert size <= 64 and size & (size - 1) == 0
    assert packing.pack_documents(empty, path, end_id=1).count() == 0


def test_near_duplicates(docs, empty):
    sets = {}
    for i, text, *_ in ROWS:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets if i is not None}
    for _ in range(20):
        for a in least:
            for b in least:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert (r["component_id"], r["kept"]) == (least.get(r["doc_id"]), r["doc_id"] is None or least[r["doc_id"]] == r["doc_id"])
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_pipeline_links_at_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    near = base[:100] + ["x1", "x2", "x3", "x4"]         # 96 shingles of 104 shared
    far = base[:94] + [f"y{i}" for i in range(10)]       # 90 of 110: 0.82
    other = base[:90] + [f"z{i}" for i in range(14)]     # 86 of 114: 0.75
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((base, near, far))] + [(10, " ".join(f"v{w}" for w in base)), (11, " ".join(f"v{w}" for w in other))], "doc_id long, text string")
    kept = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert kept(dict(corpus_pipeline.STAGES)["near"](spark, docs.filter("doc_id != 1"), "")) == [0, 10, 11]
    assert kept(near_duplicates.near_duplicates(docs, 85).filter("kept")) == [0, 2, 10, 11]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_pairs_are_missed_less_than_once_in_a_million(percent):
    plan, share = near_duplicates.design(percent), percent / 100
    assert sum(near_duplicates.tree_miss(share, *kind) for kind in (plan.sparse, plan.crowded)) + near_duplicates.bits_miss(share, plan.least_bits) < 1e-6
    assert near_duplicates.tree_miss(0.85, 4, 20) > 9e-6 and near_duplicates.tree_miss(0.85, 8, 48) > 1e-4


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (100, 101)], "a long, b long").repartition(7)
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in order} | {(100, 100), (101, 100)}


def test_few_links_are_joined_without_rounds_of_shuffles(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 400), (500, 400), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = {(i, 0) for i in range(201)} | {(400, 400), (500, 400)}
    with monkeypatch.context() as patch:
        patch.setattr(components, "GATHERED", 3)  # more links than that take the rounds
        assert {tuple(r) for r in components.components(edges).collect()} == want
    monkeypatch.setattr(components, "_large_star", None)
    assert {tuple(r) for r in components.components(edges).collect()} == want
    assert components.components(edges.limit(0)).count() == 0


def test_line_dedup(docs, empty):
    found = by_id(line_chunks.dedupe_lines(docs))
    first = next(i for i, t, *_ in ROWS if t and "\n" in t.strip())
    assert found[first]["text"] == ROWS[first][1] and found[first + 1]["text"] == ROWS[first + 1][1].split("\n")[1]
    assert found[6]["text"] == "" and found[5]["text"] == ROWS[5][1] and found[0]["text"] is None and found[1]["text"] == ""
    assert found[6]["n_tokens"] == 6 and line_chunks.dedupe_lines(empty).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_passages_go_whole(spark, monkeypatch, clashing):
    if clashing:
        monkeypatch.setattr(line_chunks, "unit_hash", lambda size, *lines: F.pmod(F.xxhash64(F.lit(size), *lines), F.lit(7)))
    rng = random.Random(8)
    passages = [[f"p{k} line {i}" for i in range(rng.choice((2, 3, 6, 40)))] for k in range(6)]
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "own\nown too"), (None, "own\nown too"), (0, None), (1, ""), (1, "one\ntwo"), (1, "one\ntwo"), (2, "zero\none\ntwo\nthree"), (3, long + "\nx"), (4, "y\n" + long)]
    for i in range(5, 40):
        text = [f"of {i}"]
        for k in rng.choices(range(6), k=3):
            a = rng.randrange(len(passages[k]) - 1)
            text += passages[k][a:a + rng.randrange(2, 42)] + [f"between {i} {rng.random()}"] * rng.choice((0, 1))
        rows.append((i, "\n".join(text)))
    units = lambda t: [(i, 2, (t[i], t[i + 1])) for i in range(len(t) - 1)] + [(i, 1, (x,)) for i, x in enumerate(t) if len(x.split()) >= 50]
    first = {}
    for i, text in rows:
        for _, _, u in units((text or "").split("\n")):
            first[u] = min(first.get(u, 1 << 62), 1 << 61 if i is None else i)
    want = []
    for i, text in rows:
        lines, seen, gone = (text or "").split("\n"), set(), set()
        for at, size, u in sorted(units(lines)):
            gone |= set(range(at, at + size)) if u in seen or first[u] < (1 << 61 if i is None else i) else set()
            seen.add(u)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, text if text is None else kept, len(lines), len(gone), sum(k - 1 not in gone for k in gone)))
    found = line_chunks.dedupe_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and sum(w[3] for w in want) > 100


def test_pipeline_takes_passages_of_short_lines_whole(spark):
    passage = [f"short line {i}" for i in range(7)]
    docs = spark.createDataFrame([(i, "\n".join([f"before {i}", *passage, f"after {i}"]), 0) for i in range(3)], "doc_id long, text string, n_chars long")
    found = by_id(dict(corpus_pipeline.STAGES)["lines"](spark, docs, ""))
    assert found[2]["text"] == "before 2\nafter 2" and found[0]["text"].split("\n")[1:-1] == passage


def test_quality_base_rules(docs, empty):
    for r in quality.base_features(docs).drop("_buckets").collect():
        text = next((t for i, t, *_ in ROWS if i == r["doc_id"])) or ""
        w = WORD.findall(text)
        runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        times = Counter(runs)
        covered = {k for i, x in enumerate(runs) if times[x] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.asDict() == {"doc_id": r["doc_id"], "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
                              "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_verdict(spark, empty):
    rng = random.Random(2)
    stock = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(f"{w}{'###' * (i % 4 == 0)}" for w in rng.choices(stock, k=60))) for i in range(400)] + [(None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(0, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")
    judged = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    assert [judged[i]["kept"] for i in range(400)] == [i % 4 != 0 for i in range(400)] and not judged[None]["kept"]
    assert quality.judge(empty, labels).count() == 0
    unlabelled = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in unlabelled.collect())


def test_language(spark, docs, empty):
    words = {"xx": ["kalo", "mira", "tenu"], "yy": ["schwo", "grün", "pfad"]}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[lang], k=8)), lang) for i in range(100) for lang in words]
    rows = [(2 * i + (lang == "yy"), t, lang) for i, t, lang in rows] + [(900, None, "xx"), (901, "12 34", "yy"), (None, "mira", None), (905, "KALOTEN", None)]
    found = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(found[i]["lang_pred"] == lang for i, t, lang in rows if i is not None and i < 900)
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[905]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[900]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    assert language.identify(empty).count() == 0


def test_lm_scores(docs, empty):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = attention_lm.score_texts(docs, language.fold("doc_id", 7) == 2, *args).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, text, *_ in ROWS:
        if not held(i):
            counts.update([*WORD.findall((text or "").translate(LOWER)), None])
    assert len(found) == len(ROWS)
    texts = {i: t for i, t, *_ in ROWS}
    for r in found:
        w = [*WORD.findall((texts[r["doc_id"]] or "").translate(LOWER)), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), counts.total())
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (counts.total() + len(counts) + 1)) for x in w)) and r["score"] < 0
    assert attention_lm.score_texts(empty, F.lit(False), *args).count() == 0


def learned_from(monkeypatch, docs, held_out):
    """The rows that training is given."""
    given = []
    monkeypatch.setattr(attention_lm, "train", lambda sample, tables, start, *_: given.extend(sample.collect()) or start)
    attention_lm.score_texts(docs, held_out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return given


def test_lm_learns_from_all_training_rows(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.concat(F.lit("of "), "id", F.lit(" ")), 20_000)).alias("text"))
    assert len(learned_from(monkeypatch, docs, F.col("doc_id") % 3 == 0)) == 40


def test_lm_spreads_copies_over_rounds_and_trainers(spark, monkeypatch):
    docs = spark.range(300).select(F.when(F.col("id") < 200, F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    given = learned_from(monkeypatch, docs, F.lit(False))
    assert {r["round"] for r in given} == set(range(attention_lm.ROUNDS)) and len({r["part"] for r in given}) == 300


def test_attention_sees_only_what_came_before_and_scoring_agrees_with_training():
    rng = np.random.default_rng(1)
    tables = attention_lm.Tables.of(rng.integers(0, 50, 3000), rng.random(3000) < 0.5)
    p = attention_lm.fresh(tables.prior)
    ids = rng.integers(0, 3000, 150)
    scorer = attention_lm.Scorer(p, tables)
    logs = scorer.ids(ids, np.array([150]), 7)
    changed = ids.copy()
    changed[100] = (changed[100] + 1) % 3000
    assert np.allclose(scorer.ids(changed, np.array([150]), 7)[:100], logs[:100], atol=1e-5)
    rows, classes, _ = attention_lm.windows(ids, tables, 7)
    want = classes.reshape(-1)
    used = np.flatnonzero(want >= 0)
    z = attention_lm.forward(p, rows, used)["z"]
    assert np.allclose(z[np.arange(len(used)), want[used]] + tables.within[ids], logs, atol=1e-4)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) + 3 * (i % 9 == np.arange(16))]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (None, rows[1][1]), (2050, [1.0, 2.0]), (2051, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in nearest.nearest(df, df.filter("vec_id % 50 = 0"), block_rows=300).collect()]
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = list(nearest.brute_force(single, [i for i, _ in rows if i is not None and i % 50 == 0], 5))
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want) and len(found) == len(want)
    assert [v for q, _, v, _ in sorted(found) if q == 0] == [1000, 1001, 1002, 1003, 1004] and [v for q, _, v, _ in found if q == 2050] == [2051]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_very_small_and_large_vectors(spark):
    base = np.random.default_rng(9).normal(size=(60, 8))
    rows = [(i, (v * 10.0 ** (0, -200, 200, -310)[i % 4]).tolist(), "x", 1.5) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, score double")
    found = {(q, r): (v, s) for q, r, v, s in nearest.nearest(df, df.filter("vec_id % 5 = 0")).collect()}
    want = {(q, r): (v, s) for q, r, v, s in nearest.brute_force([r[:2] for r in rows], list(range(0, 60, 5)), 5)}
    assert len(found) == 60 and all(abs(found[k][1]) <= 1 + 1e-12 for k in found)
    # Vectors near 1e-310 have fewer digits.
    assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-12 for k in want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var p="</p>";</script></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><article><h1>Head &amp; line</h1><p><b>One   two
three.<br><p>Four &lt;b&gt; <a href=/y>five</a>.</p><div class="ad">Buy</div><ul><li>x<li>y</ul></article>
<aside>Side</aside><section id="comments"><p>I liked it</p></section><form><p>Search</p></form><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>only &eacute;</p>"), (5, "x", "<nav>menu</nav>"), (6, "y", "<div>" * 3000 + "deep")]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    article = "Head & line\nOne two three.\nFour <b> five.\nx\ny"
    assert found == {1: (article, len(article)), 2: ("", 0), 3: ("", 0), None: ("only é", 6), 5: ("", 0), 6: ("deep", 4)}


def test_main_text_in_several_containers():
    paragraphs = [f"Paragraph {i} " + "says a good deal about its subject, at some length and without any links. " * 3 for i in range(10)]
    part = lambda own: "".join(f"<p>{p}</p>" for p in own)
    menu = "<div>" + "".join(f"<p><a href=/{i}>Link number {i}</a></p>" for i in range(12)) + "</div>"
    want = "\n".join(p.strip() for p in paragraphs)
    for a, b in (("<div>", "</div>"), ("<article>", "</article>"), ("<section><div>", "</div></section>")):
        assert main_text.main_text(f"<body>{menu}{a}{part(paragraphs[:5])}{b}{menu}{a}{part(paragraphs[5:])}{b}</body>") == want
