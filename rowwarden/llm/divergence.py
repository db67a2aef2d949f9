"""How far the sources of a language differ in their terms, from counts over whole texts.

Identical texts of a language are collapsed first: one text with how often each source holds it.  A text is cut into
terms once, and its counts and document frequencies are added with those weights.  Pairs of sources are compared on the
terms that occur in them; the terms that neither or only one of them holds are settled by how many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowwarden.llm.batches import staged, tidied, utf8
from rowwarden.llm.runs import beyond_ascii, coded, portions, runs

PORTION = 16 << 20       # bytes of text that are collapsed or counted at once
SCALE = 1_000_000_000
SOURCES_PER_TILE, TERMS_PER_TILE = 64, 8192
COLLAPSED = "lang string, text string, sources array<string>, copies array<long>"
COUNTED = "lang string, term string, source string, docs long, n long"


def _collapse(table: pa.Table) -> pa.Table:
    """Of (lang, text, source, n): one row per language and text with its sources and how often each holds it."""
    held = table.group_by(["lang", "text", "source"]).aggregate([("n", "sum")])
    return held.group_by(["lang", "text"]).aggregate([("source", "list"), ("n_sum", "list")])


def _spread(batch: pa.RecordBatch) -> pa.Table:
    """Collapsed rows with one row per source again."""
    sources = batch.column("sources")
    at = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(sources.offsets.to_numpy())))
    return pa.table({"lang": batch.column("lang").take(at), "text": batch.column("text").take(at), "source": sources.flatten(),
                     "n": batch.column("copies").flatten()})


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, source) to texts, sources and copies: each task's copies once, copies of all tasks next to each other."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                table = pa.Table.from_batches([part]).append_column("n", pa.array(np.ones(part.num_rows, np.int64)))
                yield from _collapse(table).rename_columns(["lang", "text", "sources", "copies"]).to_batches()

    once = docs.select("lang", "text", "source").mapInArrow(tidied(step), COLLAPSED).withColumn("h", F.xxhash64("text"))
    return once.repartition("lang", "h").sortWithinPartitions("lang", "h").drop("h")


def _count(table: pa.Table) -> pa.RecordBatch:
    """Weighted counts of collapsed texts by language, source and term; the term '' stands for the group itself."""
    langs, texts, lists, copies = (c.combine_chunks() for c in _collapse(table).columns)
    places = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    held, weight = np.diff(places), copies.flatten().to_numpy()
    known: dict[tuple[str, str], int] = {}
    of_lang = langs.take(pa.array(np.repeat(np.arange(len(texts)), held))).to_pylist()
    group = np.array([known.setdefault(x, len(known)) for x in zip(of_lang, lists.flatten().to_pylist(), strict=True)], np.int64)

    data, offsets = utf8(texts)
    inside = beyond_ascii(data)
    starts, ends, text = runs(data, offsets, inside)
    code, terms = coded(data, inside, ends - starts)
    pairs, n = np.unique(text * max(1, len(terms)) + code, return_counts=True)
    text, code = np.divmod(pairs, max(1, len(terms)))
    each = held[text]                                    # a text's counts, once for every source that holds it
    entry = np.repeat(places[text] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if len(text) else np.zeros(0, np.int64)
    key = np.repeat(code, each).astype(np.int64) * len(known) + group[entry]
    order = np.argsort(key, kind="stable")
    key, entry, n = key[order], entry[order], np.repeat(n, each)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    docs = np.add.reduceat(weight[entry], first) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(weight[entry] * n, first) if len(key) else np.zeros(0, np.int64)
    code, group = np.divmod(key[first], max(1, len(known)))

    of = [pa.array([k[i] for k in known], pa.string()) for i in (0, 1)]
    group = np.concatenate([np.arange(len(known)), group])
    empty = np.zeros(len(known), np.int64)
    words = pa.concat_arrays([pa.array([""] * len(known), pa.string()), terms.take(pa.array(code)).cast(pa.string())])
    return pa.RecordBatch.from_arrays(
        [of[0].take(pa.array(group)), words, of[1].take(pa.array(group)), pa.array(np.concatenate([empty, docs])), pa.array(np.concatenate([empty, n]))],
        [c.split()[0] for c in COUNTED.split(", ")])


def counted(texts: DataFrame) -> DataFrame:
    """Collapsed texts to (lang, term, source, docs, n), added up in every portion of a task."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                yield _count(_spread(part))

    return texts.mapInArrow(tidied(step), COUNTED)


def _share(count: str, total: str) -> Column:
    """A term's p in parts of ``SCALE``, exact for any counts: decimals hold the product."""
    return F.expr(f"1 + (cast({SCALE} as decimal(18, 0)) * cast({count} + 2 as decimal(19, 0))) div cast({total} + 2 * v as decimal(20, 0))")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare_tile(left: list[tuple], right: list[tuple], same: bool, constant: bool, v: int) -> Iterator[tuple[int, int, int]]:
    """Parts of the sums of all pairs of two lists of sources over the terms of one bucket: (index, index, value).

    A source is (p of a term that it lacks, its terms sorted, their p).  ``same``: both lists are one, and each pair comes
    once.  ``constant``: the terms that occur in neither source, as if all ``v`` did, are counted here.
    """
    every = np.unique(np.concatenate([t for _, t, _ in right])) if right else np.zeros(0, np.int64)
    table = np.zeros((len(every), len(right)), np.int64)
    for j, (_, t, p) in enumerate(right):
        table[np.searchsorted(every, t), j] = p
    base = np.array([p0 for p0, _, _ in right], np.int64)
    sizes = np.array([len(t) for _, t, _ in right], np.int64)
    seen = [np.unique(p, return_counts=True) for _, _, p in right]
    for i, (p0, terms, p) in enumerate(left):
        alone = _far(np.int64(p0), base)
        values, times = np.unique(p, return_counts=True)
        total = (_far(values[:, None], base[None, :]) * times[:, None]).sum(axis=0)
        total += np.array([(_far(np.int64(p0), a) * b).sum() for a, b in seen], np.int64)
        at = np.searchsorted(every, terms)
        met = at < len(every)
        met[met] = every[at[met]] == terms[met]
        other, own = table[at[met]], p[met][:, None]
        both = _far(own, np.maximum(other, 1)) - _far(own, base[None, :]) - _far(np.int64(p0), np.maximum(other, 1)) + alone[None, :]
        total += np.where(other > 0, both, 0).sum(axis=0) + ((v if constant else 0) - len(terms) - sizes) * alone
        for j in range(i + 1 if same else 0, len(right)):
            yield i, j, int(total[j])


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    lang, one, two, bucket = (k.as_py() for k in key)
    source = table.column("source").combine_chunks().dictionary_encode()
    code, names = source.indices.to_numpy(), source.dictionary.to_pylist()
    term = table.column("term").to_numpy()
    p, block = table.column("p").to_numpy(), table.column("block").to_numpy()
    v = int(table.column("v").to_numpy().max())
    order = np.lexsort((term, code))
    cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
    left, right = [], []
    for name, a, b in zip(names, cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]                                # the first one is the group itself, its term -1
        entry = (int(p[rows[0]]), term[rows[1:]], p[rows[1:]])
        for side, own in ((left, one), (right, two)):
            if block[rows[0]] == own:
                side.append((name, entry))
    left.sort(key=lambda x: x[0])
    right.sort(key=lambda x: x[0])
    found = list(compare_tile([e for _, e in left], [e for _, e in right], one == two, bucket == 0, v))
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array([left[i][0] for i, _, _ in found], pa.string()),
                     "b": pa.array([right[j][0] for _, j, _ in found], pa.string()), "value": pa.array([x for _, _, x in found], pa.int64())})


def pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all pairs of sources of a language, from tiles of sources by sources by terms.

    ``entries``: (lang, source, term, p) with numbered terms; ``groups``: (lang, source, p, v), p that of an absent term.
    """
    shape = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES_PER_TILE).cast("int").alias("blocks"),
                                       F.greatest(F.ceil(F.max("v") / TERMS_PER_TILE), F.lit(1)).cast("int").alias("buckets"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")
    members = groups.join(shape, "lang").select("lang", "source", F.lit(-1).cast("long").alias("term"), "p", "v", "blocks", block, every)
    rows = entries.join(shape, "lang").select("lang", "source", "term", "p", F.lit(0).cast("long").alias("v"), "blocks", block,
                                              F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"))
    tiles = members.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("lang", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "bucket", "source", "term", "p",
                "block", "v")
    sums = tiles.groupBy("lang", "one", "two", "bucket").applyInArrow(_tile, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Null text, language and source are ''.  Terms: runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased;
    a language keeps those in at least ``least_docs`` of its rows, V in number.  A group (language and source) or a
    language with n occurrences of a term, N of all kept ones, gives it p = 1 + floor(10^9 (n + 2) / (N + 2 V)); two
    differ in it by f = floor((p - q)^2 / (p + q)).  Part ``pair``: item is another source of the language, value the sum
    of f over all kept terms, 0 without any.  Part ``term``: item is a kept term that the group holds with p above the
    language's, value its f; the ``top`` first.  Ranked by value, the largest first, then by item in UTF-8 order.

    Integers throughout.  Every row counts as a document of its own, copies too; a group without terms has its pairs.  An
    empty table gives no rows.  Other columns are not read.

    Texts are shuffled once, as each task's distinct ones.  Counts are added up in portions before their shuffle.  A
    language's sources are compared in tiles of about 64 by 64 sources by 8,192 terms, of which only sums leave a task.
    """
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (text_col, "text"), (source_col, "source"))])
    cells = counted(collapsed(named)).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = staged(terms.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"))

    each = kept.withColumn("id", F.monotonically_increasing_id()).select("lang", "term", "id", "total", F.inline("held"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count_if(F.col("term") != "").alias("v"))
    groups = staged(each.groupBy("lang", "source").agg(F.sum("n").alias("group_n")).join(langs, "lang"))
    entries = each.filter("term != ''").join(groups, ["lang", "source"]).withColumns({"p": _share("n", "group_n"), "q": _share("total", "lang_n")})
    far = F.expr("((p - q) * (p - q)) div (p + q)").alias("value")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far) \
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    absent = groups.select("lang", "source", F.when(F.col("v") > 0, _share("0", "group_n")).otherwise(1).alias("p"), "v")
    sums = pair_sums(entries.select("lang", "source", F.col("id").alias("term"), "p"), absent)
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    by_pair = sums.select("lang", "value", way.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value") \
        .withColumn("rank", F.row_number().over(ranked))
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", "value", "rank")


#: The same in DuckDB's SQL, every pair over every kept term.
ORACLE = r"""
with docs as (
  select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') body from documents),
cells as (select lang, source, doc, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as (select lang, term, count(*) total from cells group by all having count(distinct doc) >= 10),
langs as (select lang, count(*) v, sum(total) n from kept group by all),
counts as (select lang, source, term, count(*) n from cells semi join kept using (lang, term) group by all),
groups as (select lang, source from docs group by all),
sizes as (
  select g.lang, g.source, coalesce(l.v, 0) v, l.n lang_n, coalesce(sum(c.n), 0) n
  from groups g left join langs l on l.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source group by all),
shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.n + 2 * s.v)::hugeint p,
    1 + (1000000000::hugeint * (k.total + 2)) // (s.lang_n + 2 * s.v)::hugeint q
  from sizes s join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select g.lang, g.source, 'pair' part, h.source item, coalesce(p.value, 0) value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over w)::integer as rank from parts
window w as (partition by lang, source, part order by value desc, item)
qualify part = 'pair' or rank <= 10
"""
