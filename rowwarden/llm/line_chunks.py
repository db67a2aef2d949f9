"""Removal of passages that documents repeat, by content-defined chunks of lines.  Native expressions only.

Lines are hashed; a rolling hash over each pair of neighbouring line hashes decides whether a chunk ends there.  So
where chunks end depends on the lines around the place only, and a passage moved to another document, or shifted by
inserted lines, is cut alike inside.  A line of ``long_words`` words or more is a passage by itself and a chunk of its
own.  Chunks of at least two lines, and such long lines, are compared over the whole corpus: first by hash, so that only
the text of chunks whose hash occurs again travels, then byte by byte.  The first holder (smallest id, then first place
in the text) keeps a repeated chunk, every other occurrence goes.

That is ``dedupe_lines``, which keeps the edges of a passage and its chunks of one short line.  ``dedupe_passages`` takes
out all of it: every run of two or more lines is the union of its pairs of neighbouring lines, so comparing all pairs
(and long lines) finds each run to its ends, with nothing to choose where chunks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.functions.text import let
from rowwarden.llm.batches import SPACES, staged
from rowwarden.operators.spread import join_by_key, salt

_DIGITS = "0123456789abcdef"


def ends_chunk(before: Column, line: Column, one_in: int) -> Column:
    """Whether the rolling hash over two line hashes asks for an end after the second: one time in ``one_in`` of 16."""
    return F.substring(F.md5(F.concat(before, line)), 1, 1).isin(*_DIGITS[:16 // one_in])


def long_pattern(long_words: int) -> str:
    """What a line of ``long_words`` words or more matches."""
    gap, word = (f"[{a}" + "".join(f"\\x{ord(c):02x}" for c in SPACES) + "]" for a in ("", "^"))
    return f"^{gap}*(?:{word}+{gap}+){{{long_words - 1}}}{word}" if long_words > 1 else word


def chunks_of(lines: Column, long_words: int, one_in: int) -> Column:
    """The chunks of an array of lines that may be removed: array of (first, size, h, text), places from 1."""
    long_line = long_pattern(long_words)

    def ends(marks: Column) -> Column:
        # A chunk ends around long lines, where the rolling hash says so, and at the last line.
        last = F.size(marks)
        places = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.get(marks, i - 1)["long"] | F.get(marks, i)["long"] | (
            (i > 1) & ends_chunk(F.get(marks, i - 2)["h"], F.get(marks, i - 1)["h"], one_in)))
        return let(places, lambda p: spans(p, marks))

    def spans(places: Column, marks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(places, i - 1), F.lit(0))
        every = F.transform(places, lambda e, i: F.struct((before(i) + 1).alias("first"), (e - before(i)).alias("size")))
        picked = F.filter(every, lambda c: (c["size"] > 1) | F.get(marks, c["first"] - 1)["long"])
        text = lambda c: F.array_join(F.slice(lines, c["first"], c["size"]), "\n")
        return F.transform(picked, lambda c: let(text(c), lambda t: F.struct(
            c["first"].alias("first"), c["size"].alias("size"), F.xxhash64(t).alias("h"), t.alias("chunk"))))

    return let(F.transform(lines, lambda x: F.struct(F.md5(x).alias("h"), x.rlike(long_line).alias("long"))), ends)


def dedupe_lines(docs: DataFrame, long_words: int = 50, one_in: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text column cleaned of repeated chunks, all other columns as they were, plus three counts.

    ``n_lines``: lines of the text before; ``n_removed_lines`` and ``n_removed_chunks``: what went.  The lines that stay
    are joined by line feeds as before, so a text without repeats is unchanged.  A null text stays null; it counts, like
    an empty one, as one empty line.  Rows are never dropped: where all lines go, the text is empty.  Rows that share an
    id are each cleaned of what an earlier id holds and of their own repeats; they don't take each other's chunks, nor
    do rows without an id, which come after all ids.  Input columns named like the three counts are replaced.
    """
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_order")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    chunks = let(lines, lambda x: chunks_of(x, long_words, one_in))

    # Hashes alone first: which occur under more than one id.
    repeated = docs.select(order, F.explode(F.transform(chunks, lambda c: c["h"])).alias("h")).groupBy("h") \
        .agg(F.min("_order").alias("a"), F.max("_order").alias("b")).filter("a < b").select("h")
    # Then the bytes of those: the smallest id that holds each text.
    shared = docs.select(order, F.inline(F.transform(chunks, lambda c: F.struct(c["h"].alias("h"), c["chunk"].alias("chunk")))))
    shared = staged(shared.join(repeated, "h", "left_semi"))
    owners = shared.groupBy("h", "chunk").agg(F.min("_order").alias("owner"), F.max("_order").alias("last")) \
        .filter("owner < last").select(F.col("h").alias("h_"), F.col("chunk").alias("chunk_"), "owner")
    lost = shared.join(owners, (F.col("h") == F.col("h_")) & (F.col("chunk") == F.col("chunk_")) & (F.col("_order") > F.col("owner"))) \
        .groupBy("_order").agg(F.collect_set("h").alias("_gone"))

    def cleaned(lines: Column) -> Column:
        return let(chunks_of(lines, long_words, one_in), lambda c: let(F.transform(c, lambda x: x["h"]), lambda h: let(
            F.filter(c, lambda x, i: F.coalesce(F.array_contains("_gone", x["h"]), F.lit(False)) | (F.array_position(h, x["h"]) <= i)),
            lambda out: verdict(lines, out))))

    def verdict(lines: Column, out: Column) -> Column:
        # A line stays unless some chunk that goes covers it.
        numbers = F.flatten(F.transform(out, lambda c: F.sequence(c["first"], c["first"] + c["size"] - 1)))
        kept = let(F.array_except(F.sequence(F.lit(1), F.size(lines)), numbers), lambda k: F.array_join(F.transform(k, lambda i: F.get(lines, i - 1)), "\n"))
        return F.struct(F.when(F.size(out) > 0, kept).alias("text"), F.size(lines).alias("n"),
                        F.aggregate(out, F.lit(0), lambda n, c: n + c["size"]).alias("lines"), F.size(out).alias("chunks"))

    rest = [c for c in docs.columns if c not in (text_col, *counts)]
    whole = docs.select(order, F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    joined = whole.join(lost.hint("shuffle_hash"), "_order", "left")
    done = joined.select("_text", "_rest", let(F.split(F.coalesce("_text", F.lit("")), "\n"), cleaned).alias("_out"))
    text = F.when(F.col("_text").isNotNull(), F.coalesce("_out.text", "_text"))
    return done.select(
        *[text.alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns if c not in counts],
        F.col("_out.n").cast("long").alias("n_lines"), F.col("_out.lines").cast("long").alias("n_removed_lines"),
        F.col("_out.chunks").cast("long").alias("n_removed_chunks"))


def unit_hash(size: int, *lines: Column) -> Column:
    return F.xxhash64(F.lit(size), *lines)


def units_of(lines: Column, long_words: int) -> Column:
    """What is compared of an array of lines: array of (h, code).

    ``code``: 2 i for the lines i and i + 1, 2 i + 1 for the long line i alone, places from 1.
    """
    pairs = F.transform(F.slice(lines, 2, F.size(lines)), lambda x, i: F.struct(
        unit_hash(2, F.get(lines, i), x).alias("h"), (2 * i + 2).alias("code")))
    long = F.filter(F.transform(lines, lambda x, i: F.when((F.length(x) >= 2 * long_words - 1) & x.rlike(long_pattern(long_words)), F.struct(
        unit_hash(1, x).alias("h"), (2 * i + 3).alias("code")))), lambda u: u.isNotNull())
    return F.concat(pairs, long)


def unit_text(lines: Column, code: Column) -> Column:
    """The bytes of a unit.  A line holds no line feed, so a pair and a long line never have the same."""
    first = F.shiftright(code, 1) - 1
    return F.when(code % 2 == 1, F.get(lines, first)).otherwise(F.concat_ws("\n", F.get(lines, first), F.get(lines, first + 1)))


def own_repeats(lines: Column, long_words: int) -> Column:
    """Codes of the units that stand earlier in the same array of lines, byte by byte."""
    def alike(units: Column) -> Column:
        # Beyond either end there is no hash.
        meets = lambda u, i: u["h"].eqNullSafe(F.get(units, i - 1)["h"]) | u["h"].eqNullSafe(F.get(units, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(units, meets), lambda u: F.struct(unit_text(lines, u["code"]).alias("chunk"), u["code"].alias("code"))))

    return let(F.sort_array(units_of(lines, long_words)), lambda units: let(alike(units), lambda found: F.transform(
        F.filter(found, lambda u, i: u["chunk"].eqNullSafe(F.get(found, i - 1)["chunk"])), lambda u: u["code"])))


def dedupe_passages(docs: DataFrame, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text column cleaned of whole repeated passages, all other columns as they were, plus three counts.

    Every run of at least two lines goes whose pairs of neighbouring lines an earlier id, or an earlier place of the same
    text, holds, and every such line of ``long_words`` words or more.  ``n_lines``: lines of the text before;
    ``n_removed_lines`` and ``n_removed_passages``: lines and runs of lines that went.  Nulls, empty texts, rows that
    share an id and rows without one are treated as in ``dedupe_lines``.  Input columns named like the counts are replaced.
    """
    counts = ("n_lines", "n_removed_lines", "n_removed_passages")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_order")
    split = lambda text: F.split(F.coalesce(text, F.lit("")), "\n")
    # Rows that share an id are told apart by their text; alike rows have alike places.
    row = ["_order", "_key"]
    named = docs.select(order, F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))

    # Hashes alone first: which occur under more than one id.
    hashes = staged(named.select(*row, F.inline(let(split(F.col("_text")), lambda x: units_of(x, long_words)))).withColumn("_salt", salt(*row)))
    repeated = hashes.groupBy("h").agg(F.min("_order").alias("owner"), F.max("_order").alias("last")).filter("owner < last").drop("last")
    asked = staged(join_by_key(hashes, repeated, ["h"], "_salt", "inner").select(*row, "h", "code", "owner"))
    # Then the bytes of those: a hash of one text only needs no more; where texts clash, each has its own smallest id.
    wanted = asked.groupBy(*row).agg(F.collect_set(F.struct("h", "code")).alias("_want"))
    shared = named.join(wanted, row).select(*row, F.inline(let(split(F.col("_text")), lambda x: F.transform("_want", lambda u: F.struct(
        u["h"].alias("h"), u["code"].alias("code"), unit_text(x, u["code"]).alias("chunk"))))))
    texts = shared.groupBy("h", "chunk").agg(F.min("_order").alias("owner"))
    clash = staged(texts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    lost = asked.filter("_order > owner").select(*row, "code")
    if not clash.isEmpty():
        own = shared.join(clash, "h", "left_semi").withColumn("_salt", salt(*row))
        apart = join_by_key(own, texts.join(clash, "h", "left_semi"), ["h", "chunk"], "_salt", "inner").filter("_order > owner").select(*row, "code")
        lost = asked.filter("_order > owner").join(clash, "h", "left_anti").select(*row, "code").unionByName(apart)
    lost = lost.groupBy(*row).agg(F.collect_set("code").alias("_gone"))

    def cleaned(lines: Column) -> Column:
        codes = F.concat(F.coalesce("_gone", F.array().cast("array<int>")), own_repeats(lines, long_words))
        numbers = F.flatten(F.transform(codes, lambda c: F.sequence(F.shiftright(c, 1), F.shiftright(c, 1) + 1 - c % 2)))
        return let(F.when(F.size(codes) > 0, F.array_except(F.sequence(F.lit(1), F.size(lines)), numbers)), lambda kept: verdict(lines, kept))

    def verdict(lines: Column, kept: Column) -> Column:
        # A run of lines that went is a gap between lines that stay, or before the first or after the last.
        fenced = F.concat(F.array(F.lit(0)), kept, F.array(F.size(lines) + 1))
        gaps = let(fenced, lambda k: F.size(F.filter(F.transform(k, lambda x, i: x - F.get(k, F.greatest(i - 1, F.lit(0)))), lambda d: d > 1)))
        return F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i - 1)), "\n").alias("text"), F.size(lines).alias("n"),
                        F.coalesce(F.size(lines) - F.when(kept.isNotNull(), F.size(kept)), F.lit(0)).alias("lines"),
                        F.when(kept.isNotNull(), gaps).otherwise(0).alias("runs"))

    rest = [c for c in docs.columns if c not in (text_col, *counts)]
    whole = docs.select(order, F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"),
                        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    joined = whole.join(lost.hint("shuffle_hash"), row, "left")
    done = joined.select("_text", "_rest", let(split(F.col("_text")), cleaned).alias("_out"))
    text = F.when(F.col("_text").isNotNull(), F.coalesce("_out.text", "_text"))
    return done.select(
        *[text.alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns if c not in counts],
        F.col("_out.n").cast("long").alias("n_lines"), F.col("_out.lines").cast("long").alias("n_removed_lines"),
        F.col("_out.runs").cast("long").alias("n_removed_passages"))


#: ``dedupe_lines`` in DuckDB's SQL with the default parameters.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), marked AS (
  SELECT *, regexp_matches(line, '^[ \t\n\x0b\x0c\r]*(?:[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]+){49}[^ \t\n\x0b\x0c\r]') AS long,
         md5(concat(md5(lag(line) OVER w), md5(line)))[1] IN ('0','1','2','3','4','5','6','7') AND i > 1 AS rolled
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, rolled OR long OR coalesce(lead(long) OVER w, true) AS is_end FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no FROM ended
), chunks AS (
  SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS size, bool_or(long) AS long FROM numbered GROUP BY ALL
), judged AS (
  SELECT *, (size > 1 OR long) AND (doc_id > min(doc_id) OVER (PARTITION BY chunk, size > 1 OR long)
            OR chunk_no > min(chunk_no) OVER (PARTITION BY doc_id, chunk, size > 1 OR long)) AS gone FROM chunks
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR bool_and(NOT gone) THEN d.text
         ELSE coalesce(string_agg(chunk, chr(10) ORDER BY chunk_no) FILTER (NOT gone), '') END AS text,
       sum(size)::BIGINT AS n_lines, coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       (count(*) FILTER (gone))::BIGINT AS n_removed_chunks
FROM judged JOIN documents d USING (doc_id) GROUP BY d.doc_id, d.text
"""
