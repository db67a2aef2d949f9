import random

from pyspark.sql import functions as F

from rowwarden.operators import spread
from rowwarden.sources import listing


def test_numbering_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK_BITS", 2)
    rnd = random.Random(1)
    # File 3 holds most of the rows.
    keys = sorted({(rnd.choice([0, 1, 3, 3, 3, 9, 40]), rnd.randint(1, 300)) for _ in range(400)})
    rows = spark.createDataFrame(keys, "file_ix bigint, source_row int").repartition(5)
    got = {(r[0], r[1]): r[2] for r in spread.number_rows(rows, "file_ix", "source_row", "n", start=2).collect()}
    assert got == {k: i + 2 for i, k in enumerate(keys)}
    ranked = spread.ordinal_within(rows, ["file_ix"], "source_row", "n").collect()
    by_file = {}
    for f, r in keys:
        by_file.setdefault(f, []).append(r)
    assert all(by_file[r["file_ix"]].index(r["source_row"]) == r["n"] for r in ranked)


def test_lookups_with_a_hot_key(spark, monkeypatch):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None)
        .otherwise(F.col("id").cast("string")).alias("k"),
    )
    salted = rows.withColumn("s", spread.salt("id"))
    lookup = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = spread.join_by_key(salted, lookup, ["k"], "s")
    assert joined.count() == 3000
    assert {r["k"]: r["n"] for r in joined.filter("k = 'hot'").distinct().collect()} == {"hot": 2000}
    assert joined.filter("k is null and n is not null").count() == 0
    monkeypatch.setattr(spread, "BLOCK_BITS", 6)
    total = spread.aggregate_by_key(rows.filter("k is not null"), ["k"], "id", [F.min("id").alias("p"), F.count("*").alias("c")],
                                    [F.min("p").alias("first"), F.sum("c").alias("n")])
    assert total.filter("k = 'hot' and (first <> 1 or n <> 2000)").count() == 0 and total.count() == 2900
    every = spread.aggregate_by_key(rows, ["k"], "id", [F.min("id").alias("p")], [F.min("p").alias("first")])
    assert every.count() == 3000 and every.filter("k is null and first is not null").count() == 0


def test_running_sums_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK_BITS", 2)
    rnd = random.Random(4)
    counts = {rnd.randrange(1 << 9): rnd.randrange(5) for _ in range(120)} | {0: 3, 511: 2}
    got = spread.running_offset(spark.createDataFrame(list(counts.items()), "at bigint, n int").repartition(3), "at", "n", "before", bits=9)
    assert {r["at"]: r["before"] for r in got.collect()} == {k: sum(n for at, n in counts.items() if at < k) for k in counts}
    # The last window, which has no partitions, sees no more lines than a block has.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 5 and got.columns == ["at", "n", "before"]


def test_numbering_gathers_no_counts_of_many_files(spark, monkeypatch):
    # Files in one group of 65,536 whose rows lie far apart: a count for nearly every row.
    monkeypatch.setattr(spread, "BLOCK_BITS", 4)
    keys = [(f, r * 40) for f in range(14) for r in range(20)]
    rows = spark.createDataFrame(keys, "file_ix bigint, source_row int").repartition(5)
    numbered = spread.number_rows(rows, "file_ix", "source_row", "n")
    assert {(r[0], r[1]): r[2] for r in numbered.collect()} == {k: i for i, k in enumerate(keys)}
    windows = [line for line in numbered._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    of_counts = [w for w in windows if "_block#" in w]
    assert of_counts and all("windowspecdefinition(file_ix#" in w for w in of_counts)


def test_listing(spark):
    files = spark.createDataFrame(
        [("a.xlsx", 1, "/r/a.xlsx"), ("a.xlsx", 1, "/r/s/a.xlsx"), ("a.xlsx", 2, "/r/t/a.xlsx"), ("~$a.xlsx", 3, "/r/~$a.xlsx"),
         ("v.mp4", 4, "/r/v.mp4")], "name string, length long, path string",
    )
    indexed = listing.index_files(files)
    order = [r["path"] for r in indexed.orderBy("file_ix").collect()]
    assert order == sorted(order) and [r[0] for r in indexed.select("file_ix").orderBy("file_ix").collect()] == list(range(5))
    assert listing.drop_repeated_inputs(indexed).count() == 4
    names = [r["archive_name"] for r in listing.archive_names(indexed).filter("name = 'a.xlsx'").orderBy("file_ix").collect()]
    assert names == ["a.xlsx", "a (1).xlsx", "a (2).xlsx"]
    books, media = listing.split_listing(files)
    assert (books.count(), media.count()) == (3, 2)
    accepted, rejected = listing.split_uploads(files)
    assert (accepted.count(), rejected.count()) == (4, 1)
    asked = spark.createDataFrame([("/r",), ("/r/v.mp4",), ("/r/s/a.xlsx",), ("/none/",)], "location string")
    found, errors = listing.expand_folders(asked, files)
    assert sorted((r["location"], r["path"]) for r in found.collect()) == [
        ("/r", "/r/a.xlsx"), ("/r", "/r/~$a.xlsx"), ("/r/s/a.xlsx", "/r/s/a.xlsx")]
    assert {r["location"]: r["message"] for r in errors.collect()} == {
        "/r/v.mp4": '"v.mp4" is not an .xlsx or .xlsm file.',
        "/none/": 'Folder "none" contains no .xlsx or .xlsm files.'}
    links = spark.createDataFrame([("/r/v.mp4", "u2", 2), ("/r/v.mp4", "u1", 1)], "path string, url string, ord int")
    assert listing.attach_links(files, links).filter("link = 'u1'").count() == 1
    pasted = spark.createDataFrame([("/a\n\n/b/\nhttps://example.com/x",)], "t string")
    requests = listing.read_folder_requests(pasted, "t")
    assert requests.count() == 3
    assert sorted(r["path"] for r in listing.valid_roots(requests).collect()) == ["/a", "/b"]
