import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ordermill import schemas
from ordermill.functions.catalogue import first_or_default, steady_price
from ordermill.operators.quality import EmptyTableError
from ordermill.operators.upsert import collapse_batch, number_rows, upsert
from ordermill.plans import books
from ordermill.sources.pages import read_pages, stream_pages
from ordermill.streaming.catalogue import ingest_pages


def write_pages(folder, name, *pages):
    with open(f"{folder}/{name}", "w") as handle:
        handle.writelines((p if isinstance(p, str) else json.dumps(p)) + "\n" for p in pages)


def doc(key, title="T", **fields):
    return {"key": key, "title": title, **fields}


def normalized(spark, folder, *docs):
    write_pages(folder, "p.json", {"start": 0, "docs": list(docs)})
    found = books.normalize(books.page_documents(read_pages(spark, folder)))
    return {r.work_key: r for r in found.collect()}


def test_normalize(spark, folder):
    found = normalized(
        spark, folder,
        doc("/works/OL1W", "x" * 600, author_name=["a", "b", "c", "d", "e", "f", "g"], isbn=[], first_publish_year=0,
            cover_i=0, language=["l" * 300]),
        doc("/works/OL2W", None, author_name=["a", None], first_publish_year=1999, cover_i=12),
        doc("", "no key"), doc("/works/", "no key either"), {"title": "missing key"},
    )
    assert set(found) == {"OL1W", "OL2W"}
    one, two = found["OL1W"], found["OL2W"]
    assert (len(one.title), one.author_name, one.isbn, one.first_publish_year, one.cover_id, len(one.language)) == (
        500, "a, b, c, d, e", "", None, "", 200)
    assert (two.title, two.author_name, two.author_key, two.first_publish_year, two.cover_id) == (
        "", "a, None", "", 1999, "12")


def test_price_is_steady_and_in_range(spark):
    priced = spark.range(5000).select(steady_price(F.col("id").cast("string")).alias("p"))
    low, high, kinds = priced.agg(F.min("p"), F.max("p"), F.count_distinct("p")).first()
    assert Decimal("5.00") <= low < high <= Decimal("50.00") and kinds > 1000


def test_first_or_default(spark):
    frame = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "items ARRAY<STRING>")
    assert [r[0] for r in frame.select(first_or_default(F.col("items"), "-")).collect()] == ["a", "-", "-"]


def test_collapse_takes_last_of_some_and_first_of_others(spark):
    batch = spark.createDataFrame(
        [("k", 1, "t1", "i1"), ("k", 3, "t3", "i3"), ("k", 2, None, "i2"), ("j", 1, "u", "v")],
        "work_key STRING, place INT, title STRING, isbn STRING")
    got = collapse_batch(batch, "work_key", [F.col("place")], ["title"])
    assert rows(got, "work_key", "title", "isbn") == [("j", "u", "v"), ("k", "t3", "i1")]


def test_upsert_policy(spark):
    schema = "k STRING, title STRING, isbn STRING, extra INT"
    current = spark.createDataFrame([("a", "t", "i", 1), ("b", "t", "i", 2)], schema)
    incoming = spark.createDataFrame([("b", None, "new"), ("c", "n", "n")], "k STRING, title STRING, isbn STRING")
    assert rows(upsert(current, incoming, "k", ["title"])) == [
        ("a", "t", "i", 1), ("b", None, "i", 2), ("c", "n", "n", None)]


@pytest.mark.parametrize("largest, first", [(5, 6), (0, 1)])
def test_ids_continue_without_gaps(spark, largest, first):
    fresh = spark.range(500).select(F.concat(F.lit("n"), "id").alias("k"))
    got = number_rows(fresh, "k", "id", largest, buckets=16)
    assert sorted(r.id for r in got.collect()) == list(range(first, first + 500))


def test_crawl_twice(spark, folder):
    import os

    os.mkdir(f"{folder}/pages")
    table = books.books_table(spark, f"{folder}/table", buckets=4)
    write_pages(f"{folder}/pages", "1.json",
                {"start": 0, "docs": [doc("/works/A", "a", isbn=["1"]), doc("/works/B", "b")]},
                {"start": 100, "docs": [doc("/works/A", "a2", isbn=["2"])]})
    books.run_books(table, read_pages(spark, f"{folder}/pages"))
    first = {r.work_key: r for r in table.read().collect()}
    assert (first["A"].title, first["A"].isbn) == ("a2", "1")
    write_pages(f"{folder}/pages", "1.json", {"start": 0, "docs": [doc("/works/B", "b2", isbn=["9"]), doc("/works/C")]})
    books.run_books(table, read_pages(spark, f"{folder}/pages"))
    second = {r.work_key: r for r in table.read().collect()}
    assert (second["B"].title, second["B"].isbn, second["B"].id) == ("b2", "", first["B"].id)
    assert second["B"].created_at == first["B"].created_at
    assert sorted(r.id for r in second.values()) == [1, 2, 3]


def test_streamed_pages_resume_and_set_aside_unreadable_ones(spark, folder):
    import os

    os.mkdir(f"{folder}/pages")
    table = books.books_table(spark, f"{folder}/table", buckets=4)

    def run():
        pages = stream_pages(spark, f"{folder}/pages", max_files_per_batch=1)
        writer = ingest_pages(pages, table, f"{folder}/checkpoint", f"{folder}/dead")
        writer.trigger(availableNow=True).start().awaitTermination()

    write_pages(f"{folder}/pages", "1.json", {"start": 0, "docs": [doc("/works/A", "a")]}, "{broken")
    run()
    before = table.read().inputFiles()
    run()
    assert table.read().inputFiles() == before
    write_pages(f"{folder}/pages", "2.json", {"start": 100, "docs": [doc("/works/A", "a2"), doc("/works/B", "b")]})
    run()
    assert rows(table.read(), "work_key", "title") == [("A", "a2"), ("B", "b")]
    assert rows(spark.read.parquet(f"{folder}/dead"), "_corrupt_record") == [("{broken",)]


def test_a_batch_load_sets_unreadable_pages_aside(spark, folder):
    import os

    os.mkdir(f"{folder}/pages")
    write_pages(f"{folder}/pages", "1.json", {"start": 0, "docs": [doc("/works/A", "a")]}, "{broken")
    table = books.books_table(spark, f"{folder}/table", buckets=4)
    books.run_books(table, read_pages(spark, f"{folder}/pages"))
    assert rows(table.read(), "work_key") == [("A",)]
    assert rows(spark.read.parquet(table.dead_letters()), "_corrupt_record") == [("{broken",)]


def test_a_key_twice_in_a_page_and_in_a_later_page(spark, folder):
    import os

    os.mkdir(f"{folder}/pages")
    page = {"start": 0, "docs": [doc("/works/A", "a1", isbn=["1"]), doc("/works/B", "b"), doc("/works/A", "a2", isbn=["2"])]}
    write_pages(f"{folder}/pages", "1.json", {"start": 100, "docs": [doc("/works/B", "b2")]}, page)
    table = books.books_table(spark, f"{folder}/table", buckets=4)
    books.run_books(table, read_pages(spark, f"{folder}/pages"))
    assert rows(table.read(), "work_key", "title", "isbn") == [("A", "a2", "1"), ("B", "b2", "")]


def test_empty_catalogue_fails(spark, folder):
    import os

    os.mkdir(f"{folder}/pages")
    write_pages(f"{folder}/pages", "1.json", {"start": 0, "docs": []})
    with pytest.raises(EmptyTableError):
        books.run_books(books.books_table(spark, f"{folder}/table", buckets=4), read_pages(spark, f"{folder}/pages"))


def test_a_small_batch_is_written_beside_the_buckets(spark, folder, monkeypatch):
    """A batch writes its own works, not the buckets they are in; in time the buckets take them in."""
    import os

    from ordermill.sinks import keyed

    def crawl(*titles):
        docs = [doc(f"/works/W{n}", title, isbn=[title]) for n, title in titles]
        path = f"{folder}/pages{titles[0][1]}"
        os.mkdir(path)
        write_pages(path, "1.json", {"start": 0, "docs": docs})
        return read_pages(spark, path)

    monkeypatch.setattr(keyed, "SETTLE_AFTER", 3)
    table = books.books_table(spark, f"{folder}/table", buckets=2)
    books.apply_pages(table, crawl(*[(n, "a") for n in range(40)]))
    table.settle()
    settled = set(spark.read.parquet(table.rows).inputFiles())
    assert books.apply_pages(table, crawl((3, "b"), (40, "b")), "s", 0)
    assert books.apply_pages(table, crawl((3, "c"), (41, "c")), "s", 1)
    assert not books.apply_pages(table, crawl((3, "d")), "s", 1)  # this batch again
    assert settled < set(table.read().inputFiles())
    expected = sorted([(f"W{n}", "a", "a") for n in range(40) if n != 3] + [("W3", "c", "a"), ("W40", "b", "b"), ("W41", "c", "c")])
    assert rows(table.read(), "work_key", "title", "isbn") == expected
    assert rows(table.read_for(spark.createDataFrame([("W3",)], "work_key STRING")).where("work_key = 'W3'"), "title") == [("c",)]
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 43)) and table.largest("id") == 42
    books.apply_pages(table, crawl((40, "e")))
    assert settled - set(table.read().inputFiles()) and not os.listdir(table.recent)
    assert rows(table.read(), "work_key", "title", "isbn") == sorted(("W40", "e", "b") if r[0] == "W40" else r for r in expected)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
