"""The paged scan: ranges, attempts, offsets over restarts."""

import json
import os
import re

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException

from ordermill.plans import books
from ordermill.sources import scan
from ordermill.streaming.catalogue import ingest_pages


def land_page(folder, offset, *texts):
    os.makedirs(f"{folder}/start={offset}", exist_ok=True)
    with open(f"{folder}/start={offset}/page.txt", "w") as file:
        file.write("\n".join(texts))


def land(folder, first, last):
    """Pages of two records each."""
    for offset in range(first, last, 2):
        docs = [{"key": f"/works/W{n}", "title": f"t{n}"} for n in (offset, offset + 1)]
        land_page(folder, offset, json.dumps({"start": offset, "docs": docs}))


def test_ranges_cover_every_record_once():
    pages = scan.LandedPages({"path": "/x", "page_size": "10"})
    got = pages.ranges(30, 100, 3)
    assert [(r.offset, r.limit) for r in got] == [(30, 30), (60, 30), (90, 10)]
    assert pages.ranges(30, 30, 3) == [scan.PageRange(30, 0)]
    assert list(pages.records(scan.PageRange(30, 0))) == []


def test_a_batch_scan_reads_up_to_the_first_gap(spark, folder):
    pages = f"{folder}/pages"
    assert scan.scanned_pages(spark, pages, page_size=2).count() == 0
    land(pages, 0, 14)
    land(pages, 16, 20)
    land_page(pages, 4, "{torn")
    found = scan.scanned_pages(spark, pages, page_size=2, pages_per_range=3)
    assert found.rdd.getNumPartitions() == 3
    docs = books.page_documents(found.where("docs IS NOT NULL"))
    assert rows(docs, "page_start", "position", "doc.key") == sorted(
        [(n - n % 2, n % 2, f"/works/W{n}") for n in range(14) if n not in (4, 5)], key=repr)
    assert rows(found.where("docs IS NULL"), "start", "_corrupt_record") == [(4, "{torn")]


class Flaky(scan.LandedPages):
    """Notes every attempt; the page at 6 fails for so many attempts as the option says."""

    def fetch(self, offset):
        self.made = getattr(self, "made", {})
        self.made[offset] = self.made.get(offset, 0) + 1
        if offset == 6 and self.made[offset] <= self.failures:
            raise OSError("timeout")
        return super().fetch(offset)


def flaky(folder, failures):
    pages = Flaky({"path": folder, "page_size": "2", "attempts": "3", "wait": "0"})
    pages.failures = failures
    return pages


def test_only_the_page_that_failed_is_fetched_again(folder):
    land(folder, 0, 12)
    pages = flaky(folder, 2)
    got = [list(pages.records(part)) for part in pages.ranges(0, 12, 2)]
    assert [len(lines) for lines in got] == [2, 2, 2]
    assert pages.made == {0: 1, 2: 1, 4: 1, 6: 3, 8: 1, 10: 1}
    with pytest.raises(OSError):
        list(flaky(folder, 3).records(scan.PageRange(4, 4)))


def stream(spark, folder, table, per_batch):
    pages = scan.scanned_pages(spark, f"{folder}/pages", stream=True, page_size=2, wait=0, pages_per_range=1, pages_per_batch=per_batch, progress=f"{folder}/progress")
    writer = ingest_pages(pages, table, f"{folder}/checkpoint")
    running = writer.trigger(processingTime="0 seconds").start()
    running.processAllAvailable()
    ends = [int(re.search(r"\d+", str(p.sources[0].endOffset))[0]) for p in running.recentProgress if p.numInputRows]
    running.stop()
    return ends


def test_a_stream_goes_on_at_its_offset(spark, folder):
    table = books.books_table(spark, f"{folder}/table", buckets=2)
    land(f"{folder}/pages", 0, 10)
    assert stream(spark, folder, table, per_batch=2) == [4, 8, 10]
    assert stream(spark, folder, table, per_batch=2) == []
    land(f"{folder}/pages", 10, 18)
    land(f"{folder}/pages", 22, 24)  # beyond a gap: waits
    # batches smaller than what lies behind them do not lead back
    assert stream(spark, folder, table, per_batch=1) == [12, 14, 16, 18]
    assert sorted(r.work_key for r in table.read().collect()) == sorted(f"W{n}" for n in range(18))
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 19))


def test_a_batch_that_failed_is_read_again(spark, folder, monkeypatch):
    table = books.books_table(spark, f"{folder}/table", buckets=2)
    land(f"{folder}/pages", 0, 8)
    read = scan.LandedPages.fetch
    with monkeypatch.context() as patch:

        def fails(self, offset):
            if offset == 4:
                raise OSError("timeout")
            return read(self, offset)

        patch.setattr(scan.LandedPages, "fetch", fails)
        with pytest.raises(StreamingQueryException, match="timeout"):
            stream(spark, folder, table, per_batch=4)
    assert table.read().count() == 0
    stream(spark, folder, table, per_batch=4)
    assert sorted(r.work_key for r in table.read().collect()) == [f"W{n}" for n in range(8)]
