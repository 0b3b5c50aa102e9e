"""Headers longer than what is read at first."""

import pytest

from factloom.llm import shared, warc


@pytest.mark.parametrize("size", [8 << 20, 50_000])
def test_long_urls(spark, size):
    fake = "WARC/1.1\r\nx" * 30_000  # magic without a blank line behind it
    rows = [(i, "http://x/" + "u" * n, html) for i, n, html in ((1, 70_000, "one"), (2, 300_000, "two"), (3, 40_000, "same"), (4, 40_000, "same"), (5, 5, fake), (6, 65_400, "six"), (7, 9, ""))]
    folder = shared.shared_dir(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    found = warc.read(spark, folder, size)
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.pages(found).collect()) == [(i, len(h), 4 if i == 3 else None) for i, _, h in rows]
    assert {len(r.headers["warc-target-uri"]) for r in found.collect()} == {len(u) for _, u, _ in rows}
