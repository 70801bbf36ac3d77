"""Lookup of URLs that the writer has to clean."""

from schemaweft.llm import warc


def test_lookup_finds_urls_with_tabs_and_line_breaks(spark, tmp_path):
    urls = ["http://a.example.com/x\ty", "http://a.example.com/u\nv", "http://a.example.com/p q", "http://a.example.com/plain"]
    root = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(i, u, "body") for i, u in enumerate(urls)], "page_id long, url string, html string"), root)
    warc.write_index(spark, root)
    assert [[r.page_id for r in warc.lookup(spark, root, u).collect()] for u in urls] == [[0], [1], [2], [3]]
