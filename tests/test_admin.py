import pytest
from pyspark.sql import functions as F

from chapterlake.operators import adapt, pages
from chapterlake.sources import exports, readers


def test_config_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"config_id": "a",\n "url_patterns": ["/**"], "selectors": {"book": {"title": "h1"}}}')
    (tmp_path / "b.yaml").write_text("config_id: b\nversion: 2\nselectors:\n  clean: [.ad]\nrequest_policy:\n  max_retries: 3\n")
    a, b = readers.read_configs(spark, str(tmp_path / "a.json")).first(), readers.read_configs(spark, str(tmp_path / "b.yaml")).first()
    assert a["selectors"]["book"] == {"title": "h1"} and a["version"] is None
    assert (b["config_id"], b["version"], b["selectors"]["clean"], b["request_policy"]["max_retries"]) == ("b", 2, [".ad"], 3)
    with pytest.raises(ValueError):
        readers.read_configs(spark, str(tmp_path / "c.toml"))


def test_registered_exporters(spark):
    rows = spark.createDataFrame([(1, 1, "t", "a\n\nb"), (1, 0, "s", "<x>")], "book_id long, chapter_index int, title string, body string")
    assert exports.exporter("md")(rows).first()["content"] == "## s\n\n<x>\n\n## t\n\na\n\nb\n\n"
    assert exports.exporter("jsonl")(rows).first()["content"].split("\n")[1] == '{"type":"chapter","index":0,"title":"s","content":"<x>"}'
    assert exports.exporter("xhtml")(rows).first()["content"] == "<h1>s</h1>\n<p>&lt;x&gt;</p>\n<h1>t</h1>\n<p>a</p>\n<p>b</p>"
    assert exports.exporter("other") is exports.to_text
    exports.register_exporter("other", exports.to_markdown)
    assert exports.exporter("other") is exports.to_markdown
    del exports.EXPORTS["other"]


def test_export_batches(spark):
    shelf = spark.range(5).withColumnRenamed("id", "book_id")
    rows = spark.createDataFrame([(0, 0, "t", "b", "done"), (1, 0, "t", "b", "failed"), (4, 0, "t", "b", "done")], "book_id long, chapter_index int, title string, body string, status string")
    assert exports.export_all(shelf, rows, "txt", 3).first().asDict() == {"books": 3, "exported": 1, "failed": 2, "remaining": 2}


def test_scoring_rules_of_a_caller(spark):
    html = "<title>Book</title><h1>Book of Tests</h1><p>x</p>"
    p = spark.createDataFrame([(1, "http://h.test/1", html)], "page_id long, url string, html string")
    nodes = pages.flatten(p)
    c = adapt.context(p, nodes, p.select("page_id", F.lit("book_index").alias("kind")))
    found = adapt.candidates(c, {"heading": adapt.headings})
    scored = adapt.score(c, found, {"title": [("always", F.lit(1.0), 3), ("never", F.lit(0.0), 1)]}).filter("field = 'title'")
    assert {r["score"] for r in scored.collect()} == {0.75} and scored.first()["components"][0]["id"] == "title.always"
    for bad in ([("a", F.lit(1.0), 0)], [("a", F.lit(1.0), 1), ("a", F.lit(1.0), 1)], []):
        with pytest.raises(ValueError):
            adapt.score(c, found, {"title": bad})
