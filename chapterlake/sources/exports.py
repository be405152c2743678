"""Exports: one text a book, from its chapters in order.

chapters: book_id, chapter_index, title, body. The text of one book is one
value by nature; books are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _joined(chapters: DataFrame, line: Column, sep: str = "") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("chapter_index", line.alias("line"))))
    return chapters.groupBy("book_id").agg(F.array_join(ordered["line"], sep).alias("content"))


def to_text(chapters: DataFrame) -> DataFrame:
    """Title, empty line, body, two empty lines for each chapter."""
    return _joined(chapters, F.concat(F.trim("title"), F.lit("\n\n"), F.trim("body"), F.lit("\n\n\n")))


def to_markdown(chapters: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("body", "\n"), text.strip), lambda x: x != "")
    return _joined(chapters, F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n\n"))), "")))


def to_json_lines(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """A row for the book, then one for each chapter: book_id, nth, line."""
    head = books.select("book_id", F.lit(-1).cast("long").alias("nth"), F.to_json(F.struct(F.lit("book").alias("type"), *books.columns)).alias("line"))
    rows = chapters.select("book_id", F.col("chapter_index").cast("long").alias("nth"), F.to_json(F.struct(F.lit("chapter").alias("type"), F.col("chapter_index").alias("index"), "title", F.col("body").alias("content"))).alias("line"))
    return head.unionByName(rows)


def to_xhtml(chapters: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("body", "\n"), text.strip), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), text.xml_escape(x), F.lit("</p>"))), "\n")
    return chapters.select("book_id", F.format_string("chap_%05d.xhtml", "chapter_index").alias("file"), F.concat(F.lit("<h1>"), text.xml_escape(F.col("title")), F.lit("</h1>\n"), body).alias("content"))


def to_jsonl(chapters: DataFrame) -> DataFrame:
    """The JSON lines of a book as one text: the book's, then its chapters'."""
    lines = to_json_lines(chapters.select("book_id").distinct(), chapters)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "line")))
    return lines.groupBy("book_id").agg(F.array_join(ordered["line"], "\n").alias("content"))


def to_xhtml_book(chapters: DataFrame) -> DataFrame:
    """The XHTML of a book's chapters, one after another."""
    ordered = F.array_sort(F.collect_list(F.struct("file", "content")))
    return to_xhtml(chapters).groupBy("book_id").agg(F.array_join(ordered["content"], "\n").alias("content"))


#: Writers by format: chapters -> (book_id, content).
EXPORTS = {"txt": to_text, "md": to_markdown, "jsonl": to_jsonl, "xhtml": to_xhtml_book}


def register_exporter(name: str, writer) -> None:
    """Adds or replaces a format."""
    EXPORTS[name] = writer


def exporter(name: str):
    """The writer of a format; unknown formats are text."""
    return EXPORTS.get(name, to_text)


def to_exchange(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, document, error_code): a JSON document of the done chapters
    with a body, in order; a first line that is the title goes. Books without
    such chapters have a code in place of the document."""
    body = text.strip(F.col("body"))
    line = text.strip(F.substring_index(body, "\n", 1))
    rest = F.when((line == text.strip(F.col("title"))) & body.contains("\n"), text.strip(F.substring(body, F.instr(body, "\n") + 1, F.length(body)))).otherwise(body)
    key = F.concat(F.lit("book-"), F.col("book_id").cast("string"))
    row = F.struct(F.col("chapter_index").alias("number"), F.concat(key, F.lit("-chapter-"), F.col("chapter_index").cast("string")).alias("id"), "title", rest.alias("content"))
    good = chapters.filter((F.col("status") == "done") & (body != "")).groupBy("book_id").agg(F.array_sort(F.collect_list(row)).alias("chapters"))
    head = F.struct(key.alias("id"), *[F.col(c) for c in ("title", "author") if c in books.columns])
    joined = books.join(good, "book_id", "left")
    document = F.when(F.col("chapters").isNotNull(), F.to_json(F.struct(head.alias("book"), "chapters")))
    return joined.select("book_id", document.alias("document"), F.when(F.col("chapters").isNull(), "no_completed_chapters").alias("error_code"))


def markdown_head(books: DataFrame) -> DataFrame:
    """Title, author and site lines before a book's chapters; absent columns
    and nulls have no line."""
    line = lambda label, c: F.coalesce(F.concat(F.lit(label), F.col(c) if c in books.columns else F.lit(None), F.lit("\n\n")), F.lit(""))
    return books.select("book_id", F.concat(line("# ", "title"), line("Author: ", "author"), line("Site: ", "site"), F.lit("---\n\n")).alias("head"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Writes (book_id, content) as text, one folder a book; a re-run
    replaces the same folders."""
    texts.select("book_id", "content").write.mode("overwrite").partitionBy("book_id").option("lineSep", "\n").text(path)


def export_summary(books: DataFrame, exported: DataFrame) -> DataFrame:
    """Books asked for, exported and failed."""
    ok = F.count_if(F.coalesce(F.length("content"), F.lit(0)) > 0)
    joined = books.select("book_id").join(exported, "book_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("books"), ok.alias("exported"), (F.count(F.lit(1)) - ok).alias("failed"))


def export_all(books: DataFrame, chapters: DataFrame, name: str = "txt", most: int | None = None) -> DataFrame:
    """Counts of exporting the done chapters of all books, or of the first
    `most` by id (the batch of one call): asked for, exported, failed (nothing
    to write), and books that remain for a later call."""
    first = books.select("book_id").distinct()
    first = first if most is None else first.orderBy("book_id").limit(most)
    done = chapters.filter("status = 'done'").join(first, "book_id", "left_semi")
    summary = export_summary(first, exporter(name)(done))
    total = books.agg(F.countDistinct("book_id").alias("_all"))
    return summary.crossJoin(total).select("books", "exported", "failed", (F.col("_all") - F.col("books")).alias("remaining"))  # one row each
