"""Sources and sinks of documents.

A raw document is ``head`` (lines of ``FIELD value``) and ``body``. As a row: key, url, title, date, mime,
meta (array of numbers), body, and ``error`` where a record is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import site_hash

HEAD_END = "\n---\n"

#: Bytes of a wire file that are records at a time, and records in a file, which is read as a whole.
PIECE, FILE_RECORDS = 4 << 20, 1000


def header(head: Column, field: str) -> Column:
    """The rest of the first line that starts with a field's name; null without one."""
    value = F.regexp_extract(head, rf"(?m)^{field} ([^\n]*)$", 1)
    return F.when(head.rlike(rf"(?m)^{field} "), value)


def split_record(record: Column) -> tuple[Column, Column]:
    """Head and body of a record; the body is null where no line of dashes ends the head."""
    at = F.instr(record, HEAD_END)
    return F.when(at > 0, F.substr(record, F.lit(1), at - 1)), F.when(at > 0, F.substr(record, at + len(HEAD_END)))


def meta_bag(text: Column) -> Column:
    """Numbers of a META line up to the first that is none (or 0), ascending, each once."""
    good = F.regexp_extract(F.trim(text), r"^((?:[1-9][0-9]*(?:\s+|$))*)", 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(good, r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))))


def meta_first(meta: Column, low: int, high: int) -> Column:
    """The first number from ``low`` to ``high``; null if there is none."""
    return F.get(F.filter(meta, lambda x: x.between(low, high)), F.lit(0))


def meta_add(meta: Column, value: Column) -> Column:
    """The bag with one more number, ascending."""
    return F.array_sort(F.array_union(F.coalesce(meta, F.expr("cast(array() as array<bigint>)")), F.array(value.cast("long"))))


def parse_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Rows of records (head, a line of dashes, body). A record without that line or without an ID keeps its text and says so in ``error``."""
    head, body = split_record(F.col(column))
    key = header(head, "ID").cast("long")
    error = F.when(head.isNull(), "no end of the head").when(key.isNull(), "no ID")
    return records.select(
        key.alias("key"), header(head, "URL").alias("url"), header(head, "TITLE").alias("title"), header(head, "DATE").alias("date"), header(head, "MIME").alias("mime"),
        meta_bag(F.coalesce(header(head, "META"), F.lit(""))).alias("meta"), F.coalesce(body, F.col(column)).alias("body"), error.alias("error"),
    )


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """Documents of wire files (a length in bytes, a line end, the record), one task a file.

    A bad length or a file that ends in a record gives a last row with ``error``.
    """

    def cut(batches):
        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["value", "broken"])

        for batch in batches:
            for one in batch.column(0):
                content = one.as_py()
                texts, errors, at, since = [], [], 0, 0
                while at < len(content):
                    if content[at : at + 1].isspace():
                        at += 1
                        continue
                    end = content.find(b"\n", at)
                    number = content[at:end].strip() if end > 0 else b""
                    if not number.isdigit() or not int(number):
                        texts.append(content[at : at + 100].decode("utf-8", "replace"))
                        errors.append("bad length")
                        break
                    at = end + 1 + int(number)
                    texts.append(content[end + 1 : at].decode("utf-8", "replace"))
                    errors.append("the file ends in a record" if at > len(content) else None)
                    if at - since >= PIECE:
                        yield rows()
                        texts, errors, since = [], [], at
                yield rows()

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(cut, "value string, broken string")
    parsed = parse_records(rows.where("broken is null"))
    return parsed.unionByName(rows.where("broken is not null").select(F.col("value").alias("body"), F.col("broken").alias("error")), allowMissingColumns=True)


def to_record(docs: DataFrame) -> DataFrame:
    """(value): wire records of documents, their length in bytes before them."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} "), F.col(c).cast("string")))
    meta = F.when(F.size("meta") > 0, F.concat(F.lit("META "), F.array_join(F.col("meta").cast("array<string>"), " ")))
    head = F.concat_ws("\n", line("ID", "key"), line("URL", "url"), line("TITLE", "title"), line("DATE", "date"), meta, line("MIME", "mime"))
    record = F.concat(head, F.lit(HEAD_END), F.coalesce("body", F.lit("")))
    return docs.select(F.concat(F.octet_length(record).cast("string"), F.lit("\n"), record).alias("value"))


def write_wire(docs: DataFrame, path: str) -> None:
    to_record(docs).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_wiki(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(key, title, body) of a wiki dump: pages whose title has no colon and that redirect nowhere; ``key`` is the page's id."""
    schema = "id long, title string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    body = F.col("revision.text._VALUE")
    rows = pages.select(F.col("id").alias("key"), "title", body.alias("body"))
    rows = rows.where(~F.col("title").contains(":") & F.col("body").isNotNull() & ~F.col("body").rlike("#REDIRECT|#redirect"))
    return rows.orderBy("key").limit(most) if most else rows


def crawl(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Documents of a crawl: HTML by its type, of at most ``most`` bytes."""
    return docs.where((F.octet_length("body") <= most) & F.col("mime").startswith("text/html"))


def write_store(docs: DataFrame, path: str, with_hashes: bool = False) -> None:
    """A document store (key, url, title, body), sorted by key so that a lookup reads few row groups."""
    rows = docs.select("key", "url", "title", "body")
    if with_hashes:
        rows = rows.withColumns({"body_hash": F.xxhash64("body"), "site_id": site_hash(F.col("url"))})
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(path)


def lookup(store: DataFrame, keys: DataFrame, most: int = 10_000) -> DataFrame:
    """Stored documents of a page of keys (few): broadcast up to ``most``, a shuffle past that."""
    few = keys.select("key").distinct()
    return store.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, "key", "left_semi")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines of a lexicon file without a one-letter prefix and colon."""
    return spark.read.text(path).select(F.regexp_replace("value", "^.:", "").alias("term"))
