"""Registered queries on sources, sinks, parsers and lookups: round trips through files in the shared folder, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import clean
from ..operators import hits, language, rank, score
from ..operators.index import Index, carry_sites
from ..session import shared_folder
from ..sources import documents
from .catalog import _base, _CUE, _cue, _index, _lexicon, _profiles, _rank_sql, _scores, _table, _term, PLAIN, register, SHORT
from .query import Phrase, parse, postfix


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw ones: key, url, title, date, mime, meta, body."""
    docs = _table(spark, d, "documents")
    i = F.col("doc_id")
    return docs.select(
        i.alias("key"), F.concat(F.lit("http://"), "source", F.lit(".example.com/"), i.cast("string")).alias("url"), F.concat(F.lit("Document "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("date"),
        F.when(i % 3 == 0, "text/plain").otherwise("text/html").alias("mime"), F.when(i % 4 == 0, F.array((i % 4).cast("long"))).otherwise(F.array_sort(F.array_distinct(F.array((i % 5 + 1), (i % 7 + 1))))).alias("meta"), F.col("text").alias("body"),
    )


_RAW = """raw AS (SELECT doc_id AS key, 'http://' || source || '.example.com/' || doc_id AS url, 'Document ' || doc_id AS title,
  CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime, CASE WHEN doc_id % 4 = 0 THEN [CAST(0 AS BIGINT)] ELSE list_sort(list_distinct([doc_id % 5 + 1, doc_id % 7 + 1])) END AS meta, coalesce(text, '') AS body FROM documents)"""


@register("wire_round_trip", f"WITH {_RAW} SELECT key, url, title, mime, CASE WHEN meta[1] = 0 THEN [] ELSE meta END AS meta, body FROM raw")
def wire_round_trip(spark, d):
    """Documents written as wire files and read back; a META of 0 is no number and so ends the bag."""
    path = _place(spark, "wire")
    documents.write_wire(_raw(spark, d), path)
    back = documents.read_wire(spark, f"{path}/*.txt")
    return back.where("error is null").select("key", "url", "title", "mime", "meta", "body")


@register("wire_errors", "SELECT doc_id % 2 AS kind, CASE WHEN doc_id % 2 = 0 THEN 'no ID' ELSE 'no end of the head' END AS error, count(*) AS n FROM documents GROUP BY ALL")
def wire_errors(spark, d):
    """Malformed records keep their text and say what is wrong."""
    docs = _table(spark, d, "documents").withColumn("value", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("URL x\n---\n"), F.coalesce("text", F.lit("")))).otherwise(F.lit("ID 7\nURL y")))
    found = documents.parse_records(docs.select("value"))
    return found.groupBy(F.when(F.col("error") == "no ID", 0).otherwise(1).cast("long").alias("kind"), "error").agg(F.count("*").alias("n"))


@register("header_fields", f"WITH {_RAW} SELECT key, url, title, 'text' AS mime FROM raw")
def header_fields(spark, d):
    """The first line of a field counts."""
    head = F.concat(F.lit("ID "), F.col("key").cast("string"), F.lit("\nURL "), "url", F.lit("\nMIME text\nMIME other\nTITLE "), "title")
    rows = _raw(spark, d).select(head.alias("h"))
    h = F.col("h")
    return rows.select(documents.header(h, "ID").cast("long").alias("key"), documents.header(h, "URL").alias("url"), documents.header(h, "TITLE").alias("title"), documents.header(h, "MIME").alias("mime"))


_BAG = "CASE WHEN doc_id % 5 = 0 THEN [doc_id + 1] ELSE list_sort(list_distinct([doc_id + 1, doc_id % 5, 3])) END"


@register("meta_bags", f"SELECT doc_id, {_BAG} AS bag, list_min(list_filter({_BAG}, lambda x: x BETWEEN 2 AND 50)) AS first, list_sort(list_distinct(list_append({_BAG}, 17))) AS more FROM documents")
def meta_bags(spark, d):
    """A META line up to its first 0 or word; the first number of a range; one number more."""
    i = F.col("doc_id")
    line = F.concat_ws(" ", (i + 1).cast("string"), (i % 5).cast("string"), F.lit("3 x 9"))
    rows = _table(spark, d, "documents").select("doc_id", documents.meta_bag(line).alias("bag"))
    return rows.select("doc_id", "bag", documents.meta_first(F.col("bag"), 2, 50).alias("first"), documents.meta_add(F.col("bag"), F.lit(17)).alias("more"))


@register("wiki_pages", "SELECT doc_id AS key, 'Page ' || doc_id AS title, 'body of ' || source || ' & <' || doc_id || '>' AS body FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def wiki_pages(spark, d):
    """A dump written as XML and read as pages: no titles with a colon, no redirects."""
    path, i = _place(spark, "wiki"), F.col("doc_id")
    body = F.when(i % 7 == 0, "#REDIRECT [[x]]").otherwise(F.concat(F.lit("body of "), "source", F.lit(" & <"), i.cast("string"), F.lit(">")))
    title = F.concat(F.when(i % 5 == 0, "Talk:").otherwise("Page "), i.cast("string"))
    pages = _table(spark, d, "documents").select(title.alias("title"), i.alias("id"), F.struct(body.alias("text")).alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return documents.read_wiki(spark, path)


@register("store_lookup", f"WITH {_RAW} SELECT key, url, title, body FROM raw WHERE key % 20 = 0")
def store_lookup(spark, d):
    """A store written in the order of keys, and the documents of some keys, also asked twice and unknown."""
    path, raw = _place(spark, "store"), _raw(spark, d).withColumn("body", F.coalesce("body", F.lit("")))
    documents.write_store(raw, path)
    keys = raw.where("key % 20 = 0").select("key")
    asked = keys.unionAll(keys).unionAll(keys.select(-F.col("key") - 1))
    return documents.lookup(spark.read.parquet(path), asked)


@register("store_hashes", f"WITH {_RAW} SELECT key, count(*) OVER (PARTITION BY url[1 : strpos(url, '.')]) AS same_site, count(*) OVER (PARTITION BY body) AS same_body FROM raw")
def store_hashes(spark, d):
    """How many documents share a site and a body, by the hashes of a store."""
    path = _place(spark, "store")
    documents.write_store(_raw(spark, d).withColumn("body", F.coalesce("body", F.lit(""))), path, with_hashes=True)
    rows = spark.read.parquet(path).select("key", "site_id", "body_hash")
    count = lambda by, name: rows.groupBy(by).agg(F.count("*").alias(name))
    return rows.join(count("site_id", "same_site"), "site_id").join(count("body_hash", "same_body"), "body_hash").select("key", "same_site", "same_body")


@register("crawl_filter", "SELECT page_id AS key FROM pages WHERE page_id % 3 <> 0 AND strlen(html) <= 3000")
def crawl_filter(spark, d):
    mime = F.when(F.col("page_id") % 3 == 0, "text/plain").otherwise("text/html; charset=utf-8")
    pages = _table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("body"), mime.alias("mime"))
    return documents.crawl(pages, 3000).select("key")


@register("lexicon_import", "SELECT p_name AS term FROM part")
def lexicon_import(spark, d):
    path = _place(spark, "lexicon")
    part = _table(spark, d, "part")
    part.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "x:").otherwise(""), "p_name").alias("value")).write.text(path)
    return documents.read_lexicon(spark, path)


_ODD = r"[^\x07-\x0a\x0c\x0d\x1b\x20-\x7e\x{80}-\x{10ffff}]"
_BYTES = rf"""WITH b AS (SELECT doc_id, text, doc_id % 3 AS how, NOT regexp_matches(text, '[^\x00-\x{{ff}}]') AS narrow, regexp_matches(text, '{_ODD}') AS odd, NOT regexp_matches(text, '[^\x00-\x7f]') AS plain, regexp_matches(text, '[\x{{80}}-\x{{84}}\x{{86}}-\x{{9f}}]') AS c1 FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, CASE WHEN how = 2 THEN 'utf16' WHEN odd THEN 'unknown' WHEN plain THEN 'ascii' WHEN how = 1 AND narrow THEN (CASE WHEN c1 THEN 'extended' ELSE 'latin1' END) ELSE 'utf8' END AS charset,
  CASE WHEN how = 2 OR NOT odd THEN text END AS text FROM b"""


@register("charset_of_bytes", _BYTES)
def charset_of_bytes(spark, d):
    """Texts as bytes of three encodings, told apart and decoded."""
    t, how = F.col("text"), F.col("doc_id") % 3
    body = F.when((how == 1) & ~t.rlike(r"[^\x00-\xff]"), F.encode(t, "ISO-8859-1")).when(how == 2, F.encode(t, "UTF-16")).otherwise(F.encode(t, "UTF-8"))
    rows = _table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", body.alias("b"))
    return rows.select("doc_id", clean.charset_of_bytes(F.col("b")).alias("charset"), clean.decode_bytes(F.col("b")).alias("text"))


@register("numeric_entities", "SELECT doc_id, 'caf' || chr(CAST(200 + doc_id % 900 AS INTEGER)) || ' & <' || chr(233) || '> &#0; é' AS text FROM documents")
def numeric_entities(spark, d):
    text = F.concat(F.lit("caf&#"), (200 + F.col("doc_id") % 900).cast("string"), F.lit("; &amp; &lt;&#xE9;&gt; &#0; é"))
    return _table(spark, d, "documents").select("doc_id", clean.expand_entities(text).alias("text"))


@register("site_hashes", "SELECT page_id AS did, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS same FROM (SELECT page_id, CASE WHEN contains(h, '.') THEN h END AS s FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages))")
def site_hashes(spark, d):
    """How many pages have the same site, by its hash; 0 stands for no site."""
    rows = _table(spark, d, "pages").select(F.col("page_id").alias("did"), clean.site_hash(F.col("url")).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("same")), "h").select("did", "same")


@register("unknown_charset_policy", r"SELECT doc_id, CASE WHEN text IS NULL OR regexp_matches(text, '[\x00-\x08\x0e-\x1f]') THEN '' ELSE text END AS text FROM documents")
def unknown_charset_policy(spark, d):
    return clean.drop_unknown_charset(_table(spark, d, "documents"), keep_all=True).select("doc_id", "text")


@register("site_entries", "SELECT site AS term, CAST(count(*) FILTER (WHERE did % 2 = 0) AS BIGINT) AS freq FROM (SELECT page_id AS did, CASE WHEN contains(h, '.') THEN h END AS site FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages)) WHERE site IS NOT NULL GROUP BY site")
def site_entries(spark, d):
    """A lexicon of half the pages' sites, which keeps the entries of the other half."""
    sites = _table(spark, d, "pages").select(F.col("page_id").alias("did"), clean.site(F.col("url")).alias("term")).where("term is not null")
    return carry_sites(Index.of_attributes(sites.where("did % 2 = 0")).norm, Index.of_attributes(sites).norm)


# lookups and parsers


@register("lexicon_lookup", f"WITH {_base(heads=True)}, {_lexicon()} SELECT term, kind, freq, is_frequent FROM lex WHERE term IN ('with', 'the', 'lang:en')")
def lexicon_lookup(spark, d):
    return _index(spark, d, IndexConfig(), heads=True).lookup(["With", "THE", "lang:en", "nosuchword"]).select("term", "kind", "freq", "is_frequent")


@register("term_frequency", f"WITH {_base()} SELECT term, freq FROM norm WHERE term = 'with'")
def term_frequency(spark, d):
    return _index(spark, d).frequency("With").select("term", "freq")


@register("lexicon_listing", f"WITH {_base()} SELECT term, freq FROM norm WHERE term >= 'th' ORDER BY term LIMIT 50")
def lexicon_listing(spark, d):
    return _index(spark, d).peek("th", 50).select("term", "freq")


@register("document_info", f"WITH {_base(50)} SELECT did, min(seg) AS first_seg, max(seg) AS last_seg, count(*) AS n_tokens, 1.0::DOUBLE AS prior FROM pos GROUP BY did")
def document_info(spark, d):
    return _index(spark, d, SHORT).docinfo()


_QUERIES = ['"of the" by /with', "by with", "with by", 'fox /"red dog', "red site:example.com", "a nosuchword /b"]
_KNOWN = {"of", "the", "by", "with", "fox", "red", "dog", "a", "b"}
_PARSED = """(0, 'cue', 0, 'with'), (0, 'key', 0, 'by'), (0, 'key', 1, 'of the'), (1, 'cue', 0, 'by'), (1, 'cue', 1, 'with'), (1, 'key', 0, 'by'), (1, 'key', 1, 'with'),
(2, 'cue', 0, 'by'), (2, 'cue', 1, 'with'), (2, 'key', 0, 'by'), (2, 'key', 1, 'with'), (3, 'cue', 0, 'red dog'), (3, 'key', 0, 'fox'), (4, 'cue', 0, 'red'), (4, 'key', 0, 'red'), (4, 'mod', 0, 'site:example.com'),
(5, 'cue', 0, 'b'), (5, 'key', 0, 'a'), (5, 'dropped', 0, 'nosuchword')"""


@register("query_syntax", f"SELECT q, side, k, node FROM (VALUES {_PARSED}) AS t(q, side, k, node)")
def query_syntax(spark, d):
    """Query strings in canonical order: keys, cues (the keys where there are none), modifiers and dropped words."""
    rows = []
    for i, text in enumerate(_QUERIES):
        query = parse(text, _KNOWN)
        shown = lambda nodes: sorted(" ".join(n.terms) if isinstance(n, Phrase) else n.term for n in set(nodes))
        for side, values in (("key", shown(query.keys)), ("cue", shown(query.cues)), ("mod", [f"{k}:{v}" for k, v in query.mods.items()]), ("dropped", list(query.dropped))):
            rows += [(i, side, k, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "q int, side string, k int, node string")


@register("hits_postfix", f"WITH {_base(50)} SELECT did, seg FROM segs EXCEPT ({_term('with')} INTERSECT {_term('by')})")
def hits_postfix(spark, d):
    """A postfix program: NOT complements the conjunction so far, AND changes nothing."""
    return hits.hits(_index(spark, d, SHORT), postfix(["with", "AND", "by", "NOT"]))


_ALWAYS_TOP = IndexConfig(n_frequent=0, segment_size=50, exact_up_to=0, rank_depth=300)


@register("rank_auto", f"WITH {_base(50)}, {_scores(_CUE)}, {_rank_sql(_term('by'), top='300', depth=300)}")
def rank_auto(spark, d):
    """With more hits than are ranked exactly, the best segments alone count."""
    ix = _index(spark, d, _ALWAYS_TOP)
    return rank.rank(ix, hits.Term("by"), score.scores(ix, _cue(ix)), mode="auto")


@register(
    "lang_tag",
    f"""WITH {_profiles('m', 'lang', 'text')}, {_profiles('d', 'doc_id', 'text')},
far AS (SELECT dp.doc_id AS did, l.lang, sum(coalesce(abs(dp.place - mp.place), 500)) AS distance FROM dp, (SELECT DISTINCT lang FROM mp) AS l LEFT JOIN mp ON mp.lang = l.lang AND mp.gram = dp.gram GROUP BY dp.doc_id, l.lang),
best AS (SELECT did, lang FROM far QUALIFY row_number() OVER (PARTITION BY did ORDER BY distance, lang) = 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN best.lang ELSE documents.lang END AS lang FROM documents LEFT JOIN best ON did = doc_id""",
)
def lang_tag(spark, d):
    """A third of the documents have lost their language, which is classified; the others keep theirs."""
    docs = _table(spark, d, "documents")
    lost = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return language.tag(lost, language.train(docs)).select("doc_id", "lang")
