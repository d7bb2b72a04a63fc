"""Ingest cleaning: sizes, character sets, HTML, titles, sites. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that count as HTML.
TAGS = (
    "html body head title meta link base style script noscript "
    "h1 h2 h3 h4 h5 h6 p br hr div span pre blockquote center address "
    "table tr td th tbody thead tfoot caption colgroup col "
    "ul ol li dl dt dd menu dir "
    "a img map area object param applet iframe frame frameset noframes embed "
    "form input button select option optgroup textarea label legend fieldset isindex "
    "b i u s em strong tt big small strike del ins sub sup code kbd samp var q cite dfn abbr acronym bdo font basefont "
    "article section nav header footer main aside figure video audio"
).split()
_TAG = "|".join(sorted(TAGS, key=lambda t: (-len(t), t)))
#: (pattern, replacement), applied in turn. Only what RE2 has too. A block is cut only where it is closed.
HTML_STEPS = (
    (r"(?is)<!doctype[^>]*>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>", ""),
    (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", ""),
    (r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>", ""),
    (r"(?is)<noscript(?:\s[^>]*)?>.*?</noscript\s*>", ""),
    (rf"(?is)</(?:{_TAG})(?:\s[^>]*)?>", ""),
    (rf"(?is)<(?:{_TAG})(?:[\s/][^>]*)?/?>", " "),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
SPACE_STEPS = ((r"[ \t]+", " "), (r" ?\n\s*", "\n"))


def strip_html(html: Column) -> Column:
    """Text without doctype, comments, head, scripts, styles and known tags; an opening tag leaves one blank."""
    for pattern, new in HTML_STEPS:
        html = F.regexp_replace(html, pattern, new)
    return html


def expand_entities(text: Column) -> Column:
    """The common named entities as characters, then numeric ones (&#233; and &#xE9;), the ampersand last."""
    for name, c in ENTITIES[:-1]:
        text = F.replace(text, F.lit(name), F.lit(c))
    text = F.when(text.contains("&#"), numeric_entities(text)).otherwise(text)
    name, c = ENTITIES[-1]
    return F.replace(text, F.lit(name), F.lit(c))


def numeric_entities(text: Column) -> Column:
    """Numeric entities as characters; those of no character (0, surrogates, past U+10FFFF) stay. Each distinct entity of a text is replaced once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"), F.lit(0)))

    def shown(entity: Column) -> Column:
        body = F.lower(F.substr(entity, F.lit(3), F.length(entity) - 3))
        code = F.when(body.startswith("x"), F.conv(F.substr(body, F.lit(2)), 16, 10).cast("int")).otherwise(body.cast("int"))
        good = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)

    return F.aggregate(found, text, lambda t, e: F.replace(t, e, shown(e)))


def normalise_space(text: Column) -> Column:
    """Runs of blanks and tabs as one blank; an end of line with what white space is around it as one."""
    for pattern, new in SPACE_STEPS:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def title(html: Column) -> Column:
    """What follows a bare <title>, up to the next tag: 1024 characters at most, line ends as blanks."""
    return F.translate(F.substring(F.regexp_extract(html, "(?is)<title>([^<]*)", 1), 1, 1024), "\n\r", "  ")


def is_html(text: Column) -> Column:
    """Whether a known tag opens somewhere."""
    return text.rlike(rf"(?i)<(?:{_TAG})[\s/>]")


def site(url: Column) -> Column:
    """Host of a URL in lower case, without scheme, user, port and a leading ``www.``; null where it has no dot."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains("."), host)


def site_hash(url: Column) -> Column:
    """Hash of the site, 0 where there is none."""
    return F.coalesce(F.when(site(url).isNotNull(), F.xxhash64(site(url))), F.lit(0).cast("long"))


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(site(url), r"([^.]+\.[^.]+)$", 1)


def charset_class(text: Column) -> Column:
    """ascii, latin1 or extended by the widest character; unknown for null or where a control character shows that it is no text."""
    return (
        F.when(text.isNull() | text.rlike(r"[\x00-\x08\x0e-\x1f]"), "unknown")
        .when(~text.rlike(r"[^\x00-\x7f]"), "ascii")
        .when(~text.rlike(r"[^\x00-\xff]"), "latin1")
        .otherwise("extended")
    )


def charset_of_bytes(body: Column) -> Column:
    """What raw bytes look like, in the order of the usual cascade: ascii, utf8, utf16 (by its mark), latin1, extended (figures of C1 besides), unknown."""
    one = F.decode(body, "ISO-8859-1")  # a character for each byte
    text = r"\x07-\x0a\x0c\x0d\x1b\x20-\x7e"
    return (
        F.when(body.isNull(), "unknown")
        .when(~one.rlike(f"[^{text}]"), "ascii")
        .when(F.is_valid_utf8(body.cast("string")) & ~one.rlike(rf"[^{text}\x80-\xff]"), "utf8")
        .when(F.hex(F.substring(body, 1, 2)).isin("FEFF", "FFFE"), "utf16")
        .when(~one.rlike(rf"[^{text}\x85\xa0-\xff]"), "latin1")
        .when(~one.rlike(rf"[^{text}\x80-\xff]"), "extended")
        .otherwise("unknown")
    )


def decode_bytes(body: Column) -> Column:
    """Text of raw bytes by ``charset_of_bytes``: UTF-8 and UTF-16 as such, else a character for each byte; null for unknown ones."""
    kind = charset_of_bytes(body)
    return F.when(kind.isin("ascii", "utf8"), body.cast("string")).when(kind == "utf16", F.decode(body, "UTF-16")).when(kind != "unknown", F.decode(body, "ISO-8859-1"))


def limit_size(docs: DataFrame, body: str = "text", most: int = 5_242_880, keep_all: bool = False) -> DataFrame:
    """Documents whose body has at most ``most`` bytes (null ones too); ``keep_all`` keeps the others with an empty body."""
    fits = F.coalesce(F.octet_length(body) <= most, F.lit(True))
    return docs.withColumn(body, F.when(fits, F.col(body)).otherwise("")) if keep_all else docs.where(fits)


def drop_unknown_charset(docs: DataFrame, body: str = "text", keep_all: bool = False) -> DataFrame:
    """Documents of a known character set; ``keep_all`` keeps the others with an empty body."""
    known = charset_class(F.col(body)) != "unknown"
    return docs.withColumn(body, F.when(known, F.col(body)).otherwise("")) if keep_all else docs.where(known)


def only_html(docs: DataFrame, body: str = "html", keep_all: bool = False) -> DataFrame:
    """Documents with a known tag; ``keep_all`` keeps the others with an empty body."""
    good = F.coalesce(is_html(F.col(body)), F.lit(False))
    return docs.withColumn(body, F.when(good, F.col(body)).otherwise("")) if keep_all else docs.where(good)
