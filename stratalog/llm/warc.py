"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

read() takes response records from WARC files, with their headers as they stand. Both derived records refer to the response's
record id and carry its target URI, date, declared content type and payload digest; their own ids, block digests and
lengths follow from the content, so the same input always gives the same records. The text comes from the payload by fixed
rewriting steps in built-in functions (markup and scripts go, block elements become line breaks, character references are
resolved, each once, white space is folded); no shuffle, one pass. Each step takes time in proportion to the text, whatever
it holds: a comment, script, style or tag that isn't closed ends with the text, as in HTML, so no pattern looks twice.

Null payloads and URIs count as empty; they give records with an empty block. Payloads of any length are converted whole (a
row must fit Spark's 2 GB). Repeated responses give the records again (with the same ids). Other input columns aren't read."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import table

_WS = "[ \\t\\r\\n\\f]"
_BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|title|header|footer|nav|aside|main|blockquote|pre|form|head|body|html"
_REST = "(?:[ \\t\\r\\n\\f/][^>]*)?"


def _element(name: str, inside: str) -> str:
    """The element with its content, up to its end or that of the text."""
    return f"<{name}{_REST}(?:>{inside}(?:</{name}{_WS}*>|\\z)|\\z)"


#: (pattern, replacement), understood alike by Java and RE2.
REWRITES = (
    (f"(?is)<!--.*?(?:-->|\\z)|{_element('script', '.*?')}|{_element('style', '.*?')}", " "),
    (f"(?i)</?(?:{_BLOCKS}){_REST}(?:>|\\z)", "\n"),
    ("<[!?/a-zA-Z][^>]*(?:>|\\z)", ""),
)
#: Named character references.
NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
FOLDS = (("[ \\t\\r\\f]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+|[ \\n]+$", ""))
TITLE = f"(?is){_element('title', '(.*?)')}"
#: The first html tag, and the language in it; the character set that a page declares.
LANGUAGE = ("(?is)<html([ \\t\\r\\n\\f][^>]*)", "(?i)[ \\t\\r\\n\\f]lang=[\"']?([A-Za-z-]+)")
CHARSET = "(?i)<meta[ \\t\\r\\n\\f]+charset=[\"']?([A-Za-z0-9_-]+)"


def _character(code: Column) -> Column:
    """The character of a number; U+FFFD where there is none."""
    bad = (code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")


def resolved(text: Column) -> Column:
    """Each character reference replaced once, from left to right. The text and each name are worked out once: expressions
    that stand in a plan several times may be computed as often."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    cut = F.transform(F.split(text, "&", -1), lambda part, i: F.struct(part.alias("part"), F.when(i > 0, F.regexp_extract(part, REFERENCE, 1)).alias("name")))

    def one(x: Column) -> Column:
        part, name = x["part"], x["name"]
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        by = F.when(F.substring(name, 1, 1) == "#", _character(digits.cast("bigint"))).otherwise(F.try_element_at(names, name))
        swapped = F.coalesce(F.concat(by, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))
        return F.when(name.isNull(), part).when(name == "", F.concat(F.lit("&"), part)).otherwise(swapped)

    return F.array_join(F.transform(cut, one), "")


def plain_text(html: Column) -> Column:
    for pattern, by in REWRITES:
        html = F.regexp_replace(html, pattern, by)
    html = resolved(html)
    for pattern, by in FOLDS:
        html = F.regexp_replace(html, pattern, by)
    return html


def _title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), f"{_WS}+", " "))


def _language(html: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(html, LANGUAGE[0], 1), LANGUAGE[1], 1)


def urn(*parts: Column) -> Column:
    """A record id from the parts: the first 128 bits of their SHA-256 in the form of a UUID."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, content_type, payload): warc_type, record_id, refers_to,
    target_uri, warc_date, source_content_type, payload_digest, content_type, block, block_digest, content_length."""
    base = responses.select(
        F.col("record_id").alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), "warc_date",
        F.col("content_type").alias("source_content_type"), F.coalesce("payload", F.lit("")).alias("payload"),
    ).withColumn("payload_digest", _digest(F.col("payload")))
    payload = F.col("payload")
    fields = F.concat(
        F.lit("title: "), _title(payload), F.lit("\r\nlanguage: "), _language(payload), F.lit("\r\nsource-length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n"),
    )
    made = lambda kind, mime, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(made("metadata", "application/warc-fields", fields), made("conversion", "text/plain", plain_text(payload)))
    two = base.select("refers_to", "target_uri", "warc_date", "source_content_type", "payload_digest", F.explode(both).alias("made"))
    return two.select(
        "made.warc_type", urn(F.col("made.warc_type"), F.col("refers_to"), F.col("payload_digest")).alias("record_id"), "refers_to", "target_uri", "warc_date",
        "source_content_type", "payload_digest", "made.content_type", "made.block", _digest(F.col("made.block")).alias("block_digest"),
        F.octet_length("made.block").cast("long").alias("content_length"),
    )


def record(df: DataFrame) -> DataFrame:
    """derive()'s rows with `warc`, the record as it stands in a WARC 1.1 file."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.coalesce("warc_date", F.lit(""))), line("WARC-Source-Content-Type", F.coalesce("source_content_type", F.lit(""))),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return df.withColumn("warc", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def parse(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Response records (record_id, target_uri, warc_date, content_type, payload, complete) of binary records: WARC header lines,
    an HTTP response as block. complete tells whether the block is as long as the header says. Names of headers in any case."""
    cut = lambda x, after: F.expr(f"substring({x}, {after})")
    head = lambda name, of: F.trim(F.regexp_extract(F.col(of), f"(?im)^{name}:([^\\r\\n]*)", 1))
    at = F.locate("\r\n\r\n", F.col("latin"))
    df = records.select(F.col(raw).alias("raw"), F.decode(F.col(raw), "ISO-8859-1").alias("latin")).withColumn("at", at).where("at > 0")
    df = df.select("raw", "latin", "at", F.decode(cut("raw", "1, at - 1"), "UTF-8").alias("warc"))
    df = df.where(F.lower(head("WARC-Type", "warc")) == "response").withColumn("size", head("Content-Length", "warc").cast("long"))
    df = df.withColumn("inner", F.expr(r"locate('\r\n\r\n', latin, at + 4)")).withColumn("end", F.least(F.col("at") + 4 + F.col("size"), F.length("latin") + 1))
    inside = (F.col("inner") > 0) & (F.col("inner") < F.col("end"))
    df = df.withColumn("http", F.when(inside, cut("latin", "at + 4, inner - at - 4")).otherwise("")).withColumn("from", F.when(inside, F.col("inner") + 4).otherwise(F.col("at") + 4))
    return df.select(
        head("WARC-Record-ID", "warc").alias("record_id"), head("WARC-Target-URI", "warc").alias("target_uri"), head("WARC-Date", "warc").alias("warc_date"),
        head("Content-Type", "http").alias("content_type"), F.decode(cut("raw", "int(from), int(end - from)"), "UTF-8").alias("payload"),
        (F.length("latin") >= F.col("at") + 3 + F.col("size")).alias("complete"),
    )


def read(spark: SparkSession, path: str, version: str = "WARC/1.1") -> DataFrame:
    """Response records of WARC files (plain, or with each record a gzip member), cut at the version line that begins a record
    by Spark's own text source, which splits plain files between tasks. A block that holds such a line with a line break is
    cut there and has complete = false; so has the last record of a file that is cut off."""
    # Java's text reader gives the bytes as they are; payloads that aren't UTF-8 have U+FFFD where they can't be read
    lines = spark.read.option("lineSep", f"{version}\r\n").text(path)
    return parse(lines.where("length(value) > 0").select(F.col("value").cast("binary").alias("raw")))


#: The pages come without capture times; this stands for them.
DATE = "2024-01-01T00:00:00Z"


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html); the content type has the character set that the page declares."""
    charset = F.regexp_extract(F.coalesce("html", F.lit("")), CHARSET, 1)
    return pages.select(
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"), F.when(charset == "", "text/html").otherwise(F.concat(F.lit("text/html; charset="), charset)).alias("content_type"), F.col("html").alias("payload"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every row of pages, with their text in a WARC file."""
    return record(derive(responses(table(spark, sf_dir, "pages"))))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    e = lambda s: "e" + q(s.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r"))
    uuid = lambda x: f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"
    text = "payload"
    for pattern, by in REWRITES:
        text = f"regexp_replace({text}, {q(pattern)}, {e(by)}, 'g')"
    folded = "stripped"
    for pattern, by in FOLDS:
        folded = f"regexp_replace({folded}, {q(pattern)}, {e(by)}, 'g')"
    names = "map {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in NAMES.items()) + "}"
    code = "case when lower(name[2]) = 'x' then cast('0x' || name[3:] as bigint) else cast(name[2:] as bigint) end"
    known = f"case when name[1] = '#' then chr(cast(case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then {code} else 65533 end as integer)) else {names}[name] end"
    title = f"trim(regexp_replace(regexp_extract(payload, {q(TITLE)}, 1), {q(_WS + '+')}, ' ', 'g'))"
    language = f"regexp_extract(regexp_extract(payload, {q(LANGUAGE[0])}, 1), {q(LANGUAGE[1])}, 1)"
    length, line = "octet_length(encode({}))", e("\r\n")
    fields = f"'title: ' || {title} || {line} || 'language: ' || {language} || {line} || 'source-length: ' || {length.format('payload')} || {line}"
    heads = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Source-Content-Type", "source_content_type"),
             ("WARC-Source-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    warc = f"'WARC/1.1' || {line} || " + " || ".join(f"'{n}: ' || {c} || {line}" for n, c in heads) + f" || {line} || block || {line} || {line}"
    return f"""with r as (select sha256('response|' || coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')) as h, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages),
b as (select {uuid("h")} as refers_to, target_uri, payload, 'sha256:' || sha256(payload) as payload_digest,
  case when regexp_extract(payload, {q(CHARSET)}, 1) = '' then 'text/html' else 'text/html; charset=' || regexp_extract(payload, {q(CHARSET)}, 1) end as source_content_type from r),
c as (select *, {text} as marked from b),
p as (select refers_to, any_value(marked) as marked, unnest(string_split(any_value(marked), '&')) as part, generate_subscripts(string_split(any_value(marked), '&'), 1) as pos from c group by refers_to),
n as (select refers_to, pos, part, regexp_extract(part, {q(REFERENCE)}, 1) as name from p),
k as (select refers_to, pos, part, name, case when pos > 1 and name <> '' then {known} end as swap from n),
s as (select refers_to, string_agg(case when pos = 1 then part when swap is null then '&' || part else swap || part[length(name) + 2:] end, '' order by pos) as stripped from k group by refers_to),
m as (
  select 'metadata' as warc_type, refers_to, target_uri, source_content_type, payload_digest, 'application/warc-fields' as content_type, {fields} as block from b
  union all
  select 'conversion', b.refers_to, target_uri, source_content_type, payload_digest, 'text/plain', {folded} from b join s on b.refers_to = s.refers_to),
i as (select *, sha256(warc_type || '|' || refers_to || '|' || payload_digest) as h from m),
d as (select warc_type, {uuid("h")} as record_id, refers_to, target_uri, '{DATE}' as warc_date, source_content_type, payload_digest, content_type, block,
  'sha256:' || sha256(block) as block_digest, cast({length.format("block")} as bigint) as content_length from i)
select *, {warc} as warc from d"""


ORACLE = _oracle()
