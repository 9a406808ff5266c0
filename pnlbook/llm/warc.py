"""WARC derivatives: linked metadata and plain-text conversion records.

``responses`` makes response records of captured pages. ``derive`` turns each
response into two records: a ``metadata`` record (warc-fields: title, language,
charset, and the source's status line, content type, length and digests) and a
``conversion`` record (the plain text). Both name the response in
``WARC-Refers-To`` and keep its target URI and date; every record has its own
id and block digest. All of it is column expressions, one pass, no shuffle.

Record ids are ``urn:uuid`` names made from a digest of what the record is
about, so a rerun writes the same ids. Text extraction drops comments, scripts
and styles, turns block tags into line ends and other tags into nothing, and
decodes character references in one pass as HTML5 does (all names, numbers, missing
semicolons); the title likewise. All lines of the source's HTTP header are kept in the
metadata record. Line ends and control characters of a url or a title never reach a header.

Edge cases: a null or empty page gives records with empty text; a null url
leaves the target URI header out; null page ids and repeated rows give records
like any other (equal captures have equal ids); an empty table gives none.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
# fixed values: elements that end a line of text
BLOCK_TAGS = ("address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|"
              "li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul")
HIDDEN = (r"(?is)<!--.*?(?:-->|\z)|<script(?:[ \t\r\n\f/][^>]*)?>.*?(?:</script[ \t\r\n\f]*>|\z)"
          r"|<style(?:[ \t\r\n\f/][^>]*)?>.*?(?:</style[ \t\r\n\f]*>|\z)")
BLOCK = rf"(?i)</?(?:{BLOCK_TAGS})(?:[ \t\r\n\f/][^>]*)?>"
TAG = r"</?[A-Za-z!?][^>]*>"
TITLE = r"(?is)<title(?:[ \t\r\n\f][^>]*)?>(.*?)</title"
LANG = r"(?i)<html[^>]*[ \t\r\n\f]lang=[\"']?([A-Za-z0-9-]+)"
CHARSET = r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_-]+)"


REFERENCE = r"\A(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
OPEN_NAMES = r"\A(?:" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True)) + ")"
# numbers 128 to 159 stand for the characters of the old Western code page
WESTERN = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]


def unescaped(text: Column) -> Column:
    """Character references decoded, each once: a reference holds no ``&``, so the text is
    cut there and every part decodes its own beginning."""
    # a map is searched from its beginning, so the names are dealt by their first letter
    lists = {c: {n: v for n, v in html5.items() if n[0] == c} for c in sorted({n[0] for n in html5})}
    lists = F.from_json(F.lit(json.dumps(lists)), "map<string,map<string,string>>")
    named = lambda n: F.try_element_at(F.try_element_at(lists, F.substring(n, 1, 1)), n)

    def number(head: Column) -> Column:
        digits = F.regexp_extract(head, r"\A#(?:[xX])?0*([0-9a-fA-F]*)", 1)
        code = F.when(head.rlike(r"\A#[xX]"), F.when(F.length(digits) > 6, 1 << 21).otherwise(F.conv(digits, 16, 10).cast("int")))
        code = code.otherwise(F.when(F.length(digits) > 7, 1 << 21).otherwise(digits.try_cast("int")))
        code = F.coalesce(code, F.lit(0))
        nothing = (code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF)
                   | (code.bitwiseAND(0xFFFE) == 0xFFFE))
        return (F.when(code.between(128, 159), F.element_at(F.array(*map(F.lit, WESTERN)), F.greatest(code - 127, F.lit(1))))
                .when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\uFFFD").when(nothing, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))

    def part(p: Column, at: Column) -> Column:
        head = F.regexp_extract(p, REFERENCE, 0)
        rest = F.substring(p, F.length(head) + 1, F.length(p))
        begin = F.regexp_extract(head, OPEN_NAMES, 0)
        name = F.coalesce(named(head), F.when(begin != "", F.concat(named(begin), F.substring(head, F.length(begin) + 1, F.length(head)))),
                          F.concat(F.lit("&"), head))
        return F.when(at == 0, p).when(p.startswith("#") & (head != ""), F.concat(number(head), rest)).otherwise(F.concat(name, rest))

    # in a lambda the text is a variable, so what made it runs once and not for each mention
    whole = lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), part), "")).otherwise(t)
    return F.transform(F.array(text), whole)[0]


def urn(*parts: Column | str) -> Column:
    """<urn:uuid:...> named by a digest of the parts."""
    d = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(col: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(col, "UTF-8"), 256))


def octets(col: Column | str) -> Column:
    return F.octet_length(F.encode(col, "UTF-8")).cast("long")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages: HTTP header, payload, digests and ids."""
    df = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    df = df.withColumn("payload_digest", digest("payload")).withColumn("payload_length", octets("payload"))
    df = df.withColumn("http_header", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                               F.col("payload_length").cast("string"), F.lit("\r\n\r\n")))
    return df.withColumn("date", F.lit(date)).withColumn(
        "record_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                         F.coalesce("target_uri", F.lit("")), "payload_digest"))


def plain_text(html: Column) -> Column:
    """The visible text of a page, a line for each block."""
    t = F.regexp_replace(html, HIDDEN, "")
    t = F.regexp_replace(t, BLOCK, "\n")
    t = F.regexp_replace(t, TAG, "")
    t = unescaped(t)
    t = F.regexp_replace(t, "[ \\t\\r\\f\\u00A0]+", " ")
    t = F.regexp_replace(t, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+\\z", "")


def one_line(col: Column) -> Column:
    """A header value: tags out, references decoded, line ends and controls to spaces."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(col, TAG, "")), "[\\x00-\\x20\\x7F\\u0085\\u00A0\\u2028\\u2029]+", " "))


def header_safe(uri: Column) -> Column:
    """A URI for a header: line ends percent-encoded, other controls out."""
    uri = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(uri, "[\\x00-\\x1F\\x7F]", "")


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record."""
    found = lambda p: F.regexp_extract("payload", p, 1)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    df = records.withColumn("text", plain_text(F.col("payload")))
    df = df.withColumn("fields", F.concat(
        line("title", one_line(found(TITLE))), line("language", F.lower(found(LANG))), line("charset", F.lower(found(CHARSET))),
        line("source-status", F.regexp_extract("http_header", "^([^\r\n]*)", 1)),
        line("source-content-type", F.regexp_extract("http_header", "(?i)\nContent-Type: *([^\r\n]*)", 1)),
        line("source-payload-length", F.col("payload_length").cast("string")),
        line("source-payload-digest", F.col("payload_digest")),
        F.array_join(F.transform(F.filter(F.split("http_header", "\r?\n"), lambda h, i: (i > 0) & (h != "")), lambda h: line("source-header", h)), "")))
    make = lambda kind, mime, block: F.struct(
        F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    df = df.withColumn("made", F.explode(F.array(
        make("metadata", "application/warc-fields", F.col("fields")), make("conversion", "text/plain; charset=utf-8", F.col("text")))))
    df = df.select("page_id", "target_uri", "date", F.col("record_id").alias("refers_to"), "payload_digest", "made.*")
    df = df.withColumn("record_id", urn("warc_type", "refers_to")).withColumn("block_digest", digest("block")).withColumn("content_length", octets("block"))
    header = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"),
                         F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Target-URI: "), header_safe(F.col("target_uri"))),
                         F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
                         F.concat(F.lit("Content-Type: "), "content_type"),
                         F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return df.withColumn("header", F.concat(header, F.lit("\r\n\r\n")))


def serialised(records: DataFrame) -> DataFrame:
    """Each record as the bytes a WARC file holds."""
    return records.select("record_id", F.encode(F.concat("header", "block", F.lit("\r\n\r\n")), "UTF-8").alias("warc"))
