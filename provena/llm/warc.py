"""WARC records: reading, canonical URLs and the resolution of not-modified revisits.

A revisit (the server said 304) has no body. It is joined as of its date to the latest strictly earlier full response of the same
canonical URL; its validators must agree with that response's (entity tag, else last-modified, else payload digest). The resolved
record has the response's payload and its headers, updated by those of the 304 that may update a stored response.

The as-of join is two windows: inside a (URL, span of ``BUCKET_SECONDS``) group, and over the last response of each span of a URL.
A URL with any share of all rows is thus dealt over its spans, and nothing is paired with more than one row.

Bodies and other carried columns take no part in it: they are joined last, by the responses found, and shuffled once.

Cases: null URLs, dates or types never resolve; equal dates of a response and a revisit don't count as earlier; of several responses with one
date the greatest ``record_id`` counts, and of several with one date and id the one with the greatest carried values. A revisit without
validators is unresolved ("no validator"). Repeated rows give repeated rows. An empty table gives no rows. Bodies may have any length.
Input columns other than the named ones are only carried if asked for; one called like a column of the result gets the prefix ``own_``.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import BATCH_BYTES, map_batches, table, tune

BUCKET_SECONDS = 3600
#: Header fields of a 304 that never replace those of the stored response. They describe the message or the
#: stored body's own coding and length.
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
_TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sid|sessionid|phpsessid|jsessionid)(=|$)"
_RECORD = "record_id string, record_type string, uri string, date timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: str | Column) -> Column:
    """Without scheme, ``www.``, ``m.``, default port, fragment, tracking parameters, ``index`` page and closing slash; lower-case
    host; parameters in order."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(url, r"^(?i:https?)://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(www\d*|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(_TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lower_keys(headers: str | Column) -> Column:
    """Field names in lower case; of fields that differ in case only, the last in order of name counts."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def _tag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^W/", "")


def resolve_revisits(records: DataFrame, carry: tuple[str, ...] = ("payload",), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit: ``record_id, url, resolved, reason, response_id, status, headers`` and the ``carry`` columns of
    the response (null if unresolved). ``records`` has ``record_id, record_type, uri, date, status, headers`` and these."""
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    rows = records.select("record_id", "record_type", canonical_url("uri").alias("url"), F.col("date").alias("at"), "status", lower_keys("headers").alias("headers"), full.alias("full"))
    rows = rows.where(F.col("full") | (F.col("record_type") == "revisit")).withColumn("bucket", F.floor(F.unix_timestamp("at") / bucket_seconds))
    response = F.when(F.col("full"), F.struct("at", "record_id", "headers"))
    rows = rows.withColumn("response", response)
    # at equal dates revisits come first, so only strictly earlier responses precede them
    earlier = Window.partitionBy("url", "bucket").orderBy("at", F.col("full").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = F.last("response", ignorenulls=True).over(earlier)
    last = rows.where("full").groupBy("url", "bucket").agg(F.max_by("response", F.struct("at", "record_id")).alias("last"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("url", "bucket").agg(F.count("*").alias("n")).select("url", "bucket").join(last, ["url", "bucket"], "left")
    spans = spans.select("url", "bucket", F.last("last", ignorenulls=True).over(before).alias("before"))
    found = rows.withColumn("here", here).where(~F.col("full")).join(spans.withColumnsRenamed({"url": "u", "bucket": "k"}), (F.col("url") == F.col("u")) & (F.col("bucket") == F.col("k")), "left")
    found = found.withColumn("match", F.coalesce("here", "before"))
    h, r = F.col("headers"), F.col("match.headers")
    both = lambda name: h[name].isNotNull()
    same = (
        F.when(F.col("match").isNull(), "no response")
        .when(both("etag"), F.when(_tag(h["etag"]) == _tag(r["etag"]), "etag").otherwise("etag differs"))
        .when(both("last-modified"), F.when(h["last-modified"] == r["last-modified"], "last-modified").otherwise("last-modified differs"))
        .when(both("warc-payload-digest"), F.when(h["warc-payload-digest"] == r["warc-payload-digest"], "digest").otherwise("digest differs"))
        .otherwise("no validator")
    )
    found = found.withColumn("reason", same).withColumn("resolved", F.col("reason").isin("etag", "last-modified", "digest"))
    update = F.map_filter(h, lambda k, v: ~k.isin(*NOT_UPDATED))
    merged = F.map_concat(F.map_filter(r, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    found = found.withColumn("response_id", F.when(F.col("resolved"), F.col("match.record_id"))).withColumn("response_at", F.when(F.col("resolved"), F.col("match.at")))
    out = ["record_id", "url", "resolved", "reason", "response_id", "status", "headers"]
    found = found.select(*out[:5], F.when(F.col("resolved"), 200).otherwise(F.col("status")).alias("status"), F.when(F.col("resolved"), merged).otherwise(h).alias("headers"), "response_at")
    if not carry:
        return found.drop("response_at")
    bodies = records.where(full).select(F.col("record_id").alias("__id"), F.col("date").alias("__at"), canonical_url("uri").alias("__url"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("__own"))
    bodies = bodies.groupBy("__id", "__at", "__url").agg(F.max("__own").alias("__own"))
    found = found.join(bodies.hint("merge"), (F.col("response_id") == F.col("__id")) & (F.col("response_at") == F.col("__at")) & (F.col("url") == F.col("__url")), "left")
    return found.select(*out, *[F.col(f"__own.c{k}").alias(f"own_{c}" if c in out else c) for k, c in enumerate(carry)])


class _Bytes:
    """What a file says, member after member, with no more of it in memory than is asked for. A damaged member ends it."""

    def __init__(self, data: bytes):
        self.chunks, self.held = self._plain(data), bytearray()

    @staticmethod
    def _plain(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
        view, at = memoryview(data), 0
        if data[:2] != b"\x1f\x8b":
            for at in range(0, len(data), step):
                yield bytes(view[at : at + step])
            return
        while data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            while not member.eof and at < len(data):
                piece = member.unconsumed_tail or bytes(view[at : at + step])
                at += 0 if member.unconsumed_tail else len(piece)
                try:
                    out = member.decompress(piece, step)
                except zlib.error:
                    return
                yield out
            at -= len(member.unused_data)

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def until(self, mark: bytes) -> bytes | None:
        """All before the next mark, which is passed over; None if there is none."""
        begin = 0
        while (found := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, size: int) -> bytes | None:
        while len(self.held) < size:
            if not self.more():
                return None
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed or member-wise gzipped WARC file. A truncated last record is left out, as is all behind a
    damaged gzip member, and a record whose length is no number."""
    source = _Bytes(data)
    while source.until(b"WARC/") is not None:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        fields = _fields(head)
        size = fields.get("content-length", "0")
        if not re.fullmatch("[0-9]{1,18}", size):
            continue
        body = source.take(int(size))
        if body is None:
            return
        status, headers, payload = None, {}, body
        if "application/http" in fields.get("content-type", ""):
            block, _, payload = body.partition(b"\r\n\r\n")
            first = block.split(b"\r\n", 1)[0].split()
            status = int(first[1]) if len(first) > 1 and re.fullmatch(rb"[0-9]{3}", first[1]) else None
            headers = _fields(block)
        if "warc-payload-digest" in fields:
            headers["warc-payload-digest"] = fields["warc-payload-digest"]
        yield {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "status": status, "headers": headers, "payload": payload}


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files under ``path``. A file is read by one task, as its records must be found in order: it stands in memory as
    it is stored (2 GB at most, as Spark reads whole files), and unpacked record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "uri", "date", "status", "headers", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                held: list[dict] = []
                size = 0
                for record in parse_warc(data.as_buffer().to_pybytes()):
                    held.append({**record, "headers": list(record["headers"].items())})
                    size += len(record["payload"])
                    if len(held) == 500 or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    files = tune(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return map_batches(files, run, _RECORD.replace("date timestamp", "date string")).withColumn("date", F.try_to_timestamp("date"))


def crawl(pages: DataFrame) -> DataFrame:
    """A capture log made from pages, in which a join by URL or by page alone would go wrong. Of page p, with k = p mod 8:

    * 8p: its body as a full response at second p; 8p + 1, for odd k: a longer body, another tag, at p + 50; 8p + 2, for k = 2 and 3: an
      answer 301 or 500 at p + 60, with the first one's tag;
    * 8p + 3: a revisit at p + 100 (k = 7: at p - 10, before any response) with the first one's weak tag (k = 0, 1, 7), its date of
      change (k = 2), the second one's tag (k = 3), nothing (k = 4), another date (k = 5) or its digest (k = 6);
    * 8p + 4, at second p, on one of three addresses that all pages share, so each has a third of such rows: for every third page a
      response whose tag changes every 30 pages, else a revisit that asks for that tag; every sixth says it twice in other spellings."""
    page, k = F.col("page_id"), F.pmod("page_id", F.lit(8))
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    longer = F.concat("html", F.lit("<p>more</p>"))
    text = lambda x: x.cast("string")
    tag = lambda body: F.concat(F.lit('"'), F.md5(body.cast("binary")), F.lit('"'))
    digest = lambda body: F.concat(F.lit("md5:"), F.md5(body.cast("binary")))
    day = F.concat(F.lit("day "), text(page))

    def record(j: int, kind: Column | str, uri: Column, at: Column, status: Column | int, headers: dict[str, Column], body: Column | None = None, where: Column | None = None) -> DataFrame:
        named = F.map_filter(F.create_map(*[x for name, value in headers.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
        none = F.lit(None).cast("string")
        some = pages if where is None else pages.where(where)
        kind, status = F.lit(kind) if isinstance(kind, str) else kind, F.lit(status) if isinstance(status, int) else status
        return some.select((page * 8 + j).alias("record_id"), kind.alias("record_type"), uri.alias("uri"), F.timestamp_seconds(F.lit(1_700_000_000) + at).alias("date"), status.alias("status"), named.alias("headers"), (none if body is None else F.md5(body.cast("binary"))).alias("body_md5"), (none.cast("long") if body is None else F.octet_length(body).cast("long")).alias("body_bytes"))

    def full(body: Column) -> dict[str, Column]:
        return {"Date": day, "ETag": tag(body), "Last-Modified": F.concat(F.lit("changed "), text(page)), "WARC-Payload-Digest": digest(body), "Content-Type": F.lit("text/html"), "Content-Length": text(F.octet_length(body))}

    html, url = F.col("html"), F.col("url")
    weak = F.when(k.isin(0, 1, 7), F.concat(F.lit("W/"), tag(html))).when(k == 3, tag(longer))
    changed = F.when(k == 2, F.concat(F.lit("changed "), text(page))).when(k == 5, F.lit("changed lately"))
    asked = {"date": F.concat(F.lit("later "), text(page)), "etag": weak, "last-modified": changed, "warc-payload-digest": F.when(k == 6, digest(html)), "Content-Length": F.lit("0"), "X-Cache": F.lit("HIT")}
    shared = F.concat(F.when(page % 6 == 0, F.lit("https://www.feed.example:443/")).otherwise(F.lit("http://feed.example/")), text(F.pmod(page, F.lit(9)) % 3), F.when(page % 6 == 1, F.lit("/?utm_source=x#top")).otherwise(F.lit("")))
    now = F.concat(F.lit('"'), text(F.floor(page / 30)), F.lit('"'))
    is_full = F.pmod(F.floor(page / 9), F.lit(3)) == 0
    logs = [
        record(0, "response", url, page, 200, full(html), html),
        record(1, "response", url, page + 50, 200, full(longer), longer, k % 2 == 1),
        record(2, "response", url, page + 60, F.when(k == 2, 301).otherwise(500), {"ETag": tag(html)}, where=k.isin(2, 3)),
        record(3, "revisit", url, F.when(k == 7, page - 10).otherwise(page + 100), 304, asked),
        record(4, F.when(is_full, F.lit("response")).otherwise(F.lit("revisit")), shared, page, F.when(is_full, 200).otherwise(304), {"ETag": now, "Date": day}),
    ]
    return functools.reduce(DataFrame.unionByName, logs)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl(table(spark, sf_dir, "pages")), carry=("body_md5", "body_bytes"))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    return out.select("record_id", "url", "resolved", "reason", "response_id", F.col("status").cast("int").alias("status"), merged.alias("headers"), "body_md5", "body_bytes")


#: The same log and its as-of resolution in DuckDB, by one window over each canonical URL.
OP8_SQL = r"""
with p as (select page_id, url, coalesce(html, '') as html, coalesce(html, '') || '<p>more</p>' as longer, page_id % 8 as k from pages),
a as (
  select page_id * 8 as id, 'response' as kind, url as uri, page_id as t, 200 as status, {'date': 'day ' || page_id, 'etag': '"' || md5(html) || '"', 'lm': 'changed ' || page_id, 'dg': 'md5:' || md5(html), 'ct': 'text/html', 'cl': strlen(html)::varchar, 'xc': null::varchar} as h, md5(html) as body_md5, strlen(html) as body_bytes from p
  union all select page_id * 8 + 1, 'response', url, page_id + 50, 200, {'date': 'day ' || page_id, 'etag': '"' || md5(longer) || '"', 'lm': 'changed ' || page_id, 'dg': 'md5:' || md5(longer), 'ct': 'text/html', 'cl': strlen(longer)::varchar, 'xc': null}, md5(longer), strlen(longer) from p where k % 2 = 1
  union all select page_id * 8 + 2, 'response', url, page_id + 60, case when k = 2 then 301 else 500 end, {'date': null, 'etag': '"' || md5(html) || '"', 'lm': null, 'dg': null, 'ct': null, 'cl': null, 'xc': null}, null, null from p where k in (2, 3)
  union all select page_id * 8 + 3, 'revisit', url, case when k = 7 then page_id - 10 else page_id + 100 end, 304, {'date': 'later ' || page_id, 'etag': case when k in (0, 1, 7) then 'W/"' || md5(html) || '"' when k = 3 then '"' || md5(longer) || '"' end, 'lm': case when k = 2 then 'changed ' || page_id when k = 5 then 'changed lately' end, 'dg': case when k = 6 then 'md5:' || md5(html) end, 'ct': null, 'cl': '0', 'xc': 'HIT'}, null, null from p
  union all select page_id * 8 + 4, case when page_id // 9 % 3 = 0 then 'response' else 'revisit' end, case when page_id % 6 = 0 then 'https://www.feed.example:443/' else 'http://feed.example/' end || (page_id % 9 % 3) || case when page_id % 6 = 1 then '/?utm_source=x#top' else '' end, page_id, case when page_id // 9 % 3 = 0 then 200 else 304 end, {'date': 'day ' || page_id, 'etag': '"' || (page_id // 30) || '"', 'lm': null, 'dg': null, 'ct': null, 'cl': null, 'xc': null}, null, null from p),
q as (select *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[hH][tT][tT][pP][sS]?://', '') as rest from a),
s as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(www[0-9]*|m)\.', ''), ':(80|443)$', '') as host,
  regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') as params from q),
c as (select id, kind, t, status, h, body_md5, body_bytes, host || path || case when params <> '' then '?' || params else '' end as url from s),
f as (select url, t, arg_max({'id': id, 'h': h, 'm': body_md5, 'b': body_bytes}, id) as r from c where kind = 'response' and status = 200 group by url, t),
m as (select c.id, c.url, c.status, c.h, f.r from c asof left join f on c.url = f.url and c.t > f.t where c.kind = 'revisit'),
v as (select *, case when r is null then 'no response' when h.etag is not null then case when regexp_replace(h.etag, '^W/', '') = r.h.etag then 'etag' else 'etag differs' end
  when h.lm is not null then case when h.lm = r.h.lm then 'last-modified' else 'last-modified differs' end when h.dg is not null then case when h.dg = r.h.dg then 'digest' else 'digest differs' end else 'no validator' end as reason from m),
w as (select *, reason in ('etag', 'last-modified', 'digest') as ok from v)
select id as record_id, url, ok as resolved, reason, case when ok then r.id end as response_id, case when ok then 200 else status end::int as status,
  concat_ws(';', 'content-length:' || case when ok then r.h.cl else h.cl end, 'content-type:' || case when ok then r.h.ct else h.ct end, 'date:' || coalesce(h.date, case when ok then r.h.date end), 'etag:' || coalesce(h.etag, case when ok then r.h.etag end), 'last-modified:' || coalesce(h.lm, case when ok then r.h.lm end), 'warc-payload-digest:' || coalesce(h.dg, case when ok then r.h.dg end), 'x-cache:' || h.xc) as headers,
  case when ok then r.m end as body_md5, case when ok then r.b end::bigint as body_bytes
from w
"""
