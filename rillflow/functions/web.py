"""References, URLs, media types and the mapping of HTTP values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.log import CHAIN, chain, table


def fnref(text: Column) -> Column:
    """struct<runtime, namespace, id> of runtime://namespace/id; without a path the host is the id; null if it has none."""
    m = r"^(?:([a-z]+)://)?(?:([^/]+)/)?([^/:]+)$"
    part = lambda i: F.regexp_extract(text, m, i)
    return F.when(text.rlike(m), F.struct(part(1).alias("runtime"), part(2).alias("namespace"), part(3).alias("id")))


REFS = "WITH r AS (SELECT page_id, [ 'f' || page_id, 'http://f' || page_id, 'flow://space-' || page_id % 3 || '/f' || page_id, '', '://f' || page_id, 'flow://'][page_id % 6 + 1] AS ref FROM pages)"


def references(spark: SparkSession, d: str) -> DataFrame:
    """page_id, ref: a reference of each form, and some that are none."""
    i = F.col("page_id")
    f = F.concat(F.lit("f"), i.cast("string"))
    forms = [f, F.concat(F.lit("http://"), f), F.concat(F.lit("flow://space-"), (i % 3).cast("string"), F.lit("/"), f), F.lit(""), F.concat(F.lit("://"), f), F.lit("flow://")]
    return table(spark, d, "pages").select("page_id", F.element_at(F.array(*forms), (i % 6 + 1).cast("int")).alias("ref"))


@query(REFS + """, p AS (SELECT *, CASE WHEN contains(ref, '://') THEN split_part(ref, '://', 1) END AS scheme, CASE WHEN contains(ref, '://') THEN split_part(ref, '://', 2) ELSE ref END AS rest FROM r), v AS (SELECT *, rest <> '' AND coalesce(scheme, '-') <> '' AS ok FROM p)
SELECT page_id, ref, CASE WHEN ok THEN coalesce(scheme, '') END AS runtime, CASE WHEN ok THEN CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE '' END END AS namespace, CASE WHEN ok THEN CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 2) ELSE rest END END AS id FROM v""")
def fnref_parse(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("page_id", "ref", fnref(F.col("ref")).alias("f")).select("page_id", "ref", "f.*")


#: What functions resolve to, and in which order runtimes are asked.
RESOLVERS = [("native", "user", 1), ("http", "user", 2), ("http", "assistant", 2)]


@query("WITH" + CHAIN + ", r(runtime, id, p) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in RESOLVERS) + "), refs AS (SELECT DISTINCT function_ref FROM chain) SELECT function_ref, arg_min(runtime, p) AS runtime FROM refs LEFT JOIN r ON id = function_ref GROUP BY function_ref")
def resolve_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each reference once; of several runtimes that know it the first asked wins (a rule of our own)."""
    known = spark.createDataFrame(RESOLVERS, "runtime string, function_ref string, p int")
    refs = chain(spark, d).select("function_ref").distinct()
    return refs.join(F.broadcast(known), "function_ref", "left").groupBy("function_ref").agg(F.min_by("runtime", "p").alias("runtime"))


@query("WITH" + CHAIN + " SELECT DISTINCT function_ref, 'http://router/function/' || CASE WHEN function_ref = 'user' THEN '' ELSE 'ns-' || function_ref || '/' END || function_ref AS url FROM chain")
def function_url(spark: SparkSession, d: str) -> DataFrame:
    """The router's address of a function; the default namespace is left out."""
    ref = F.col("function_ref")
    namespace = F.when(ref != "user", F.concat(F.lit("ns-"), ref))
    return chain(spark, d).select("function_ref").distinct().select("function_ref", F.concat_ws("/", F.lit("http://router/function"), namespace, ref).alias("url"))


def media_parts(text: Column) -> Column:
    """struct<type, subtype, suffix, parameters> in lower case."""
    m = r"^\s*([^/;\s]+)/([^;+\s]+)(?:\+([^;\s]+))?\s*(?:;\s*(.*))?$"
    part = lambda i: F.lower(F.regexp_extract(text, m, i))
    return F.struct(part(1).alias("type"), part(2).alias("subtype"), part(3).alias("suffix"), part(4).alias("parameters"))


#: The names of the protobuf media types.
PROTOBUF = ("protobuf", "x-protobuf", "vnd.google.protobuf", "x.google.protobuf")
#: Media types that pages are given in turn.
MEDIA = ["application/json", "text/json", "Text/HTML; Charset=UTF-8", "application/vnd.flow+json", "application/protobuf", "application/octet-stream", "image/png"]
MEDIA_SQL = f"""WITH m AS (SELECT page_id, {MEDIA}[page_id % {len(MEDIA)} + 1] AS media FROM pages), parts AS (SELECT page_id, media, lower(split_part(media, '/', 1)) AS type, lower(trim(split_part(split_part(media, '/', 2), ';', 1))) AS name, lower(trim(split_part(media, ';', 2))) AS parameters FROM m),
media AS (SELECT page_id, media, type, split_part(name, '+', 1) AS subtype, split_part(name, '+', 2) AS suffix, parameters FROM parts)"""


def page_media(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, MEDIA))
    return table(spark, d, "pages").withColumn("media", F.element_at(names, (F.col("page_id") % len(MEDIA) + 1).cast("int")))


@query(MEDIA_SQL + " SELECT * FROM media")
def media_type_parse(spark: SparkSession, d: str) -> DataFrame:
    return page_media(spark, d).select("page_id", "media", media_parts(F.col("media")).alias("m")).select("page_id", "media", "m.*")


def mapper_of(media: Column) -> Column:
    """json, text, protobuf or bytes: which mapper reads and writes a media type."""
    m = media_parts(media)
    return F.when((m["subtype"] == "json") & m["type"].isin("application", "text"), "json").when(m["type"] == "text", "text").when((m["type"] == "application") & m["subtype"].isin(*PROTOBUF), "protobuf").otherwise("bytes")


MAPPER_SQL = "CASE WHEN type || '/' || subtype IN ('application/json', 'text/json') THEN 'json' WHEN type = 'text' THEN 'text' WHEN type = 'application' AND subtype LIKE '%protobuf' THEN 'protobuf' ELSE 'bytes' END"


@query(MEDIA_SQL + f" SELECT page_id, media, {MAPPER_SQL} AS mapper FROM media")
def media_mapper(spark: SparkSession, d: str) -> DataFrame:
    return page_media(spark, d).select("page_id", "media", mapper_of(F.col("media")).alias("mapper"))


def media_of(kind: Column) -> Column:
    """The media type of a value of a kind."""
    return F.when(kind.isin("bytes", "nil"), "application/octet-stream").when(kind == "string", "text/plain").otherwise("application/json")


@query("SELECT event_id, kind, CASE kind WHEN 'bytes' THEN 'application/octet-stream' WHEN 'nil' THEN 'application/octet-stream' WHEN 'string' THEN 'text/plain' ELSE 'application/json' END AS media FROM (SELECT event_id, ['bytes', 'nil', 'string', 'map', 'float64'][event_id % 5 + 1] AS kind FROM events)")
def value_media_type(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["bytes", "nil", "string", "map", "float64"])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", kind.alias("kind")).withColumn("media", media_of(F.col("kind")))


# Mappers: a body read as a value of a kind, and a value written as a body. An error is a column.


def json_kind(text: Column) -> Column:
    """The kind of a JSON text; null if it is none."""
    first = F.left(F.trim(text), F.lit(1))
    kind = F.when(first == "{", "map").when(first == "[", "list").when(first == '"', "string").when(first.isin("t", "f"), "bool").when(first == "n", "nil").otherwise("float64")
    return F.when(F.try_parse_json(text).isNotNull(), kind)


#: By mapper: (kind, error) of a body. Protobuf needs message descriptors, which no table has.
READERS = {
    "json": lambda body: (json_kind(body), F.when(json_kind(body).isNull(), "invalid JSON")),
    "text": lambda body: (F.lit("string"), F.lit(None).cast("string")),
    "protobuf": lambda body: (F.lit(None).cast("string"), F.lit("message type not found")),
    "bytes": lambda body: (F.lit("bytes"), F.lit(None).cast("string")),
}


def refused(kind: Column, what: str, *kinds: str) -> Column:
    return F.when(~kind.isin(*kinds), F.concat(F.lit("cannot format "), kind, F.lit(f" to {what}")))


#: By mapper: (body, error) of a value given as its kind and its JSON; numbers are written as JSON has them.
WRITERS = {
    "json": lambda kind, value: (F.coalesce(value, F.lit("null")), F.lit(None).cast("string")),
    "text": lambda kind, value: (plain(kind, value), refused(kind, "text", "string", "bytes", "float64", "nil")),
    "protobuf": lambda kind, value: (F.lit(None).cast("string"), F.lit("message type not found")),
    "bytes": lambda kind, value: (plain(kind, value), refused(kind, "bytes", "string", "bytes", "nil")),
}


def plain(kind: Column, value: Column) -> Column:
    """A JSON value without quotes; nothing for nil."""
    return F.when(kind == "nil", "").when(kind.isin("string", "bytes"), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def by_mapper(mapper: Column, made: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """(value, error) of the mapper that a row names; no value where there is an error."""
    pick = lambda n: F.coalesce(*[F.when(mapper == m, pair[n]) for m, pair in made.items()])
    return F.when(pick(1).isNull(), pick(0)), pick(1)


#: JSON texts that bodies are made of in turn, the last ones broken.
BODIES = ['{"id": %d}', "[1, %d]", '"a b %d"', "true", "null", "%d.5", "{bad %d", ""]
BODY_SQL = "[" + ", ".join("'" + b.replace("%d", "' || page_id || '") + "'" for b in BODIES) + f"][page_id // {len(MEDIA)} % {len(BODIES)} + 1]"


def page_body() -> Column:
    i = F.col("page_id")
    texts = F.array(*[F.format_string(b, i) if "%d" in b else F.lit(b) for b in BODIES])
    return F.element_at(texts, (F.floor(i / len(MEDIA)) % len(BODIES) + 1).cast("int"))


@query(MEDIA_SQL + f""", b AS (SELECT page_id, {BODY_SQL} AS body, {MAPPER_SQL} AS mapper FROM media)
SELECT page_id, mapper, CASE WHEN mapper = 'json' THEN CASE WHEN json_valid(body) THEN CASE json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) WHEN 'OBJECT' THEN 'map' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'nil' ELSE 'float64' END END WHEN mapper = 'text' THEN 'string' WHEN mapper = 'bytes' THEN 'bytes' END AS kind,
  CASE WHEN mapper = 'json' AND NOT json_valid(body) THEN 'invalid JSON' WHEN mapper = 'protobuf' THEN 'message type not found' END AS error FROM b""")
def body_parse(spark: SparkSession, d: str) -> DataFrame:
    """Bodies read by the mapper of their media type."""
    rows = page_media(spark, d).select("page_id", mapper_of(F.col("media")).alias("mapper"), page_body().alias("body"))
    kind, error = by_mapper(F.col("mapper"), {m: read(F.col("body")) for m, read in READERS.items()})
    return rows.select("page_id", "mapper", kind.alias("kind"), error.alias("error"))


@query(MEDIA_SQL + f""", b AS (SELECT page_id, {MAPPER_SQL} AS mapper, page_id // 7 % 5 AS k FROM media), v AS (SELECT page_id, mapper, ['string', 'bytes', 'float64', 'nil', 'map'][k + 1] AS kind, ['"a ' || page_id || '"', '"b"', page_id || '.5', 'null', '{{"id":' || page_id || '}}'][k + 1] AS value FROM b),
w AS (SELECT *, CASE WHEN mapper = 'protobuf' THEN 'message type not found' WHEN mapper = 'text' AND kind = 'map' THEN 'cannot format map to text' WHEN mapper = 'bytes' AND kind IN ('map', 'float64') THEN 'cannot format ' || kind || ' to bytes' END AS error FROM v)
SELECT page_id, mapper, kind, CASE WHEN error IS NULL THEN CASE WHEN mapper = 'json' THEN value WHEN kind = 'nil' THEN '' ELSE trim(value, '"') END END AS body, error FROM w""")
def body_format(spark: SparkSession, d: str) -> DataFrame:
    """Values of each kind written by each mapper."""
    i = F.col("page_id")
    at = lambda *v: F.element_at(F.array(*v), (F.floor(i / 7) % 5 + 1).cast("int"))
    kind = at(*map(F.lit, ["string", "bytes", "float64", "nil", "map"]))
    value = at(F.format_string('"a %d"', i), F.lit('"b"'), F.format_string("%d.5", i), F.lit("null"), F.format_string('{"id":%d}', i))
    rows = page_media(spark, d).select("page_id", mapper_of(F.col("media")).alias("mapper"), kind.alias("kind"), value.alias("value"))
    body, error = by_mapper(F.col("mapper"), {m: write(F.col("kind"), F.col("value")) for m, write in WRITERS.items()})
    return rows.select("page_id", "mapper", "kind", body.alias("body"), error.alias("error"))


def first_values(form: Column) -> Column:
    """map of the first value of each key of a=1&b=2&a=3, decoded."""
    pairs = F.filter(F.split(form, "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"))
    entries = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), 1)["v"].alias("v"))))


def as_text(m: Column) -> Column:
    """key=value of a map, by key."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&")


URL = "WITH q AS (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages)"


@query(URL + ", p AS (SELECT page_id, unnest(string_split(query, '&')) AS kv, generate_subscripts(string_split(query, '&'), 1) AS i FROM q WHERE query <> ''), f AS (SELECT page_id, split_part(kv, '=', 1) AS k, url_decode(arg_min(regexp_replace(kv, '^[^=]*=?', ''), i)) AS v FROM p GROUP BY page_id, k) SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY k) AS firsts FROM f GROUP BY page_id")
def query_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The first value of each key of a page's query."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    return table(spark, d, "pages").select("page_id", q.alias("q")).filter("q != ''").select("page_id", as_text(first_values(F.col("q"))).alias("firsts"))


@query(URL + """, f AS (SELECT page_id, concat_ws('&', nullif(query, ''), 'page=body', 'note=a%26b%20' || page_id) AS form FROM q), p AS (SELECT page_id, unnest(string_split(form, '&')) AS kv, generate_subscripts(string_split(form, '&'), 1) AS i FROM f),
k AS (SELECT page_id, split_part(kv, '=', 1) AS k, url_decode(arg_min(regexp_replace(kv, '^[^=]*=?', ''), i)) AS v FROM p GROUP BY page_id, k) SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY k) AS firsts FROM k GROUP BY page_id""")
def form_decode(spark: SparkSession, d: str) -> DataFrame:
    """A form's values with those of the address before them: of each key the first counts."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    form = F.concat_ws("&", F.when(q != "", q), F.lit("page=body"), F.concat(F.lit("note=a%26b%20"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", as_text(first_values(form)).alias("firsts"))


def formatted(values: Column) -> Column:
    """A map of values as a query: a pair for each key, encoded, in order of keys; null without a map."""
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda p: F.concat_ws("=", F.url_encode(p["key"]), F.url_encode(F.coalesce(p["value"], F.lit("")))))
    return F.array_join(pairs, "&")


@query("SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 'id=' || page_id || '&size=' || length(html) || '&title=a+%26+b%3D' || page_id % 3 END AS query FROM pages")
def query_format(spark: SparkSession, d: str) -> DataFrame:
    """Values of a page as a query: one pair for each key, in order of keys."""
    i = F.col("page_id")
    values = F.create_map(F.lit("title"), F.concat(F.lit("a & b="), (i % 3).cast("string")), F.lit("size"), F.length("html").cast("string"), F.lit("id"), i.cast("string"))
    return table(spark, d, "pages").select("page_id", F.when(i % 4 > 0, formatted(values)).alias("query"))


@query(URL + ", p AS (SELECT page_id, unnest(string_split(query, '&')) AS kv FROM q WHERE query <> '') SELECT page_id, string_agg(DISTINCT kv, '&' ORDER BY kv) AS canonical FROM p GROUP BY page_id")
def query_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The query with its pairs encoded and sorted, equal ones once."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    encode = lambda p: F.concat(F.url_encode(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1)))), F.when(F.contains(p, F.lit("=")), F.concat(F.lit("="), F.url_encode(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))))).otherwise(F.lit("")))
    return table(spark, d, "pages").select("page_id", q.alias("q")).filter("q != ''").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("q", "&"), encode))), "&").alias("canonical"))


def response(kind: Column, value: Column, headers: Column, error: Column) -> Column:
    """struct<code, content_type, headers, body>: 500 with an error as text, 204 for nothing, else 200 with the value and its headers."""
    media = F.coalesce(F.try_element_at(headers, F.lit("Content-Type")), media_of(kind))
    body, refusal = by_mapper(mapper_of(media), {m: write(kind, value) for m, write in WRITERS.items()})
    failed, nothing = F.coalesce(error, F.when(value.isNotNull(), F.concat(F.lit("Failed to format response body: "), refusal))), value.isNull()
    code = F.when(failed.isNotNull(), 500).when(nothing, 204).otherwise(200)
    return F.struct(code.alias("code"), F.when(code == 500, "text/plain").when(code == 200, media).alias("content_type"), F.when(code == 200, headers).alias("headers"), F.when(code == 500, failed).when(code == 200, body).alias("body"))


@query("""WITH r AS (SELECT page_id, page_id % 7 = 0 AS bad, page_id % 5 = 0 AS nothing, page_id % 3 = 1 AS bytes FROM pages)
SELECT page_id, CASE WHEN bad OR (bytes AND NOT nothing) THEN 500 WHEN nothing THEN 204 ELSE 200 END AS code, CASE WHEN bad OR (bytes AND NOT nothing) THEN 'text/plain' WHEN NOT nothing THEN 'application/json' END AS content_type,
  CASE WHEN NOT bad AND NOT nothing AND NOT bytes THEN 'X-Page=' || page_id END AS headers, CASE WHEN bad THEN 'failed' WHEN nothing THEN NULL WHEN bytes THEN 'Failed to format response body: cannot format map to bytes' ELSE '{"id":' || page_id || '}' END AS body FROM r""")
def http_response(spark: SparkSession, d: str) -> DataFrame:
    """Maps as responses; one whose header says bytes can't be written."""
    i = F.col("page_id")
    headers = F.when(i % 3 == 1, F.create_map(F.lit("Content-Type"), F.lit("application/octet-stream"))).otherwise(F.create_map(F.lit("X-Page"), i.cast("string")))
    made = response(F.lit("map"), F.when(i % 5 != 0, F.format_string('{"id":%d}', i)), headers, F.when(i % 7 == 0, "failed"))
    return table(spark, d, "pages").select("page_id", made.alias("r")).select("page_id", "r.code", "r.content_type", F.when(F.col("r.headers").isNotNull(), as_text(F.col("r.headers"))).alias("headers"), "r.body")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 500 WHEN page_id % 5 = 0 THEN 204 ELSE 200 END AS code FROM pages")
def http_response_status(spark: SparkSession, d: str) -> DataFrame:
    """500 with an error, 204 without output, else 200."""
    value = F.when(F.col("page_id") % 5 != 0, F.to_json(F.struct(F.col("html").alias("v"))))
    made = response(F.lit("map"), value, F.lit(None).cast("map<string,string>"), F.when(F.col("page_id") % 7 == 0, "failed"))
    return table(spark, d, "pages").select("page_id", made["code"].alias("code"))


def http_call(inputs: Column) -> Column:
    """struct<method, url, query, content_type, body, error> of the inputs (a map) of an HTTP call.

    The address is url, else default, and gets a scheme where it has none; without either it is an error."""
    given = lambda k: F.try_element_at(inputs, F.lit(k))
    to = F.when(F.map_contains_key(inputs, "url"), given("url")).otherwise(given("default"))
    url = F.when(to.startswith("http"), to).otherwise(F.concat(F.lit("http://"), to))
    media = F.coalesce(given("content-type"), given("Content-Type"), F.lit("text/plain"))
    error = F.when(to.isNull(), "target URL is required for HTTP function")
    return F.struct(F.coalesce(given("method"), F.lit("GET")).alias("method"), url.alias("url"), given("query").alias("query"), media.alias("content_type"), given("body").alias("body"), error.alias("error"))


def http_result(code: Column, body: Column) -> tuple[Column, Column]:
    """(output, error): a status of 400 or more is an error that tells the body."""
    return F.when(code < 400, body), F.when(code >= 400, F.concat(F.lit("HTTP runtime request error: "), F.coalesce(body, F.lit("<nil>"))))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'http://host/' || page_id ELSE url END AS url, CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END AS body,
  CASE WHEN page_id % 9 = 0 THEN 'target URL is required for HTTP function' END AS error, CASE WHEN 200 + page_id % 300 < 400 THEN 'page ' || page_id END AS output, CASE WHEN 200 + page_id % 300 >= 400 THEN 'HTTP runtime request error: page ' || page_id END AS call_error FROM pages""")
def http_call_request(spark: SparkSession, d: str) -> DataFrame:
    """The request of each call, and what becomes of an answer of some status."""
    i = F.col("page_id")
    text = F.concat(F.lit("page "), i.cast("string"))
    to = F.when(i % 9 == 0, F.create_map().cast("map<string,string>")).when(i % 3 == 1, F.create_map(F.lit("url"), F.concat(F.lit("host/"), i.cast("string")), F.lit("default"), F.col("url"))).otherwise(F.create_map(F.lit("default"), F.col("url")))
    more = F.when(i % 2 == 0, F.create_map(F.lit("method"), F.lit("POST"), F.lit("body"), text)).otherwise(F.create_map().cast("map<string,string>"))
    output, error = http_result(200 + i % 300, text)
    r = F.col("r")
    return table(spark, d, "pages").select("page_id", http_call(F.map_concat(to, more)).alias("r"), output.alias("output"), error.alias("call_error")).select("page_id", r["method"].alias("method"), r["url"].alias("url"), r["body"].alias("body"), r["error"].alias("error"), "output", "call_error")


@query("SELECT page_id, CASE WHEN regexp_matches(bare, '^https?://') THEN bare ELSE 'http://' || bare END AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS bare FROM pages)")
def http_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """An address without a scheme gets one."""
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", bare.alias("b")).select("page_id", F.when(F.col("b").rlike("^https?://"), F.col("b")).otherwise(F.concat(F.lit("http://"), F.col("b"))).alias("url"))


@query("SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'text/html' END, CASE WHEN page_id % 3 = 1 THEN 'application/xml' END, 'text/plain') AS content_type FROM pages")
def content_type_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The content-type input, else the header of exactly that name, else what the value's kind says."""
    i = F.col("page_id")
    given = F.when(i % 3 == 0, "text/html")
    headers = F.when(i % 3 == 1, F.create_map(F.lit("Content-Type"), F.lit("application/xml"))).otherwise(F.create_map(F.lit("content-type"), F.lit("text/css")))
    return table(spark, d, "pages").select("page_id", F.coalesce(given, F.try_element_at(headers, F.lit("Content-Type")), F.lit("text/plain")).alias("content_type"))


@query("SELECT page_id, html AS body, html AS default_input, coalesce(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, 'Accept=text/' || page_id % 3 || '&Host=' || regexp_extract(url, '^https?://([^/]*)', 1) AS headers, CASE WHEN length(html) > 0 THEN 'POST' ELSE 'GET' END AS method FROM pages")
def http_request_source(spark: SparkSession, d: str) -> DataFrame:
    """Requests as rows: the body is the default input as well; of a header's values the first counts."""
    accept = F.array(F.concat(F.lit("text/"), (F.col("page_id") % 3).cast("string")), F.lit("*/*"))
    headers = F.create_map(F.lit("Host"), F.array(F.regexp_extract("url", "^https?://([^/]*)", 1)), F.lit("Accept"), accept)
    firsts = F.transform_values(headers, lambda _, v: F.try_element_at(v, F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.col("html").alias("body"), F.col("html").alias("default_input"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"), as_text(firsts).alias("headers"), F.when(F.length("html") > 0, "POST").otherwise("GET").alias("method"))
