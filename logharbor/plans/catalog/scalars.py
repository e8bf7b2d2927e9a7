"""Scalar and array functions over tables (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor import functions as L
from logharbor.functions import text as X
from logharbor.functions.times import render_time
from logharbor.plans.catalog.base import DOCS_SQL, QUERY_TEXT_DUCK, QUERY_TEXT_SPARK, Tables, mask_sql, query
from logharbor.plans.catalog.landing import vendor_b_line
from logharbor.plans.catalog.lookups import PATH_SQL
from logharbor.sources.landed import spread


@query("c01_mask_json", f'WITH {DOCS_SQL} SELECT event_id, "queryTemplate" AS template FROM docs')
def c01(t: Tables):
    return spread(t.events).select("event_id", L.mask_json(F.expr(QUERY_TEXT_SPARK)).alias("template"))


@query("c01_mask_props", f"SELECT event_id, {mask_sql('props')} AS template FROM events")
def c01_props(t: Tables):
    return spread(t.events).select("event_id", L.mask_json(F.col("props")).alias("template"))


@query("c02_mask_truncated")
def c02(t: Tables):
    cut = F.concat(F.lit('{"doc": '), F.col("doc_id"), F.lit(', "lang": '), F.col("lang"), F.lit(', "text": "'), F.col("text"))
    return spread(t.documents).select("doc_id", L.fingerprint(L.mask_truncated(cut, "compat")).alias("check_sum"))


# A truncated text without escapes: keys stay, whole and cut strings and bare values go.
@query(
    "c02_mask_truncated_strict",
    """SELECT event_id, concat('{"kind":"?","n":["?"],"', event_type, '":"?"') AS template FROM events""",
)
def c02_strict(t: Tables):
    cut = F.concat(
        F.lit('{"kind": "'), F.col("event_type"), F.lit('", "n": ['), F.col("value"), F.lit(", "), F.col("user_id"),
        F.lit('], "'), F.col("event_type"), F.lit('": "cut '), F.col("props"),
    )
    flat = F.replace(cut, F.lit('{"k"'), F.lit("{k"))
    return spread(t.events).select("event_id", L.mask_truncated(flat, "strict").alias("template"))


# A cut after a number: the compatible masking leaves ? for bare values and keeps quoted strings.
@query(
    "c02_mask_truncated_compat",
    """SELECT event_id, concat('{"kind": "', event_type, '", "n": [?], "o": {"v": ?, "id": ?') AS template FROM events""",
)
def c02_compat(t: Tables):
    cut = F.concat(
        F.lit('{"kind": "'), F.col("event_type"), F.lit('", "n": ['), F.col("value"), F.lit(", "), F.col("user_id"),
        F.lit('], "o": {"v": '), F.col("value"), F.lit(', "id": '), F.col("event_id"),
    )
    return spread(t.events).select("event_id", L.mask_truncated(cut, "compat").alias("template"))


@query(
    "c03_format_switch",
    f"""WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN substr({QUERY_TEXT_DUCK}, 1, length({QUERY_TEXT_DUCK}) - 9)
      WHEN 'view' THEN concat(props, ' ', user_id) WHEN 'signup' THEN concat('[', props, ',', props, ']') ELSE {QUERY_TEXT_DUCK} END AS q FROM events)
    SELECT event_id, CASE WHEN json_valid(q) THEN 'json' ELSE 'non-json' END AS dsl_format FROM x""",
)
def c03(t: Tables):
    q = F.expr(QUERY_TEXT_SPARK)
    text = (
        F.when(F.col("event_type") == "error", F.substring(q, F.lit(1), F.length(q) - 9))
        .when(F.col("event_type") == "view", F.concat_ws(" ", "props", "user_id"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]")))
        .otherwise(q)
    )
    return spread(t.events).select("event_id", L.dsl_format(L.is_json(text)).alias("dsl_format"))


@query("c04_fingerprint", "SELECT doc_id, md5(text) AS check_sum FROM documents")
def c04(t: Tables):
    return t.documents.select("doc_id", L.fingerprint(F.col("text")).alias("check_sum"))


@query(
    "c05_parse_event_time",
    "SELECT event_id, date_trunc('millisecond', ts) AS event_time FROM events WHERE event_type <> 'error'",
)
def c05(t: Tables):
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSS")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return t.events.select("event_id", L.parse_event_time(text).alias("event_time")).filter("event_time IS NOT NULL")


@query("c06_iso_millis", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time FROM events")
def c06(t: Tables):
    return t.events.select("event_id", L.iso_millis(F.col("ts")).alias("event_time"))


@query(
    "c07_epoch_round_trip",
    "SELECT event_id, epoch_us(ts) // 1000 AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown,"
    " CASE WHEN event_type = 'view' THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS rendered FROM events",
)
def c07(t: Tables):
    stamp = L.epoch_millis(F.col("ts"))
    text = F.when(F.col("event_type") == "view", F.col("props")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    )
    return t.events.select(
        "event_id", stamp.alias("stamp"), L.display_time(stamp).alias("shown"), render_time(text).alias("rendered")
    )


@query(
    "c08_lenient_numbers",
    """WITH v AS (SELECT doc_id, CASE WHEN lang = 'en' THEN cast(n_chars AS VARCHAR) ELSE text END AS v FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN cast(v AS DOUBLE) ELSE 0 END AS number,
      CASE WHEN regexp_full_match(v, '[+-]?[0-9]{1,18}') THEN cast(v AS BIGINT) WHEN regexp_full_match(v, '[+-]?[0-9]+')
        THEN cast(least(greatest(cast(v AS HUGEINT), -9223372036854775808), 9223372036854775807) AS BIGINT) ELSE 0 END AS whole FROM v""",
)
def c08(t: Tables):
    text = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise(F.col("text"))
    return t.documents.select("doc_id", L.lenient_double(text).alias("number"), L.lenient_long(text).alias("whole"))


@query(
    "c09_line_header",
    "SELECT o_orderkey, concat('node-', o_custkey) AS node, lower(o_orderpriority) AS idx, cast(1 AS BIGINT) AS shard FROM orders",
)
def c09(t: Tables):
    h = L.line_header(vendor_b_line())
    return t.orders.select(
        "o_orderkey", h["nodeName"].alias("node"), h["indexName"].alias("idx"), h["shardId"].alias("shard")
    )


@query(
    "c10_bracket_fields",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE floor(o_totalprice) END AS took,"
    " CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey END AS hits,"
    " CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'QUERY_THEN_FETCH' END AS kind,"
    " cast(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 5 END AS BIGINT) AS shards FROM orders",
)
def c10(t: Tables):
    b = L.bracket_fields(F.when(F.col("o_orderstatus") == "P", F.lit("no fields")).otherwise(vendor_b_line()))
    return t.orders.select(
        "o_orderkey", b["durationMs"].alias("took"), b["searchHits"].alias("hits"),
        b["searchType"].alias("kind"), b["shardTotal"].alias("shards"),
    )


@query(
    "c11_extract_source",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL ELSE {QUERY_TEXT_DUCK} END AS query_text FROM events""",
)
def c11(t: Tables):
    q = F.expr(QUERY_TEXT_SPARK)
    body = F.when(F.col("event_type") == "error", F.substring(q, F.lit(1), F.length(q) - 9)).otherwise(q)
    mark = F.when(F.col("event_type") == "view", F.lit("sauce[")).otherwise(F.lit("source["))
    line = F.concat(F.lit("total_shards[5], "), mark, body, F.lit("], id[}x{]"))
    return spread(t.events).select("event_id", L.extract_source(line).alias("query_text"))


@query(
    "c12_usage_percentages",
    "SELECT event_id, concat(value, ';', user_id) AS usages FROM events WHERE value >= 0",
)
def c12(t: Tables):
    dump = F.concat(
        F.col("value"), F.lit("% (500.3ms out of 500ms) cpu usage by thread 'a'\n 5% idle\n"), F.col("user_id"),
        F.lit("%   (1s out of 2m) wait usage by thread 'b'"),
    )
    usages = F.transform(L.usage_percentages(dump), lambda u: X.plain_number(u))
    # The first figure is printed as given, so it is compared as a number again.
    return t.events.select(
        "event_id", F.concat_ws(";", F.get(usages, F.lit(0)).cast("double"), F.get(usages, F.lit(1))).alias("usages")
    )


@query(
    "c13_document_id_a",
    "SELECT event_id, concat(epoch_us(ts) // 1000, '|10_0_0_', user_id, '|', event_type, '|', cast(trunc(value) AS BIGINT), '|es-', user_id)"
    " AS doc_id FROM events",
)
def c13(t: Tables):
    ident = L.doc_id_a(
        L.epoch_millis(F.col("ts")), F.format_string("10.0.0.%d", "user_id"), F.col("event_type"), F.col("value"),
        F.format_string("es-%d", "user_id"),
    )
    return t.events.select("event_id", ident.alias("doc_id"))


@query(
    "c14_document_id_b",
    "SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), '|node-', user_id, '|', event_type, '|',"
    " cast(trunc(-value) AS BIGINT), '|c1') AS doc_id FROM events",
)
def c14(t: Tables):
    ident = L.doc_id_b(
        L.iso_millis(F.col("ts")), F.format_string("node-%d", "user_id"), F.col("event_type"), -F.col("value"), F.lit("c1")
    )
    return t.events.select("event_id", ident.alias("doc_id"))


@query("c15_truncate", "SELECT c_custkey, cast(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def c15(t: Tables):
    return t.customer.select("c_custkey", L.truncate(F.col("c_acctbal")).alias("whole"))


@query("c16_round_cents", "SELECT c_custkey, round(c_acctbal / 8 * 100) / 100 AS cents FROM customer")
def c16(t: Tables):
    return t.customer.select("c_custkey", L.round_cents(F.col("c_acctbal") / 8).alias("cents"))


@query(
    "c17_durations",
    "SELECT event_id, (user_id * 24 + event_id % 24) * 3600000000000 + cast(replace(regexp_replace(props, '[^0-9]', '', 'g'), ' ', '') AS BIGINT)"
    " * 60000000000 AS nanos, event_id AS bare, CASE WHEN event_type = 'view' THEN user_id * 86400000000000 END AS odd FROM events",
)
def c17(t: Tables):
    minutes = F.regexp_replace("props", "[^0-9]", "")
    full = F.concat(F.col("user_id"), F.lit("d"), F.expr("event_id % 24"), F.lit("h"), minutes, F.lit("m"))
    odd = F.when(F.col("event_type") == "view", F.concat(F.col("user_id"), F.lit("dx"))).otherwise(F.col("event_type"))
    # "click", "error", "purchase" and "signup" are no durations, with one exception: none holds a d.
    return t.events.select(
        "event_id", L.parse_duration(full).alias("nanos"), L.parse_duration(F.col("event_id").cast("string")).alias("bare"),
        L.parse_duration(odd).alias("odd"),
    )


@query("c18_json_keys", "SELECT event_id, concat('query,ids,note,size,k', user_id) AS keys FROM events")
def c18(t: Tables):
    text = F.concat(F.expr(f"rtrim('}}', {QUERY_TEXT_SPARK})"), F.lit(', "k'), F.col("user_id"), F.lit('": {"x": 1}}'))
    return t.events.select("event_id", X.comma_joined(L.json_keys(text)).alias("keys"))


@query(
    "c19_json_map",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE json_extract_string(props, '$.k') END AS k,"
    " CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS entries FROM events",
)
def c19(t: Tables):
    m = L.json_map(F.when(F.col("event_type") != "view", F.col("props")))
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).alias("entries"))


QUERY_SQL = "regexp_extract(url, '[?]([^#]*)', 1)"


@query(
    "c20_query_string_map",
    f"""SELECT page_id, concat('{{', string_agg(concat('"', k, '":"', v, '"'), ',' ORDER BY k), '}}') AS body FROM
      (SELECT page_id, split_part(p, '=', 1) AS k, arg_max(split_part(p, '=', 2), i) AS v FROM
        (SELECT page_id, unnest(string_split(q, '&')) AS p, generate_subscripts(string_split(q, '&'), 1) AS i FROM
          (SELECT page_id, concat({QUERY_SQL}, '&page=', page_id, '&odd&a=b=c') AS q FROM pages))
       WHERE len(string_split(p, '=')) = 2 GROUP BY ALL) GROUP BY page_id""",
)
def c20(t: Tables):
    q = F.concat(F.regexp_extract("url", r"[?]([^#]*)", 1), F.lit("&page="), F.col("page_id"), F.lit("&odd&a%3Db=c"))
    return t.pages.select("page_id", L.query_string_json(q).alias("body"))


@query(
    "c21_body_guard",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN '[文件]' WHEN octet_length(encode(text)) > 1024 THEN '[超出记录长度]' ELSE text END AS body FROM documents",
)
def c21(t: Tables):
    kind = F.when(F.col("lang") == "de", F.lit("multipart/form-data; boundary=x")).otherwise(F.lit("application/json"))
    return t.documents.select("doc_id", X.guard_body(F.col("text"), kind).alias("body"))


@query(
    "c22_case_conversion",
    """WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
    c AS (SELECT *, concat(a, upper(b[1]), b[2:]) AS camel FROM w)
    SELECT p_partkey, camel AS from_snake, camel AS from_kebab, concat(a, '_', b) AS to_snake,
      concat('_', a, '_', b) AS to_column, concat(upper(camel[1]), camel[2:]) AS upper_first, camel AS lower_first FROM c""",
)
def c22(t: Tables):
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    kebab = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    camel = X.snake_to_camel(snake)
    upper = X.first_upper(camel)
    return t.part.select(
        "p_partkey", camel.alias("from_snake"), X.kebab_to_camel(kebab).alias("from_kebab"),
        X.camel_to_snake(upper).alias("to_snake"), X.camel_to_column(upper).alias("to_column"),
        upper.alias("upper_first"), X.first_lower(upper).alias("lower_first"),
    )


@query("c23_comma_joined", "SELECT conv_id, turn, array_to_string(string_split(text, ' '), ',') AS words FROM conversations")
def c23(t: Tables):
    return t.conversations.select("conv_id", "turn", X.comma_joined(F.split("text", " ")).alias("words"))


@query("c24_first_segment", f"SELECT page_id, split_part({PATH_SQL}, '/', 2) AS segment FROM pages")
def c24(t: Tables):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", X.first_segment(path).alias("segment"))


@query("c25_file_tag", "SELECT page_id, string_split(url, '.')[-1] AS tag FROM pages")
def c25(t: Tables):
    return t.pages.select("page_id", X.file_tag(F.col("url")).alias("tag"))


@query(
    "c26_host_prefix",
    f"SELECT page_id, concat('https://cdn.test', {PATH_SQL}) AS one, concat('https://cdn.test', {PATH_SQL}, ' ', url) AS many FROM pages",
)
def c26(t: Tables):
    path, host = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "https://cdn.test"
    return t.pages.select(
        "page_id", X.with_host(path, host).alias("one"),
        F.array_join(X.with_host_each(F.array(path, F.col("url")), host), " ").alias("many"),
    )


@query(
    "c27_display_formats",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '是' WHEN 'O' THEN '否' ELSE '' END AS finished,"
    " strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, concat(year(o_orderdate), '-', quarter(o_orderdate)) AS quarter FROM orders",
)
def c27(t: Tables):
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return t.orders.select(
        "o_orderkey", X.bool_label(flag).alias("finished"),
        F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("placed"),
        X.quarter_label(F.col("o_orderdate")).alias("quarter"),
    )


@query(
    "c28_encryption_round_trip",
    "SELECT c_custkey, c_name AS opened, cast(32 + 32 * (length(c_name) // 16 + 1) AS INT) AS sealed_length FROM customer",
)
def c28(t: Tables):
    key = F.lit("0123456789abcdef")
    sealed = t.customer.select("c_custkey", L.encrypt_text(F.col("c_name"), key).alias("sealed"))
    return sealed.select(
        "c_custkey", L.decrypt_text(F.col("sealed"), key).alias("opened"), F.length("sealed").alias("sealed_length")
    )


@query("c29_strip_prefix", f"SELECT page_id, {PATH_SQL} AS path FROM pages")
def c29(t: Tables):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", X.strip_prefix(F.concat(F.lit("/api"), path), "/api").alias("path"))


@query(
    "c30_column_letters",
    """WITH RECURSIVE w AS (SELECT p_partkey, cast(p_partkey + 1 AS BIGINT) AS n, '' AS letters FROM part UNION ALL
      SELECT p_partkey, (n - 1) // 26, concat(chr(cast(65 + (n - 1) % 26 AS INT)), letters) FROM w WHERE n > 0)
    SELECT p_partkey, letters FROM w WHERE n = 0""",
)
def c30(t: Tables):
    return t.part.select("p_partkey", X.column_letters(F.col("p_partkey") + 1).alias("letters"))


@query(
    "c31_content_hash_check",
    "SELECT doc_id, lang <> 'fr' AS intact FROM documents",
)
def c31(t: Tables):
    given = F.when(F.col("lang") == "fr", F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    return t.documents.select("doc_id", (F.md5("text") == given).alias("intact"))
