"""Golden cases of the column functions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logharbor import functions as L
from logharbor.functions import text as X
from logharbor.functions.masking import mask_cut_text
from logharbor.functions.parsing import lenient_long


def run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


H = 3_600_000_000_000

MASK = {
    '{"ids":[1, 2,"a"],"e":[],"n":[[1,2],[{"k":true}],3]}': '{"ids":["?"],"e":[],"n":[["?"],[{"k":"?"}],"?"]}',
    '"abc"': '"?"',
    ' { "a" : -1.5e-7 , "b\\"c:1" : null } ': '{"a":"?","b\\"c:1":"?"}',
    '{"a,b":"x,y","t":"\\"q\\": 1"}': '{"a,b":"?","t":"?"}',
    '{"<k>&":1}': '{"\\u003ck\\u003e\\u0026":"?"}',
    '{"\\u0041\\/":{"x":[]}}': '{"A/":{"x":[]}}',
    "[]": "[]",
    "{}": "{}",
    "[true,false,null]": '["?"]',
    '{"a":1,"a":[{}]}': '{"a":"?","a":[{}]}',
}


def test_mask_json(spark):
    assert run(spark, list(MASK), L.mask_json) == list(MASK.values())


def test_mask_is_idempotent(spark):
    once = list(MASK.values())
    assert run(spark, once, L.mask_json) == once


VALID = ['{"a":1}', '"abc"', "[]", '{"a":1,"a":2}', " 1 ", "null", "-0.5e3"]
INVALID = [
    '{"a":1', '{"a":1} x', "{'a':1}", "1][2", '{"a":1},{"b":2}', "", "01", "NaN", "[1,]", "{a:1}", None,
    '"tab\there"', '1,"~end~"', "1,2",
]


def test_is_json(spark):
    assert run(spark, VALID, L.is_json) == [True] * len(VALID)
    assert run(spark, INVALID, L.is_json) == [False] * len(INVALID)


CUT = {
    '{"a":1,"b":"x': ('{"a":?,"b":"x', '{"a":"?","b":"?"'),
    '{"ids":[1,2],"q":tr': ('{"ids":[?],"q":?', '{"ids":["?"],"q":"?"'),
    '{"a": [{"b": 7, "c": [1': ('{"a": [{"b": ?, "c": [?]', '{"a":[{"b":"?","c":["?"'),
    '{"t":"12:30","n":5': ('{"t":"12:30","n":?', '{"t":"?","n":"?"'),
    '{"q":"a\\"b: c","n":[[1],2': ('{"q":"a\\"? c","n":[?]', '{"q":"?","n":[["?"],"?"'),
    "plain words": ("plain words", '"?""?"'),
}


def test_mask_truncated(spark):
    assert run(spark, list(CUT), lambda c: L.mask_truncated(c, "compat")) == [v[0] for v in CUT.values()]
    strict = run(spark, list(CUT), lambda c: L.mask_truncated(c, "strict"))
    assert [s.replace('"?""?"', '"?"') for s in strict] == [
        v[1].replace('"?""?"', '"?"') for v in CUT.values()
    ]


def test_mask_dsl_switch(spark):
    texts = ['{"a":1}', '{"a":1', None]
    assert run(spark, texts, L.mask_dsl) == ['{"a":"?"}', '{"a":"?"', None]
    assert run(spark, texts, lambda c: L.mask_dsl(c, "compat")) == ['{"a":"?"}', '{"a":?', None]
    assert run(spark, texts[:2], lambda c: L.dsl_format(L.is_json(c))) == ["json", "non-json"]


scalars = st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=6))
documents = st.recursive(
    scalars,
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(max_size=5), inner, max_size=4)),
    max_leaves=12,
)


def masked(value):
    """Plain statement of the masking rule on a parsed value."""
    if isinstance(value, dict):
        return {k: masked(v) for k, v in value.items()}
    if isinstance(value, list):
        if value and not any(isinstance(v, (dict, list)) for v in value):
            return ["?"]
        return [masked(v) for v in value]
    return "?"


@settings(max_examples=3, deadline=None)
@given(st.lists(documents, min_size=60, max_size=60))
def test_mask_property(spark, docs):
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, d in enumerate(docs)]
    assert all(run(spark, texts, L.is_json))
    got = run(spark, texts, L.mask_json)
    assert [json.loads(g) for g in got] == [masked(d) for d in docs]
    assert run(spark, got, L.mask_json) == got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab1":,{}[] \n\\', max_size=30))
def test_cut_masking_keeps_structure(text):
    out = mask_cut_text(text)
    assert out.count("{") <= text.count("{")
    if ":" not in text:
        assert out == text


def test_parse_event_time(spark):
    good = "2025-08-01T10:20:30,123"
    assert run(spark, [good, "2025-13-01T10:20:30,123", "x", None], lambda c: L.iso_millis(L.parse_event_time(c))) == [
        "2025-08-01T10:20:30.123Z", None, None, None,
    ]
    assert run(spark, [good], lambda c: L.epoch_millis(L.parse_event_time(c))) == [1754043630123]
    assert run(spark, [1754043630123], L.display_time, "bigint") == ["2025-08-01 10:20:30"]
    assert run(spark, ["2025-08-01T10:20:30+08:00", "soon"], L.render_time) == ["2025-08-01 10:20:30", "soon"]


def test_epoch_millis_before_epoch(spark):
    assert run(spark, ["1969-12-31T23:59:59,999"], lambda c: L.epoch_millis(L.parse_event_time(c))) == [-1]


def test_durations(spark):
    cases = {
        "5h20m": 5 * H + H // 3,
        "1d5h20m": 29 * H + H // 3,
        "1d": 24 * H,
        "42": 42,
        "1.5h": H + H // 2,
        "-2m": -2 * H // 60,
        "2dxx": 48 * H,
        "xd1h": H,
        "1h1h": 2 * H,
        "100ms": 100_000_000,
        "5µs": 5000,
        "0": 0,
        "oops": None,
        "": None,
    }
    assert run(spark, list(cases), L.parse_duration) == list(cases.values())


def test_lenient_numbers(spark):
    assert run(spark, ["12.5", "x", "", None, "1d", " 1", "1e3", ".5", "-7"], L.lenient_double) == [
        12.5, 0, 0, 0, 0, 0, 1000, 0.5, -7,
    ]
    assert run(spark, ["12", "1.5", None, "99999999999999999999", "-99999999999999999999"], lenient_long) == [
        12, 0, 0, 2**63 - 1, -(2**63),
    ]


LINE = (
    "[2025-08-01T10:20:30,123] [node-1 ] [logs-a][3] took_millis[812], total_hits[57 hits],"
    ' search_type[QUERY_THEN_FETCH], total_shards[5], source[{"q":{"t":"x}], y]"},"size":10}], id[abc]'
)


def test_slow_line(spark):
    df = spark.createDataFrame([(LINE,), ("nothing here",)], "x string")
    cols = {**L.line_header(F.col("x")), **L.bracket_fields(F.col("x"))}
    rows = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    assert tuple(rows[0]) == ("node-1", "logs-a", 3, 812.0, 57, "QUERY_THEN_FETCH", 5)
    assert tuple(rows[1]) == ("", "", 0, 0.0, 0, "", 0)


def test_extract_source(spark):
    cases = {
        LINE: '{"q":{"t":"x}], y]"},"size":10}',
        "no marker {}": None,
        "source[12]": None,
        "source[ {\"a\":{}} tail": '{"a":{}}',
        'source[{"a":1': None,
        "source[{'a':1}]": None,
        "source[null]": "null",
        'source[{"a":"}"}] source[{"b":1}]': '{"a":"}"}',
        None: None,
    }
    assert run(spark, list(cases), L.extract_source) == list(cases.values())


def test_extract_source_long_body(spark):
    body = json.dumps({"items": [{"k": i, "t": "}{" * 3} for i in range(20000)]})
    lines = [f"head source[{body}], id[x]", f"head source[{body}], id[{{}}]"]
    assert run(spark, lines, L.extract_source) == [body, body]


def test_usage(spark):
    dump = "100.1% (500.3ms out of 500ms) cpu usage by thread\n 7% (1s out of 2m) wait usage by thread 9%"
    assert run(spark, [dump, "idle"], L.usage_percentages) == [[100.1, 7.0], []]


def test_doc_ids(spark):
    row = spark.range(1).select(
        L.doc_id_a(F.lit(1), F.lit("10.0.0.1"), F.lit("i"), F.lit(12.9), F.lit("c")).alias("a"),
        L.doc_id_b(F.lit("t"), F.lit("n"), F.lit("i"), F.lit(-12.9), F.lit("c")).alias("b"),
        L.round_cents(F.lit(-0.125)).alias("r"),
    ).first()
    assert tuple(row) == ("1|10_0_0_1|i|12|c", "t|n|i|-12|c", -0.13)


def test_json_keys(spark):
    text = '{"Name":"a","TableName":"b","TemplateID":"c","TemplateInfo":"d","Limit":0}'
    assert run(spark, [text], L.json_keys) == [["Name", "TableName", "TemplateID", "TemplateInfo", "Limit"]]


def test_maps(spark):
    assert run(spark, ['{"a":"1"}', None], L.json_map) == [{"a": "1"}, {}]
    assert run(spark, ["a=1&b=2&a=3&bad&x=y=z&c%3D5=", "b=+&a=%26", "%zz", ""], L.query_string_json) == [
        '{"a":"3","b":"2"}', '{"a":"","b":" "}', "{}", "{}",
    ]


def test_names(spark):
    assert run(spark, ["OrderItemId", "already"], X.camel_to_snake) == ["order_item_id", "already"]
    assert run(spark, ["OrderItem", "ID"], X.camel_to_column) == ["_order_item", "ID"]
    assert run(spark, ["order_item_id", "a__b", "_x"], X.snake_to_camel) == ["orderItemId", "a_b", "X"]
    assert run(spark, ["order-item-id", "one"], X.kebab_to_camel) == ["orderItemId", "one"]
    assert run(spark, ["abc", ""], X.first_upper) == ["Abc", ""]
    assert run(spark, ["a.tar.gz", "none"], X.file_tag) == ["gz", "none"]
    assert run(spark, ["/api/user", "x"], X.first_segment) == ["api", None]


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def test_column_letters(spark):
    ns = [1, 26, 27, 52, 53, 702, 703, 728, 729, 16384, 18278]
    assert run(spark, ns, X.column_letters, "int") == [letters(n) for n in ns]
    ns = [18279, 475254, 475255, 2**31, 2**63 - 1]
    assert run(spark, ns, X.column_letters, "bigint") == [letters(n) for n in ns]
    assert run(spark, [0, -3], X.column_letters, "int") == [None, None]


def test_plain_number(spark):
    assert run(spark, [1.0, 112946.26, 12345678.5, 0.0005, 0.25, None], X.plain_number, "double") == [
        "1", "112946.26", "12345678.5", "0.0005", "0.25", None,
    ]


def test_guard_body(spark):
    fn = lambda c: X.guard_body(c, F.lit("application/json"))
    assert run(spark, ["x" * 1024, "é" * 513], fn) == ["x" * 1024, X.TOO_LONG_MARK]
    assert run(spark, ["x"], lambda c: X.guard_body(c, F.lit("multipart/form-data; b"))) == [X.UPLOAD_MARK]


@pytest.mark.parametrize("size", [16, 24, 32])
def test_encryption(spark, size):
    key = F.lit("k" * size)
    sealed = lambda c: L.encrypt_text(c, key)
    assert run(spark, ["secret", "", None], lambda c: L.decrypt_text(sealed(c), key)) == ["secret", "", None]
    one, two = run(spark, ["secret", "secret"], sealed)
    assert one != two and len(one) == 64


def test_odd_numbers_abort_nothing(spark):
    from logharbor.functions.ids import truncate

    odd = [float("nan"), float("inf"), float("-inf"), 1e30, -1e30, 2.9, -2.9, None]
    big = 2**63 - 1
    assert run(spark, odd, truncate, "double") == [0, big, -big - 1, big, -big - 1, 2, -2, None]


def test_long_durations(spark):
    from logharbor.functions.times import parse_duration

    texts = ["123456789012ns", "99999999999h", "1d99999999999h", "3000000h", "9999999999999d", "1.5h", "99999999999999999999999999999999h"]
    assert run(spark, texts, parse_duration) == [123456789012, None, 86_400_000_000_000, None, None, 5_400_000_000_000, None]


def test_zero_and_text_in_stored_conditions(spark):
    from logharbor.operators.filters import Condition, search

    df = spark.createDataFrame([(-1.0, "A"), (0.0, "B"), (2.0, "AB")], "v double, s string")
    assert search(df, [Condition("k", "v", ">=")], {"k": 0}).count() == 2
    assert search(df, [Condition("k", "s", "IN")], {"k": "AB"}).count() == 1
    assert search(df, [Condition("k", "v", ">=")], {"k": ""}).count() == 3


def test_json_beyond_the_parser(spark):
    from logharbor.functions.jsontext import _reads_as_json, is_json

    deep = "[" * 1100 + "1" + "]" * 1100
    long = '{"k": "' + "x" * 20_000_000 + '"}'
    texts = [deep, deep + "]", deep[:-1], '{"a":' * 600 + "{}" + "}" * 600, long, long[:-1]]
    assert run(spark, texts, is_json) == [True, False, False, True, True, False]
    small = [
        "1", "-0.5e+3", "01", "1.", '"a\\u00e9"', '"a\\x"', '"open', "[]", "[1,]", "[1 2]", "{}", '{"a":1,}', '{"a" 1}', '{"a":[{"b":null}]}',
        "{1:2}", "nul", "true false", "", " [ true , false ] ", '{"a":}', "]", '["a":1]', '"', '["a\nb"]', "[1}", '{"a":1]',
    ]
    import json

    def plain(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    assert run(spark, small, _reads_as_json) == [plain(t) for t in small]
    assert run(spark, small, is_json) == [plain(t) for t in small]


def test_compatible_mask_is_linear():
    import time

    from logharbor.functions.masking import mask_cut_text

    began = time.time()
    assert mask_cut_text(":" + "[" * 200_000 + "{") == ":" + "[" * 200_000 + "{"
    assert mask_cut_text('{"a": [1, [2]], "b": [{"c": 1}], "d": [3') == '{"a": [?], "b": [{"c": ?}], "d": [?]'
    assert time.time() - began < 5


def test_objects_are_found_without_a_fold_where_the_next_field_has_braces(spark, monkeypatch):
    from logharbor.functions import parsing

    lines = [
        ('x source[{"a": "}], y"}], id[}x{]', '{"a": "}], y"}'), ('source[{"a": [{}]}], id[}]x', '{"a": [{}]}'), ('source[{"a": [1}], id[}x{]', None),
        ('source[ {"a": [{}]} {"b": [{}]}', '{"a": [{}]}'), ('source[{"a": 1}', '{"a": 1}'), ("source[null]", "null"), ("source[}]", None), ("source[{", None),
    ]
    df = spark.createDataFrame(lines, "line string, want string")
    assert [r for r in df.select(parsing.extract_source(F.col("line")), "want").collect() if r[0] != r[1]] == []
    monkeypatch.setattr(parsing, "_TOKENS", "(\x00)")
    got = [r[0] for r in df.select(parsing.extract_source(F.col("line"))).collect()]
    assert got[0] == lines[0][1] and got[2] is None
