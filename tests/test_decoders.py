"""Table-driven tests of the decoders."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodegrain.functions import messages
from lodegrain.operators import *
from lodegrain.operators import encode as E
from lodegrain.operators import guard
from lodegrain.operators import issues as I


def rows_of(frame):
    return frame.collect()


def run(spark, ddl, rows, decoder, boundary="object"):
    """(value, [(pointer, code)]) of each row, in order."""
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"__k int, {ddl}" if ddl else "__k int")
    done = decode(frame, decoder, boundary).frame
    out = done.orderBy("__k").select("value", F.transform("issues", lambda i: F.struct(I.pointer(i["path"]).alias("p"), i["code"].alias("c"), i["message"].alias("m"), i["meta"].alias("meta"), i["custom_message"].alias("u"))).alias("issues"))
    return [(r["value"], [(i["p"], i["c"]) for i in r["issues"]], r["issues"]) for r in out.collect()]


def run_json(spark, texts, decoder):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.try_parse_json("t").alias("j"))
    done = decode_column(frame, "j", decoder).frame.orderBy("k")
    return [(r["value"], [("/".join(["", *i["path"]]) if i["path"] else "", i["code"]) for i in r["issues"]], r["issues"]) for r in done.collect()]


ORIGIN = combine(field("port", enum_of(["NORTH", "SOUTH", "EAST"])), field("berth", string().max_length(12)))
PARCEL = combine(field("code", string().uuid()), field("contact", string().trim().to_lower_case().email()), field("weight", int_().range(1, 900)), field("origin", nested(ORIGIN)))
CODE = "0b8d9c1e-5a3f-4e2b-9c77-1f2e3d4c5b6a"


def test_nested_object(spark):
    ddl = "code string, contact string, weight int, origin struct<port:string,berth:string>"
    rows = [(CODE, " Dock.Desk@Harbour.test", 12, ("north", "b 7")), ("zz", "desk", 901, ("west", "b 8")), (None, None, None, None)]
    good, bad, none = run(spark, ddl, rows, PARCEL)
    assert good[0].contact == "dock.desk@harbour.test" and good[0].origin.port == "NORTH" and not good[1]
    assert bad[0] is None and [p for p, _ in bad[1]] == ["/code", "/contact", "/weight", "/origin/port"]
    assert none[1] == [(f"/{n}", "required") for n in ("code", "contact", "weight", "origin")]


def test_nested_object_json(spark):
    text = json.dumps({"code": CODE, "contact": "x@y.org", "weight": 44, "origin": {"port": "south", "berth": "c"}})
    good, bad, broken = run_json(spark, [text, '{"weight": 2.5, "origin": []}', "{"], PARCEL)
    assert good[0].origin.port == "SOUTH"
    assert bad[1] == [("/code", "required"), ("/contact", "required"), ("/weight", "type_mismatch"), ("/origin", "type_mismatch")]
    assert [c for _, c in broken[1]] == ["required"] * 4


STRINGS = [
    (string().min_length(3).max_length(10), ["abc"], [("ab", "too_short"), ("12345678901", "too_long")]),
    (string().fixed_length(2), ["ab", "😀"], [("abc", "invalid_length")]),
    (string().one_of("active", "inactive"), ["active"], [("deleted", "not_allowed")]),
    (string().non_blank(), ["x", " "], [("", "blank"), ("  ", "blank"), ("　", "blank"), (None, "required")]),
    (string(), ["", " "], [(None, "required")]),
    (string().pattern(r"[A-Z]{3}-\d{4}"), ["ABC-1234"], [("abc-1234", "invalid_format"), ("ABC-1234\n", "invalid_format")]),
    (string().starts_with("a").ends_with("z").includes("m"), ["amz"], [("bmz", "invalid_format"), ("am", "invalid_format"), ("az", "invalid_format")]),
    (string().email(), ["a@b.co"], [("bad", "invalid_format"), ("a" * 250 + "@b.co", "invalid_format")]),
    (string().url(), ["https://example.com/path", "http://localhost:8080"], [("ftp://example.com", "invalid_format"), ("file:///tmp/x", "invalid_format"), ("not a url", "invalid_format"), ("http://", "invalid_format"), ("HTTP://a.b", "invalid_format"), ("http://a/" + "x" * 2048, "invalid_format")]),
    (string().uri(), ["file:///tmp/x", "mailto:user@example.com"], [("://bad", "invalid_format")]),
    (string().ipv4(), ["192.168.0.1"], [("256.1.1.1", "invalid_format"), ("01.1.1.1", "invalid_format")]),
    (string().ipv6(), ["::1", "fe80::1:2", "[::1]", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4"], [("1.2.3.4", "invalid_format"), ("fe80::1::2", "invalid_format"), ("1:2:3:4:5:6:7", "invalid_format")]),
    (string().ip(), ["::1", "1.2.3.4"], [("x", "invalid_format")]),
    (string().cuid(), ["c" + "a1" * 12], [("d" + "a1" * 12, "invalid_format")]),
    (string().ulid(), ["01ARZ3NDEKTSV4RRFFQ69G5FAV"], [("01arz3ndektsv4rrffq69g5fav", "invalid_format"), ("01ARZ3NDEKTSV4RRFFQ69G5FAU", "invalid_format")]),
    (string().to_int(), ["42", "-7", "+3"], [("abc", "type_mismatch"), (" 42 ", "type_mismatch"), ("99999999999", "type_mismatch")]),
    (string().trim().to_int().range(0, 150), ["  42  ", "25"], [("  abc  ", "type_mismatch"), ("200", "out_of_range")]),
    (string().to_long(), ["9999999999"], [("not-a-number", "type_mismatch")]),
    (string().to_decimal().scale(2), ["19.99", "1e3", "5"], [("19.999", "invalid_scale"), ("abc", "type_mismatch")]),
    (string().to_bool(), "true TRUE 1 yes YES on On false FALSE 0 no NO off Off".split(), [("maybe", "type_mismatch"), ("t", "type_mismatch")]),
    (string().date().before(date(2024, 1, 2)), ["2024-01-01"], [("2024-01-02", "out_of_range"), ("2024-1-1", "invalid_format"), ("2024-02-30", "invalid_format")]),
    (string().date().after(date(2024, 1, 2)), ["2024-01-03"], [("2024-01-02", "out_of_range")]),
    (string().date().between(date(2024, 1, 2), date(2024, 1, 3)), ["2024-01-02", "2024-01-03"], [("2024-01-04", "out_of_range")]),
    (string().date_time(), ["2024-03-15T10:30:00", "2024-03-15T10:30"], [("not-a-datetime", "invalid_format"), ("2024-03-15T10:30:00+09:00", "invalid_format"), ("2024-03-15T25:00:00", "invalid_format")]),
    (string().offset_date_time(), ["2024-03-15T10:30:00+09:00", "2024-03-15T10:30:00Z"], [("2024-03-15T10:30:00", "invalid_format")]),
    (string().iso8601(), ["2024-03-15T10:30:00Z"], [("2024-03-15", "invalid_format"), ("2024-03-15T10:30:00", "invalid_format")]),
    (string().time(), ["10:30", "10:30:15.5"], [("24:00", "invalid_format"), ("x", "invalid_format")]),
    (literal("a"), ["a"], [("A", "invalid_format")]),
    (enum_of(["Red", "BLUE"]), ["red", "blue", "RED"], [("green", "invalid_format")]),
]


@pytest.mark.parametrize("decoder, good, bad", STRINGS)
def test_strings(spark, decoder, good, bad):
    out = run(spark, "v string", [(g,) for g in good] + [(b,) for b, _ in bad], field("v", decoder))
    assert [o[1] for o in out[: len(good)]] == [[]] * len(good)
    assert [o[1] for o in out[len(good) :]] == [[("/v", c)] for _, c in bad]


NUMBERS = [
    ("int", int_().positive().multiple_of(3), [9], [(-3, "out_of_range"), (5, "not_multiple_of")]),
    ("int", int_().one_of(1, 2, 3), [2], [(5, "not_allowed")]),
    ("bigint", long_().range(100, 1000), [500], [(50, "out_of_range"), (2000, "out_of_range")]),
    ("bigint", int_(), [5], [(1 << 40, "type_mismatch")]),
    ("double", int_(), [5.0], [(5.5, "type_mismatch"), (float("nan"), "type_mismatch")]),
    ("double", double_().positive().max(100.0), [50.5], [(-1.0, "out_of_range"), (200.0, "out_of_range")]),
    ("double", double_().negative(), [-1.5, -0.0], [(0.0, "out_of_range"), (1.0, "out_of_range")]),
    ("float", float_().non_negative(), [0.0], [(-0.1, "out_of_range"), (-0.0, "out_of_range")]),
    ("decimal(10,3)", decimal_().scale(3), [Decimal("1.23")], [(None, "required")]),
    ("boolean", bool_().is_true(), [True], [(False, "invalid_value")]),
    ("string", bool_(), [], [("true", "type_mismatch")]),
    ("string", int_(), [], [("1", "type_mismatch")]),
    ("binary", bytes_(), [bytearray(b"\x01")], [(None, "required")]),
]


@pytest.mark.parametrize("ddl, decoder, good, bad", NUMBERS)
def test_numbers(spark, ddl, decoder, good, bad):
    out = run(spark, f"v {ddl}", [(g,) for g in good] + [(b,) for b, _ in bad], field("v", decoder))
    assert [o[1] for o in out] == [[]] * len(good) + [[("/v", c)] for _, c in bad]


def test_java_narrowing(spark):
    values = [1.9, -1.9, 3e9, -3e9, float("nan")]
    assert [o[0] for o in run(spark, "v double", [(v,) for v in values], field("v", int_("java")))] == [1, -1, 2147483647, -2147483648, 0]
    assert [o[0] for o in run(spark, "v bigint", [((1 << 32) + 7,), ((1 << 31),)], field("v", int_("java")))] == [7, -2147483648]


def test_custom_messages_and_meta(spark):
    out = run(spark, "v int", [(200,)], field("v", int_().range(0, 150, "年齢は0〜150の範囲で指定してください")))[0][2][0]
    assert out.u and out.m.startswith("年齢") and json.loads(out.meta) == {"min": 0, "max": 150, "actual": 200}
    out = run(spark, "v string", [("x",)], field("v", string().one_of("b", "a")))[0][2][0]
    assert out.m == "must be one of [a, b]" and json.loads(out.meta) == {"allowed": ["a", "b"], "actual": "x"}


def test_build_time_errors():
    for bad in (lambda: int_().multiple_of(0), lambda: string().trim().allow_blank(), lambda: list_(string()).contains(None), lambda: list_(string()).contains_all(), lambda: string().date().between(date(2024, 2, 1), date(2024, 1, 1)), lambda: combine()):
        with pytest.raises(ValueError):
            bad()


def test_lists_and_maps(spark):
    ints = run(spark, "items array<int>", [([1, -2, 3, -4],), ([],), (None,), ([1, None],)], field("items", list_(int_().positive()).nonempty()))
    assert ints[0][1] == [("/items/1", "out_of_range"), ("/items/3", "out_of_range")]
    assert ints[1][1] == [("/items", "too_small")] and ints[2][1] == [("/items", "required")] and ints[3][1] == [("/items/1", "required")]
    s = list_(string())
    out = run(spark, "t array<string>", [(["foo", "bar"],), (["read", "admin"],), (["a", "b", "a"],)], combine(field("t", s.contains("foo")), field("t", s.contains_all("read", "write")), field("t", s.unique())))
    assert [c for _, c in out[0][1]] == ["missing_elements"]
    assert json.loads(out[1][2][1].meta)["missing"] == ["write"]
    assert json.loads(out[2][2][-1].meta)["duplicates"] == ["a"]
    nulls = run(spark, "t array<string>", [([None, "a", None],)], field("t", list_(nullable(string())).unique()))
    assert nulls[0][1] == [("/t", "duplicate_element")]
    sizes = run(spark, "m map<string,int>", [({},), ({"a": 1},), ({k: 1 for k in "abcd"},), ({"a": -1},)], field("m", map_(int_().positive()).min_size(1).max_size(3)))
    assert [o[1] for o in sizes] == [[("/m", "too_small")], [], [("/m", "too_big")], [("/m/a", "out_of_range")]]
    fixed = run(spark, "t array<string>", [(["a"],)], combine(field("t", s.fixed_size(2)), field("t", s.min_size(2)), field("t", s.max_size(0))))
    assert [c for _, c in fixed[0][1]] == ["invalid_size", "too_small", "too_big"]
    keyed = run(spark, "t array<string>", [(["a", "b"],), (["a", "a"],)], field("t", s.to_map(lambda x: x, lambda x: F.length(x))))
    assert keyed[0][0] == {"a": 1, "b": 1} and keyed[1][1] == [("/t", "duplicate_ids")]


def test_lists_in_lists(spark):
    inner = combine(field("x", list_(int_().positive()).unique()), field("n", string().trim().min_length(2)), field("p", string().to_int().pipe(long_().min(5))))
    text = '[{"x":[1,2],"n":" AB ","p":"7"},{"x":[1,-1],"n":" b ","p":"3"},{"x":[3,3]}]'
    out = run_json(spark, [text, '[{"x":[1],"n":"ab","p":"5"}]'], list_(inner))
    assert out[0][1] == [("/0/n", "x")][:0] + [("/1/x/1", "out_of_range"), ("/1/n", "too_short"), ("/1/p", "out_of_range"), ("/2/x", "duplicate_element"), ("/2/n", "required"), ("/2/p", "required")]
    assert out[1][0][0].p == 5


def test_absence(spark):
    optional = run_json(spark, ["{}", '{"v":null}', '{"v":"x"}', "3"], optional_field("v", string()))
    assert [(o[0], [c for _, c in o[1]]) for o in optional] == [(None, []), (None, ["required"]), ("x", []), (None, [])]
    presence = run_json(spark, ["{}", '{"v":null}', '{"v":"a@b.com"}', '{"v":"bad"}'], optional_nullable_field("v", string().email()))
    assert [o[0] and o[0].state for o in presence] == ["absent", "present_null", "present", None]
    null = run_json(spark, ["{}", '{"v":null}'], field("v", nullable(string())))
    assert [o[1] for o in null] == [[("/v", "required")], []]
    default = run_json(spark, ["{}", '{"role":null}', '{"role":"invalid"}'], with_default(field("role", enum_of(["MEMBER"])), "MEMBER"))
    assert [o[0] for o in default] == ["MEMBER", "MEMBER", None] and default[2][1] == [("/role", "invalid_format")]
    record = run(spark, "name string", [("a",)], combine(field("name", string()), field("zip", string()), optional_field("x", string()), with_default(field("w", string()), "d")), "record")
    assert record[0][1] == [("/zip", "missing_field"), ("/w", "missing_field")]
    plain = run(spark, "name string", [("a",)], combine(field("name", string()), optional_field("x", string())))
    assert plain[0][1] == []


def test_default_replaces_a_lacking_object(spark):
    point = with_default(field("p", nested(combine(field("a", int_()), field("b", int_())))), lambda: F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    out = run(spark, "p struct<a:int,b:int>", [((1, None),), (None,), ((1, 2),)], point)
    assert [tuple(o[0]) for o in out] == [(0, 0), (0, 0), (1, 2)]


def test_unions(spark):
    contact = one_of(combine(field("kind", literal("email")), field("v", string().email())), combine(field("kind", literal("phone")), field("v", string().pattern(r"\d+"))))
    out = run(spark, "kind string, v string", [("email", "a@b.co"), ("phone", "12"), ("sms", "abc")], contact)
    assert out[0][0].kind == "email" and out[1][0].v == "12" and out[2][1] == [("", "one_of_failed")]
    meta = json.loads(out[2][2][0].meta)
    assert len(meta["candidates"]) == 2 and meta["candidates"][0]["issues"][0]["path"] == "/kind"
    shape = discriminate("type", {"circle": field("radius", double_().positive()), "rect": combine(field("w", double_()), field("h", double_())).map(lambda a, b: a * b)})
    out = run(spark, "type string, radius double, w double, h double", [("circle", 2.0, None, None), ("rect", None, 2.0, 3.0), ("triangle", None, None, None), (None, None, None, None)], shape)
    assert [o[0] for o in out] == [2.0, 6.0, None, None]
    assert out[2][1] == [("/type", "not_allowed")] and out[3][1] == [("/type", "required")]


def test_strictness(spark):
    person = combine(field("name", string()), field("age", int_()))
    assert run_json(spark, ['{"name":"a","age":1,"extra":2}'], strict(person, ["name", "age"]))[0][1] == [("/extra", "unknown_field")]
    assert run_json(spark, ['{"name":"a","age":1,"extra":2}'], person.strict())[0][1] == []
    rows = spark.createDataFrame([("a", 1, 2)], "name string, age int, extra int")
    assert decode(rows, person.strict()).frame.first()["issues"][0]["path"] == ["extra"]
    hidden = combine(field("name", string()), optional_field("age", int_()))
    assert [i["path"] for i in decode(rows, hidden.strict()).frame.first()["issues"]] == [["age"], ["extra"]]
    held = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>")
    assert decode_column(held, "m", strict(field("a", int_()), ["a"])).frame.first()["issues"][0]["path"] == ["b"]


def test_cross_field_rules(spark):
    period = field("period", nested(combine(field("start", int_()), field("end", int_())).flat_map(lambda a, b: check(F.struct(a, b), Rule(a > b, "invalid_range", "start is after end")))))
    out = run(spark, "period struct<start:int,end:int>", [((10, 5),), ((1, 5),), ((None, 5),)], period)
    assert [o[1] for o in out] == [[("/period", "invalid_range")], [], [("/period/start", "required")]]
    digits = F.create_map(F.lit("JPY"), F.lit(0), F.lit("USD"), F.lit(2))
    money = combine(field("amount", string().to_decimal().positive()), field("raw", string()), field("currency", string().to_upper_case())).flat_map(lambda a, raw, c: check(a, Rule(F.length(F.regexp_extract(raw, r"\.(\d*)", 1)) > F.try_element_at(digits, c), "invalid_scale", "too many decimal places")))
    out = run(spark, "amount string, raw string, currency string", [("1500", "1500", "jpy"), ("19.99", "19.99", "jpy"), ("19.99", "19.99", "usd"), ("-1", "-1", "usd")], money)
    assert [o[1] for o in out] == [[], [("", "invalid_scale")], [], [("/amount", "out_of_range")]]
    absolute = field("a", int_().flat_map_with_path(lambda v, path: check(v, Rule(v > 1, "x", "x", at=(*path, "deep")))))
    assert run(spark, "a int", [(2,)], absolute)[0][1] == [("/a/deep", "x")]
    failing = field("a", int_().flat_map(lambda v: fail("no", "no")))
    assert run(spark, "a int", [(2,)], failing)[0][1] == [("/a", "no")]


def test_recover_sees_issues(spark):
    out = run(spark, "v string", [("x",), ("1",)], recover(field("v", string().to_int()), lambda issues: -F.size(issues)))
    assert [o[0] for o in out] == [-1, 1] and not out[0][1]


def test_recursion(spark):
    comment = combine(field("body", string()), with_default(field("replies", list_(lazy(lambda: leaf))), F.array()))
    leaf = combine(field("body", string()))
    out = run_json(spark, ['{"body":"a","replies":[{"body":"b"},{"body":1}]}', '{"body":"a","replies":[{"body":"b"}]}'], combine(field("body", string()), field("replies", list_(lazy(lambda: leaf)))))
    assert out[0][1] == [("/replies/1/body", "type_mismatch")] and out[1][0].replies[0].body == "b"
    assert comment is not None


def test_dataset_operators(spark):
    rows = spark.createDataFrame([(3, "3"), (1, "1"), (4, "nope"), (2, "bad")], "k int, v string")
    done = traverse(rows, combine(field("v", string().to_int())), ["k"], base=("rows",))
    assert sorted((r["k"], r["pointer"]) for r in done.issues("k").collect()) == [(2, "/rows/1/v"), (4, "/rows/3/v")]
    assert all_or_nothing(done).count() == 0 and done.valid().count() == 2 and done.rejected().count() == 2
    assert all_or_nothing(traverse(rows.filter("k in (1, 3)"), combine(field("v", string().to_int())), ["k"])).count() == 2
    bare = traverse(rows, combine(field("v", string().to_int())), ["k"], prefix=False)
    assert {r["pointer"] for r in bare.issues().collect()} == {"/v"}
    with pytest.raises(Exception, match="expected integer"):
        decode(rows, combine(field("v", string().to_int()))).or_else_throw().collect()
    assert decode(rows, field("v", string().to_int())).map(lambda v: v * 2).frame.filter("k = 3").first()["value"] == 6
    rebased = decode(rows, field("v", string().to_int())).flat_map(lambda v: check(v, Rule(v > 1, "big", "big", at=("here",)))).frame.filter("k = 3").first()
    assert rebased["issues"][0]["path"] == ["here"] and rebased["value"] is None


def test_combined_results(spark):
    a = decode(spark.createDataFrame([(1, "x"), (2, "")], "k int, n string"), field("n", string().non_blank()))
    b = decode(spark.createDataFrame([(1, 5), (2, -5), (3, 1)], "k int, m int"), field("m", int_().positive()))
    out = {r["k"]: r for r in map2(["k"], lambda x, y: F.struct(x, y), a, b).frame.collect()}
    assert not out[1]["issues"] and [i["code"] for i in out[2]["issues"]] == ["blank", "out_of_range"] and [i["code"] for i in out[3]["issues"]] == ["required"]


def test_regroup(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 6), (2, "b", None, None)], "id int, name string, line int, qty int")
    out = {r["id"]: r["lines"] for r in regroup(rows, ["id", "name"], ["line", "qty"]).collect()}
    assert [(x["line"], x["qty"]) for x in out[1]] == [(1, 5), (2, 6)] and out[2] == []


def test_issue_operators(spark):
    rows = spark.createDataFrame([(1, "a", 200)], "k int, email string, age int")
    done = decode(rows, combine(field("email", string().min_length(3)), field("email", string().email()), field("age", int_().max(150)))).frame
    flat = {r["pointer"]: r["messages"] for r in I.flatten(done, ["k"]).collect()}
    assert flat == {"/email": ["must be at least 3 characters", "not a valid email"], "/age": ["must be at most 150"]}
    assert {r["pointer"]: len(r["issues"]) for r in I.group_by_path(done, ["k"]).collect()} == {"/email": 2, "/age": 1}
    row = done.select(I.format_tree(F.col("issues")).alias("tree"), I.to_json_list(F.col("issues")).alias("js"), I.flattened_column(F.col("issues")).alias("f"), I.text_form(F.lit(1), F.col("issues")).alias("t")).first()
    assert json.loads(row["tree"]) == {"email": {"_errors": flat["/email"]}, "age": {"_errors": flat["/age"]}}
    assert [x["code"] for x in json.loads(row["js"])] == ["too_short", "invalid_format", "out_of_range"] and row["f"][0]["pointer"] == "/email"
    assert row["t"] == "Err[/email: must be at least 3 characters, /email: not a valid email, /age: must be at most 150]"
    assert I.error_tree([["_errors", "x"], []], ["a", "b"])["_errors"] == ["b"]


def test_messages(spark):
    assert set(messages.EN) == set(messages.JA) and len(messages.CODES) == 21
    meta = json.dumps({"min": 1, "max": 2, "expected": "x", "divisor": 3, "maxScale": 2, "missing": ["a", "b"], "duplicates": ["c"], "allowed": ["d", "e"]})
    rows = spark.createDataFrame([(c, meta) for c in (*messages.CODES, "mine")], "code string, meta string")
    code, m = F.col("code"), F.col("meta")
    out = {r["code"]: r for r in rows.select("code", messages.default(code, m).alias("d"), messages.BUNDLES["en"](code, m).alias("en"), messages.BUNDLES["ja"](code, m).alias("ja")).collect()}
    for c in messages.CODES:
        assert out[c]["d"] == out[c]["en"] and "{" not in out[c]["ja"]
    assert out["mine"]["d"] == out["mine"]["ja"] == "validation failed: mine"
    assert out["missing_elements"]["d"] == "must contain all of x (missing: [a, b])"
    low = spark.createDataFrame([("out_of_range", '{"min":1}')], "code string, meta string")
    first = low.select(messages.default(code, m).alias("d"), messages.for_locale("ja-JP")(code, m).alias("ja"), messages.for_locale("xx")(code, m).alias("xx")).first()
    assert tuple(first) == ("must be at least 1", "1以上{max}以下で入力してください", "must be between 1 and {max}")


def test_resolution_happens_once(spark):
    done = decode(spark.createDataFrame([(-1,)], "v int"), field("v", int_().positive())).frame
    once = I.resolve(F.col("issues"))
    row = done.select(once.alias("a"), I.resolve(once, locale="ja").alias("b")).first()
    assert row["a"][0]["message"] == row["b"][0]["message"] == "must be at least 1" and row["a"][0]["custom_message"]


def test_encoders(spark):
    rows = spark.createDataFrame([(42, "Widget", 9.99, [(1, "t1"), (2, "t2")], None)], "id int, name string, price double, tables array<struct<n:int,label:string>>, note string")
    table = E.object_(E.property_("number", E.int_, lambda c: c["n"]), E.property_("label", E.string))
    item = E.object_(E.property_("id", E.int_), E.property_("name", E.string.contramap(F.upper)), E.property_("price", E.double_), E.property_("tables", E.list_(table)), E.property_("note", E.string.with_default("none")), E.property_("maybe", E.string.nullable(), lambda c: c["note"]))
    row = rows.select(E.to_json(item)(F.struct("*")).alias("j")).first()["j"]
    assert list(json.loads(row)) == ["id", "name", "price", "tables", "note"] and json.loads(row)["tables"][1] == {"number": 2, "label": "t2"}
    times = spark.sql("select timestamp'2024-01-02 03:04:00' a, timestamp'2024-01-02 03:04:05.120' b, timestamp'2024-01-02 03:04:05.000007' c, named_struct('ts', timestamp'2024-01-02 03:04:05', 'offset_seconds', 32400) o, bigint(37815500000000) t, date'2024-01-02' d")
    out = times.select(E.date_time(F.col("a")), E.date_time(F.col("b")), E.iso8601(F.col("a")), E.iso8601(F.col("c")), E.offset_date_time(F.col("o")), E.time(F.col("t")), E.date(F.col("d"))).first()
    assert tuple(out) == ("2024-01-02T03:04", "2024-01-02T03:04:05.120", "2024-01-02T03:04:00Z", "2024-01-02T03:04:05.000007Z", "2024-01-02T12:04:05+09:00", "10:30:15.500", "2024-01-02")


def test_guard(spark):
    class Money:
        def __init__(self, n):
            self.n = n

    guarded = guard.guarded(Money)
    assert guarded(1).n == 1
    with guard.enforced():
        with pytest.raises(guard.ConstructionGuardError):
            guarded(1)
        with guard.decoding():
            guarded(1)
        assert guard.decoder_method(lambda: guarded(2).n)() == 2
        assert guard.is_active()
    assert not guard.is_active() and guard.call(guard.is_active)
    config = guard.GuardConfig(("app.domain.**",), ("app.domain.dto.*",))
    assert config.matches("app.domain.a.B") and not config.matches("app.domain.dto.X") and not config.matches("app.other.X")
    assert guard.GuardConfig(("a.*",)).matches("a.B") and not guard.GuardConfig(("a.*",)).matches("a.b.C")


def test_sources_and_streaming(spark, tmp_path):
    from lodegrain import sources, streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("email,age\na@b.co,3\nbad,x\n")
    rows = sources.read_csv(spark, str(tmp_path / "in"), ["email", "age"])
    person = combine(field("email", string().email()), field("age", string().to_int()))
    assert decode(rows, person).valid().count() == 1
    (tmp_path / "j.txt").write_text('{"a":1}\nnope\n')
    assert sources.read_json_lines(spark, str(tmp_path / "j.txt")).filter("json is null").count() == 1
    stream = spark.readStream.schema("email string, age string").option("header", True).csv(str(tmp_path / "in"))
    query = streaming.quarantine(stream, person, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert [len(r["issues"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_plans_stay_linear(spark):
    s = string()
    for k in range(12):
        s = s.trim().min_length(k).to_lower_case()
    frame = decode(spark.range(1).select(F.lit("abcdefghijklmnop").alias("v")), field("v", s)).frame
    assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 60_000 and not frame.first()["issues"]


def test_signed_zeros_and_exact_decimals(spark):
    rows = spark.createDataFrame([(-0.0,), (0.0,), (10.0,)], "x double")
    codes = lambda d: [len(r["issues"]) for r in decode(rows, field("x", d)).frame.collect()]
    assert codes(double_().range(0.0, 10.0)) == [1, 0, 0] and codes(double_().max(-0.0)) == [0, 1, 1] and codes(double_().range(-0.0, 5.0)) == [0, 0, 1]
    texts = ["1e-25", "123456789012345678901234", "1.0000000000000000000000", "100e-20", "0e-30", "0.000000000000000001", "1e-19"]
    got = decode(spark.createDataFrame([(t,) for t in texts], "x string"), field("x", string().to_decimal())).frame.collect()
    assert [[i["code"] for i in r["issues"]] for r in got] == [["type_mismatch"], ["type_mismatch"], [], [], [], [], ["type_mismatch"]]
    assert got[3]["value"] == Decimal("1e-18") and got[4]["value"] == 0


def test_recursion_below_its_depth_is_an_issue(spark):
    tree = combine(field("n", int_()), optional_field("kids", list_(lazy(lambda: tree, 2))))
    deep = '{"n":1,"kids":[{"n":2,"kids":[{"n":3,"kids":[{"n":4,"kids":[{"n":"bad"}]}]}]}]}'
    flat = '{"n":1,"kids":[{"n":2,"kids":[{"n":3}]}]}'
    out = run_json(spark, [deep, flat], tree)
    assert [c for _, c in out[0][1]] == ["nested_too_deeply"] and out[1][1] == []


def test_equal_keys_keep_their_issues_apart(spark):
    done = decode(spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string"), field("x", string().min_length(5))).frame.withColumn("k", F.lit(1))
    assert [(r["pointer"], len(r["messages"])) for r in I.flatten(done, ["k"]).collect()] == [("/x", 1), ("/x", 1)]


def test_json_names_with_quotes(spark):
    out = run_json(spark, ['{"it\'s": 3}', '{"a\\"b": 4}'], combine(optional_field("it's", int_()), optional_field('a"b', int_())).tuple())
    assert [r[1] for r in out] == [[], []]


def test_decimals_of_numbers_are_those_of_their_text(spark):
    doubles = [0.0, -0.0, 0.001, 0.00099, 9999999.999, 1e7, 12.5, -1500.0, 0.0012345678901234567, 1e-25, 1e20, 123456789012345678.0, float("nan"), float("inf"), float("-inf"), None]
    rows = [(x, None if x is None else k - 5) for k, x in enumerate(doubles)]
    frame = spark.createDataFrame(rows, "d double, l bigint").select("d", F.col("d").cast("float").alias("f"), "l", *(F.col(c).cast("string").alias(f"{c}_text") for c in ("d", "l")), F.col("d").cast("float").cast("string").alias("f_text"))
    for c in ("d", "f", "l"):
        typed, text = decode(frame, field(c, decimal_().scale(1))).frame.collect(), decode(frame, field(f"{c}_text", string().to_decimal().scale(1))).frame.collect()
        shown = lambda done: [(r["value"], [(i["code"], i["meta"] if i["code"] == "invalid_scale" else None) for i in r["issues"]]) for r in done]
        assert shown(typed) == shown(text)


def test_reports_run_each_binding_once(spark):
    n = decimal_()
    frame = spark.range(3).select((F.col("id") / 4).alias("x"))
    decoded = decode(frame, combine(*(field("x", r) for r in (n.scale(1), n.min(1), n.max(9))))).frame.withColumn("k", F.lit(1))
    for report in (I.summary(decoded), I.exploded(decoded, ["k"])):
        assert report._jdf.queryExecution().optimizedPlan().toString().count("as decimal(38,18))") <= 6
    assert {(r["pointer"], r["code"]): r["n"] for r in I.summary(decoded).collect()} == {("/x", "invalid_scale"): 1, ("/x", "out_of_range"): 3} and I.exploded(decoded, ["k"]).count() == 4
