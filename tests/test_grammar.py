"""The line grammar: golden lines, limits, and both forms against the walker on random lines."""

import random
import re

import pytest

from siftline.operators import grammar

CASES = {
    "user@test.com,pass123,https://site.com,field1,field2": ("user@test.com", "pass123", "https://site.com", ["field1", "field2"]),
    "": None,
    "user@test.com": None,
    "a" * 5000: None,
    "user\x00invalid,pass,site": None,
    "single_field": None,
    "user,pass,url,extra,too,many,fields,for,normal,processing": ("user", "pass", "url", ["extra", "too", "many", "fields", "for", "normal", "processing"]),
    "测试@example.com,密码123,https://日本.example.com,中文字段": ("测试@example.com", "密码123", "https://日本.example.com", ["中文字段"]),
    "a@b.c:pw": ("a@b.c", "pw", "", []),
    "a@b.c:pw:x": ("a@b.c", "pw:x", "", []),
    "a:b,c": ("a:b", "c", "", []),
    "a,b,": ("a", "b", "", []),
    "a,,": ("a", "", "", []),
    "a,": None,
    ",b": None,
    "a,b, c": ("a", "b", "", ["c"]),
    "a,p w,u v": ("a", "p w", "u", ["v"]),
    'a,"x,y",u': ("a", "x,y", "u", []),
    'a,"x""y",u': ("a", 'x"y', "u", []),
    'ab"c,d"e,p': ("abc,de", "p", "", []),
    'a,"open,u': ("a", "open,u", "", []),
    "a,b,https://u@h:80/p": ("a", "b", "https://u@h", ["80/p"]),
    "u" * 4097 + ",p": None,
    "u" * 4096 + ",p": ("u" * 4096, "p", "", []),
    "é" * 2049 + ",p": None,
    "  　a,b\r": ("a", "b", "", []),
    "a,b," + "x" * 40_960: None,
    'a,b,"　"': ("a", "b", "", []),
}


def parse(spark, lines, form):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r.i: (r.username, r.password, r.url, list(r.extra_fields)) for r in grammar.parse_lines(df, form=form).collect()}
    return [got.get(i) for i in range(len(lines))]


@pytest.mark.parametrize("form", ["native", "pandas"])
def test_lines(spark, form):
    assert parse(spark, list(CASES), form) == list(CASES.values())


def test_null_lines_are_rejected(spark):
    assert parse(spark, [None, "a,b"], "native") == [None, ("a", "b", "", [])]


def test_native_is_the_walker(spark):
    rng = random.Random(11)
    signs = 'ab@:, ."x"\t　é'
    lines = list({"".join(rng.choice(signs) for _ in range(rng.randint(1, 18))) for _ in range(60_000)})
    assert len(lines) > 50_000

    def expect(line):
        line = line.strip(grammar.WHITE_SPACE)
        if not line or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", line):
            return None
        f = grammar.split_line(line)
        return None if len(f) < 2 or not f[0] else (f[0], f[1], f[2] if len(f) > 2 else "", f[3:])

    assert parse(spark, lines, "native") == [expect(x) for x in lines]


def test_reasons(spark):
    lines = ["", "a\x01,b", "x" * 40_961, "one", ",b", "u" * 4097 + ",p", "a,b", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = [r.reason for r in grammar.reject_reasons(df).orderBy("i").collect()]
    assert got == ["empty", "binary", "long", "fields", "username", "field_length", "ok", "empty"]


def test_other_columns_stay_and_clashes_are_replaced(spark):
    df = spark.createDataFrame([("a,b", 1, "old")], "value string, n int, username string")
    row = grammar.parse_lines(df).collect()[0]
    assert (row.n, row.username) == (1, "a")


def test_white_space_within_a_line_is_read_once(spark):
    line = "a," + " " * 30_000 + "b"
    assert parse(spark, [line], "native") == [("a", "b", "", [])]
