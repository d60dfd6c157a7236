import datetime as dt

import pytest

from graphloom.llm.docpairs import describe_pairs, description, extract_units, newest, units

REAL = [
    ("Keeps the newest entry.", "keep"),
    ("Idempotent per key.", "put"),
    ("/** Never blocks the caller. */", "poll"),
    ("/// Slow for wide input.\n/// \n/// @param x\n/// @returns", "scan"),
    ('"""Undo with `push`."""', "pop"),
    ("Returns null without a key.\n\nnoqa: E501 key", "get"),
    ("检查缓存是否仍被其他模块引用", "check"),
    ("Liefert alle Einträge.", "alle"),
    ("# Caller owns the returned buffer.\n# TODO: cover the rest.", "make"),
    ("Copyright (c) 2020 the authors\n\nSplits long input at each comma.", "split"),
    ("@param node the node to start from\n@returns the nearest leaf", "near"),
    ("get: raises if closed by somebody else.", "get"),
    ("<summary>Waits until all jobs are done.</summary>", "wait"),
]
TRIVIAL = [
    (None, "x"), ("", "x"), (" \n\t", "x"), ("/**/", "x"), ("---", "x"), ("...", "x"), ("TODO", "x"), ("todo: write docs", "x"), ("N/A", "x"), ("None", "x"), ("No description.", "x"),
    ("Missing documentation", "x"), ("Add description here", "x"), ("Beschreibung fehlt", "x"), ("暂无说明", "x"), ("待补充", "x"), ("@param a\n@returns", "x"), (":param a:\n:return:", "x"),
    ("@param {string} a\n@returns {void}", "x"), ("Args:\n    a:\nReturns:", "x"), ("{@inheritDoc}", "x"), ("@override", "x"), ("<summary></summary>", "x"), ("pylint: disable=all", "x"), ("noqa: E501", "x"),
    ("eslint-disable-next-line", "x"), ("@ts-ignore", "x"), ("#region a", "x"), ("clang-format off", "x"), ("istanbul ignore next", "x"), ("SPDX-License-Identifier: MIT", "x"), ("All rights reserved.", "x"),
    ("Copyright (c) 2019 the x authors", "x"), ("Created by IDE template", "x"), ("Auto-generated method stub", "x"), ("print(x)", "x"), ("a.b = null;", "x"), ("return a.run();", "x"), ("if (a) { b(); }", "x"),
    ("for (const a of list) {\n  b(a);\n}\nreturn c;", "x"), ("getUserName", "getUserName"), ("Gets the user name.", "getUserName"), ("The init function.", "init"), ("Method run", "run"), ("run()", "run"),
    ("Insert root list method.", "insertRootList"), ("R sum router.", "résuméRouter"),
    ("This file belongs to the x project. It may be used only under the terms of the licence which comes with it; see the LICENCE file. The software is given as is, with no promise of fitness.", "x"),
]


@pytest.mark.parametrize("doc, name", REAL)
def test_real(doc, name):
    assert description(doc, name)


@pytest.mark.parametrize("doc, name", TRIVIAL)
def test_trivial(doc, name):
    assert description(doc, name) == ""


def test_units_capture_comment_signature_and_balanced_body():
    js = '/** Adds a brace. */\nfunction add(a = ")", b) {\n  return "}" + a; // }\n}\nfunction bare() { return 1; }\n'
    [(doc, signature, body)] = units(js)
    assert doc == "/** Adds a brace. */" and signature == 'function add(a = ")", b)' and body.startswith("{") and body.endswith("}") and 'return "}"' in body and "bare" not in body
    py = 'def f(a, b=")"):\n    """Says so."""\n    if a:\n        return (1)\n\ndef g():\n    pass\n'
    [(doc, signature, body)] = [u for u in units(py) if '"""' in u[0]]
    assert doc == '"""Says so."""' and signature.startswith("def f(") and "return (1)" in body and "def g" not in body
    assert units(None) == [] and units("") == [] and units("(" * 3000) == []


def test_pairs_of_rows(spark):
    data = [("1", "f", "Real words here.", "()"), ("2", "f", "Real words here.", " "), ("3", "f", None, "()"), ("4", None, "Closes all open handles.", "unbalanced("), ("5", "g", "x " * 50_000 + "end", "()"), ("1", "f", "Real words here.", "()")]
    df = spark.createDataFrame(data, "id string, name string, doc string, sig string").selectExpr("*", "1 AS description", "2 AS signature")
    got = sorted(r["id"] for r in describe_pairs(df, "id", "name", "doc", "sig").collect())
    assert got == ["1", "1", "4", "5"]
    assert describe_pairs(df.limit(0), "id", "name", "doc", "sig").count() == 0


def test_units_of_texts(spark):
    df = spark.createDataFrame([(1, "# Doubles what comes in.\ndef f(x):\n    return 2\n"), (2, None), (3, "")], "i int, t string")
    assert [(r["id"], r["documentation"]) for r in extract_units(df, "i", "t").collect()] == [("1", "Doubles what comes in.")]


def test_newest(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", None, 1), ("a", t, 2), ("a", t, 2), (None, t, 3)], "k string, o timestamp, v int")
    assert [tuple(r) for r in newest(df, "k", "o", ["v"]).collect()] == [("a", 2)]
