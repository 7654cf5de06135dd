import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import blocktext, shred

RESP = "doc_token string, ord int, code int, block_map string, block_sequence array<string>, meta_map string, captured_at timestamp"


def row(doc, ord_, blocks, code=0, seq=None, meta=None):
    return (doc, ord_, code, json.dumps(blocks) if blocks is not None else None, seq, json.dumps(meta) if meta is not None else None, None)


def test_plan_inlines_singletons_and_splits_repeats(spark):
    schema = T._parse_datatype_string("k string, a struct<b: int, c: struct<d: string>>, xs array<struct<y: int, zs: array<string>>>, m map<string, struct<v: int>>")
    plan = {t.name: t for t in shred.inline_plan(schema, "r", ["k"])}
    assert list(plan) == ["r", "r_xs", "r_xs_zs", "r_m"]
    assert list(plan["r"].columns) == ["a_b", "a_c_d"] and plan["r_xs_zs"].keys == ["k", "xs_pos", "zs_pos"] and plan["r_m"].columns == {"v": "`__v`.`v`"}


def test_round_trip_of_nested_rows(spark):
    df = spark.createDataFrame([("1", [(1, ["p", "q"]), (2, [])]), ("2", None)], "k string, xs array<struct<y: int, zs: array<string>>>")
    t = shred.shred(df, "r", ["k"])
    zs = t["r_xs_zs"].groupBy("k", "xs_pos").agg(F.sort_array(F.collect_list(F.struct("zs_pos", "value"))).alias("z"))
    back = {(r["k"], r["xs_pos"]): (r["y"], [z["value"] for z in r["z"]] if r["z"] else []) for r in t["r_xs"].join(zs, ["k", "xs_pos"], "left").collect()}
    assert back == {("1", 0): (1, ["p", "q"]), ("1", 1): (2, [])}
    assert t["r"].count() == 2


def test_shared_and_recursive_elements_get_link_rows(spark):
    assert shred.shared_elements([("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("e", "d"), ("a", "f")]) == {"c", "d", "e"}
    schema = T._parse_datatype_string("k string, up string, a struct<one: string, xs array<struct<y: string, zs: array<string>>>, m: map<string, array<string>>>")
    refs = {"up": shred.Ref("r", up=True), "a.one": shred.Ref("other"), "a.xs.y": shred.Ref("r"), "a.xs.zs": shred.Ref("r"), "a.m": shred.Ref("r")}
    plan = {t.name: t for t in shred.inline_plan(schema, "r", ["k"], refs)}
    assert {(t.name, c) for t in plan.values() for c in t.links} == {("r", "up"), ("r_a_xs", "y"), ("r_a_xs_zs", "value"), ("r_a_m_item", "value")}
    assert "a_one" in plan["r"].columns  # told once, so a foreign key
    assert "a_one" in {t.name: t for t in shred.inline_plan(schema, "r", ["k"], refs, [("more", "other")])}["r"].links
    try:
        shred.inline_plan(schema, "r", ["k"], {"a.none": shred.Ref("r")})
        raise AssertionError("a member that is not there was taken")
    except ValueError:
        pass
    assert "item_k" in shred.inline_plan(T._parse_datatype_string("k string, xs array<struct<k: int>>"), "r", ["k"])[1].columns
    rows = [("s", "1", "0", ("9", [("2", ["3", None, "3"]), (None, None), None], {"p": ["4", None], "q": None})), ("s", "2", None, None), ("t", "1", None, (None, None, {"p": ["1"]}))]
    df = spark.createDataFrame(rows, "s string, k string, up string, a struct<one: string, xs array<struct<y: string, zs: array<string>>>, m: map<string, array<string>>>")
    got = sorted(tuple(r) for r in shred.links(df, "r", ["s"], "k", refs).collect())
    assert got == [("s", "0", "1"), ("s", "1", "2"), ("s", "1", "3"), ("s", "1", "4"), ("t", "1", "1")]


def test_links_from_all_sides_first_block_wins(spark):
    blocks = {
        "p": {"data": {"type": "page", "children": ["a", "a", "gone", "p"]}},
        "a": {"data": {"type": "text", "parent_id": "p", "text": {"text": "x"}}},
        "t": {"data": {"type": "table", "parent_id": "gone", "cell_set": {"r1": {"block_id": "c", "merge_info": {"row_span": 2}}}, "cells": [["c", "d"], None]}},
        "c": {"data": None},
        "d": {},
        "n": None,
    }
    later = {"a": {"data": {"type": "text", "parent_id": "t"}}, "e": {"data": {"type": "text", "parent_id": "a"}}}
    refused = {"z": {"data": {"parent_id": "p"}}}
    df = spark.createDataFrame([row("D", 0, blocks, seq=["p", "t"]), row("D", 0, blocks, seq=["p", "t"]), row("D", 1, later), row("D", 2, refused, code=403), row(None, 0, blocks), row("E", None, None)], RESP)
    df = df.withColumn("raw", F.lit("clash")).withColumn("block_id", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(tuple(r)[1:] for r in shred.block_links(df).collect())
    assert got == [("a", "e"), ("p", "a"), ("t", "c"), ("t", "d")]
    assert {r["block_id"] for r in shred.block_tables(df)["block"].collect()} == {"p", "a", "t", "c", "d", "e"}
    assert [(r["block_id"], r["text"]) for r in shred.text_pieces(df).collect()] == [("a", "x")]


def test_texts_of_three_layouts_in_order(spark):
    blocks = {
        "a": {"data": {"type": "heading2", "text": {"initialAttributedTexts": {"text": {"10": "c", "2": "b", "0": "a"}}}}},
        "b": {"data": {"type": "bullet", "text": {"segments": [{"text": "x"}, {"text": "y", "style": {"bold": True}}]}}},
        "c": {"data": {"type": "code", "text": {"segments": ["m", "n"]}}},
    }
    df = spark.createDataFrame([row("D", 0, blocks, seq=["b", "a", "c", "b"])], RESP)
    assert {r["block_id"]: r["t"] for r in shred.text_pieces(df).groupBy("block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "text"))), lambda x: x["text"]), "").alias("t")).collect()} == {"a": "abc", "b": "xy", "c": "mn"}
    assert blocktext.block_markdown(df).first()["text"] == "- xy\n\n## abc\n\n```\nmn\n```"


def test_empty(spark):
    df = spark.createDataFrame([], RESP)
    assert shred.block_links(df).count() == 0 and shred.text_pieces(df).count() == 0


def test_html_text():
    assert blocktext.html_text("<nav>menu</nav><div class='content'><p>One &amp; two<p>three " + "x" * 60 + "</div><div class=ad>buy</div>") == "One & two\nthree " + "x" * 60
    assert blocktext.html_text(None) is None and blocktext.html_text("") == ""
