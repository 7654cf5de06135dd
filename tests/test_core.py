import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.operators import catalog, links, plans, sheets, usage
from quarryline.operators import textsearch as X
from quarryline.operators.prefix import running_sum
from quarryline.sources import files, sinks
from quarryline.streaming import usage_stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


LOG = "user_id string, file_path string, line_no int, rec_type string, logged_at string, message struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>"


def test_usage_lines_keep_own_day_and_drop_bad_ones(spark):
    rows = [
        ("u", "f", 1, "assistant", "2026-04-01T23:30:00-05:00", ((10, 5),)), ("u", "f", 2, "assistant", "2026-04-02T00:10:00Z", ((7, None),)), ("u", "f", 3, "user", "2026-04-02T00:10:00Z", ((1, 1),)),
        ("u", "f", 4, "assistant", "bad", ((1, 1),)), ("u", "f", 5, "assistant", "2026-04-02T01:00:00Z", ((None, None),)), (None, "f", 6, "assistant", "2026-04-02", ((2, 2),)), ("u", "f", 7, "assistant", None, None),
    ]
    x = usage.usage_lines(spark.createDataFrame(rows, LOG))
    assert sorted((r["day"], r["input"], r["output"]) for r in x.collect()) == [("2026-04-01", 10, 5), ("2026-04-02", 2, 2), ("2026-04-02", 7, 0)]
    assert str(x.where("input = 10").first()["at"]) == "2026-04-02 04:30:00"
    days = usage.user_daily(x)
    assert [tuple(r) for r in usage.leaderboard(usage.period_totals(days)).collect()] == [(1, "u", 22, 2)]
    assert usage.daily(x.limit(0)).count() == 0


def test_merge_prefers_local(spark):
    a = spark.createDataFrame([("d1", 5)], "day string, n int")
    b = spark.createDataFrame([("d1", 9), ("d2", 4)], "day string, n int")
    assert sorted(map(tuple, usage.merge_prefer_local(a, b, ["day"]).collect())) == [("d1", 5), ("d2", 4)]


def test_formats(spark):
    r = one(spark, a=usage.short_number(F.lit(2500)), b=usage.short_number(F.lit(1_250_000)), c=usage.short_number(F.lit(7)), d=usage.duration_text(F.lit(3725)), e=usage.progress_bar(F.lit(50)))
    assert tuple(r) == ("2K", "1.2M", "7", "1小时2分钟", "[██████████░░░░░░░░░░] 50%")


@pytest.mark.parametrize(
    ("query", "title", "abstract", "want"),
    [("python list", "Python list tutorial - CSDN", "how to use list in python", 10.0), ("", "hello", "world", 5.0), ("", "app下载", "x", 0.5), ("", "双十一 优惠券", "x", 1.0), ("", "优惠券 教程", "x", 5.8), ("教程", "掘金 教程", "", 10.0), ("", "bilibili 入门", "", 7.3), ("", None, None, 5.0)],
)
def test_quality_score(spark, query, title, abstract, want):
    assert one(spark, s=rules.quality_score(F.lit(title).cast("string"), F.lit(abstract).cast("string"), F.lit(None).cast("string"), query))["s"] == want


@pytest.mark.parametrize(("name", "path", "want"), [("AB", "", 1.0), ("xaby", "", 0.8), ("zz", "/ab/", 0.5), ("b-a", "", 0.3), ("a--", "", 0.15), (None, None, 0.0)])
def test_name_score(spark, name, path, want):
    assert one(spark, s=rules.name_score(F.lit(name).cast("string"), F.lit(path).cast("string"), "ab"))["s"] == want


def test_search_positions_and_snippets(spark):
    df = spark.createDataFrame([(1, "aXbxc"), (2, "a😀b"), (3, None), (4, "")], "id int, text string")
    assert [tuple(r) for r in X.search(df, "id", "text", "x").collect()] == [(1, 1, "a【x】b【x】c"), (1, 3, "a【x】b【x】c")]
    assert [r["position"] for r in X.search(df, "id", "text", "b").where("id = 2").collect()] == [2]
    assert X.search(df, "id", "text", "").count() == 0


def test_cleaning(spark):
    r = one(spark, a=X.clean_text(F.lit(" a​ b  c \n\n\n\n ¥d ")), b=X.without_ad_lines(F.lit("x\n\n buy ad now\nhttp://ads.example/y"), ("ad",), ("ads.example",)), c=X.strip_tags(F.lit("<title>T</title><script>x</script><p>a</p>b")), d=X.html_title(F.lit("<title> T </title>")))
    assert tuple(r) == ("a b c\n\nd", "x\n", "T a b", "T")
    r = one(spark, a=X.html_links(F.lit('<a href="/n/1.html">x</a><a href="https://o.e/">y</a><a href="mailto:x">z</a>'), F.lit("https://e.com/x/")))
    assert r["a"] == ["https://e.com/n/1.html", "https://o.e/"]


def test_links(spark):
    r = one(spark, a=links.site(F.lit("HTTPS://u@WWW.Ex.com:8080/a")), b=links.is_article(F.lit("https://e.com/tag/1"), F.array(F.lit("/n/")), F.array(F.lit("/tag/"))), c=links.is_article(F.lit("https://e.com/n/1"), F.array(F.lit("/n/")), F.lit(None).cast("array<string>")), d=links.resolve(F.lit("https://e.com/a/b"), F.lit("../c?x=1")))
    assert tuple(r) == ("ex.com", False, True, "https://e.com/c?x=1")


def test_cells_and_tables(spark):
    df = spark.createDataFrame([("A1",), ("AA10",), ("R1C1",), ("row_0_col_0",), ("??",), (None,)], "k string")
    assert [tuple(r["p"]) if r["p"] else None for r in df.select(sheets.cell_position(F.col("k")).alias("p")).collect()] == [(0, 0), (9, 26), (0, 0), (0, 0), None, None]
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(""), F.lit(" ")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, t=sheets.markdown_table(rows))["t"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_plans(spark):
    t = spark.createDataFrame([("p", "1", None, []), ("p", "2", "pending", ["1"]), ("p", "3", "pending", ["2"])], "plan string, id string, status string, dependencies array<string>")
    assert [r["id"] for r in plans.ready(t).collect()] == ["1"]
    done = t.withColumn("status", F.when(F.col("id") == "1", "completed").otherwise(F.col("status")))
    assert [r["id"] for r in plans.ready(done).collect()] == ["2"]
    assert [one(spark, x=plans.idle_level(F.lit(s), F.lit(e)))["x"] for s, e in ((30, 0), (31, 0), (61, 0), (121, 0), (0, 3))] == ["healthy", "warning", "critical", "stuck", "warning"]


def test_stale_docs(spark):
    docs = spark.createDataFrame([("abcdefgh1", "1"), ("bbbbbbbb1", None), ("cccccccc1", "2")], "obj_token string, edit_time string")
    cached = spark.createDataFrame([("abcdefgh", "1"), ("bbbbbbbb", None), ("cccccccc", "9")], "short_id string, edit_time string")
    assert {r["obj_token"] for r in catalog.stale_docs(docs, cached).collect()} == {"bbbbbbbb1", "cccccccc1"}


def test_running_sum_over_one_hot_group(spark):
    df = spark.range(500).select((F.col("id") % 3 == 7).alias("g"), "id", (F.col("id") % 5).alias("v"), F.lit(1).alias("before2"))
    got = {r["id"]: r["before"] for r in running_sum(df, ["g"], ["id"], "v").collect()}
    assert got == {i: sum(j % 5 for j in range(i)) for i in range(500)}
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    assert sorted((r["id"], r["before"]) for r in running_sum(nulls, ["g"], ["id"]).collect()) == [(1, 0), (2, 1), (3, 0)]
    assert running_sum(nulls.limit(0), ["g"], ["id"]).count() == 0


def _docx():
    b = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:t>one</w:t><x r:embed="i1"/><x r:embed="i1"/></w:p><w:tbl><w:tr><w:tc><w:p><w:t>cell</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<R><e Id="i1" Target="media/a.png"/></R>')
        z.writestr("word/media/a.png", b"PNG")
    return b.getvalue()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "b.txt").write_bytes("标题: T\nURL: u\n中文".encode("gbk"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    x = files.binary_files(spark, str(tmp_path), (".docx", ".txt"))
    assert x.where("ext = '.docx'").select(files.docx_texts("content").alias("t")).where("t is not null").first()["t"] == "one\ncell"
    assert [(r["image_no"], r["name"], bytes(r["data"])) for r in files.docx_images(x.where("ext = '.docx'")).collect()] == [(1, "image_001.png", b"PNG")]
    assert "中文" in x.where("ext = '.txt'").select(files.decoded("content").alias("t")).first()["t"]
    assert tuple(files.scan_counts(spark, str(tmp_path), (".docx",)).first()) == (3, 2, 0)


def test_json_sources(spark, tmp_path):
    logs = tmp_path / "logs" / "p"
    logs.mkdir(parents=True)
    (logs / "s.jsonl").write_text('{"type":"assistant","timestamp":"2026-04-01T00:00:00Z","message":{"usage":{"input_tokens":1}}}\n{not json\n\n')
    assert [(r["rec_type"], r["message"]["usage"]["input_tokens"]) for r in files.usage_logs(spark, str(tmp_path / "logs")).collect()] == [("assistant", 1)]
    trees = tmp_path / "trees"
    trees.mkdir()
    (trees / "t.json").write_text(json.dumps({"folder_id": "a", "folder_name": "A", "docs": [], "children": {"b": {"folder_id": "b", "children": {"c": {"folder_id": "c"}}}}}))
    assert sorted((r["folder_id"], r["parent_id"], r["depth"]) for r in files.json_trees(spark, str(trees)).collect()) == [("a", None, 0), ("b", "a", 1), ("c", "b", 2)]


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("u1", "t", "2025-01-01 00:00:00"), ("u2", "t", "2025-01-02 00:00:00")], "url string, title string, at string")
    sinks.write_state(df, str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "state")).where("total_count = 2").count() == 2
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = usage_stream.append_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "url")
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
