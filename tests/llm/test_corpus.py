import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import encoding, mixing, packing, queries
from quarryline.llm.tokens import VOCABULARY, counter

SENT = "过去三天里，云舟支付把目录同步写进了说明，随后由财务口复核。"
DE = "Für die Größe der Ablage hat die Prüfung über Gebühren für Händler gezählt. "


def corpus():
    rnd = random.Random(1)
    zh = [x for x in "的一是在了和为对不将把以后前中月日年条项份材料云舟支付目录同步写进说明随由财务口复核过去三天里"]
    texts = ["".join(rnd.choice(zh) for _ in range(20)) + "，" + SENT * 3 for _ in range(150)] + [DE * 3 + str(i) for i in range(120)] + ["Grâce à l’équipe, déjà réglé." * 3 for _ in range(60)]
    return texts


def bad():
    return [(SENT * 2).encode().decode("cp1252", "replace"), (SENT * 2).encode("gb18030").decode("latin-1"), DE.encode().decode("cp1252"), DE.encode("cp1252").decode("cp1251"), SENT.encode().decode("mac_roman"), "ok � lost", DE.encode().decode("cp1252").encode().decode("cp1252")]


def test_mending(spark):
    good = [*corpus(), "", None, " ", "plain ascii", "© ® ™ § ¶ ±0,5 €", "£ 12 / ¥ 80 / € 9", "α → β ≤ γ", "🚀 ✅ ok", "├── a\n│   └── b", "Łódka, naïve, Ærø"]
    broken = bad()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + broken)], "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("whole", F.lit(1))
    got = {r["doc_id"]: (r["restored"], r["whole"]) for r in encoding.mend_texts(df).collect()}
    assert set(got) == {len(good) + i for i in range(len(broken))}
    n = len(good)
    assert got[n + 1][0] == SENT * 2 and got[n + 2] == (DE, True) and got[n + 3][0] == DE and got[n + 4][0] == SENT and not got[n + 5][1] and got[n + 6][0] == DE
    assert encoding.mend_texts(df.limit(0)).count() == 0


def first_fit_bound(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, b in enumerate(bins):
            if b >= s:
                bins[i] -= s
                break
        else:
            bins.append(cap - s)
    return len(bins)


def test_reduction_keeps_the_optimum_on_small_instances():
    rnd = random.Random(4)

    def best(sizes, cap):
        sizes = sorted(sizes, reverse=True)
        top = [len(sizes)]

        def go(i, bins):
            if len(bins) >= top[0]:
                return
            if i == len(sizes):
                top[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins) if b >= sizes[i]}.values():
                go(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
            go(i + 1, [*bins, cap - sizes[i]])

        go(0, [])
        return top[0]

    for _ in range(120):
        cap = rnd.randrange(8, 30)
        sizes = Counter(rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 9)))
        fixed, left = packing.reduce_dominated(sizes, cap)
        used = Counter()
        for items, n in fixed:
            assert sum(items) <= cap
            used.update({k: v * n for k, v in Counter(items).items()})
        assert used + Counter(left) == sizes
        assert sum(n for _, n in fixed) + best(list(Counter(left).elements()), cap) == best(list(sizes.elements()), cap)


def test_packing_keeps_every_token_whole(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([0, 1, 5, 40, 60, 99, 100, 101, 250, rnd.randrange(1, 100)])) for i in range(700)]
    df = spark.createDataFrame(items + items[:5], "doc_id bigint, tokens bigint").withColumn("rank", F.lit(1)).withColumn("size", F.lit("x"))
    got = packing.pack(df, 100, "k").collect()
    boxes, docs = Counter(), Counter()
    for r in got:
        boxes[r["container_id"]] += r["size"]
        docs[r["doc_id"]] += r["size"]
    assert max(boxes.values()) <= 100 and docs == Counter({i: n * (2 if i < 5 else 1) for i, n in items if n})
    assert Counter(r["doc_id"] for r in got if 100 >= dict(items)[r["doc_id"]]).most_common(1)[0][1] <= 2
    sizes = [r["size"] for r in got]
    assert len(boxes) <= first_fit_bound(sizes, 100) and sorted(boxes) == list(range(len(boxes)))
    assert packing.pack(df.limit(0), 100, "k").count() == 0


def test_temperature():
    p = {"a": 0.9, "b": 0.1, "c": 0.0}
    assert mixing.temper(p, 0)["a"] == 0.5 and mixing.temper(p, 1) == pytest.approx(p)
    x = mixing.bisect_entropy(p, 0.6)
    assert mixing.entropy(mixing.temper(p, x)) == pytest.approx(0.6, abs=1e-6)
    w, total, e = mixing.budget({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1})
    assert w == {"a": 0.5, "b": 0.5} and total == 400 and e == 1
    w, total, e = mixing.budget({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, total=800)
    assert 0 < e < 1 and w["a"] * 800 <= 200 + 1e-6 and w["a"] * 800 > 199
    assert mixing.budget({}, {"a": 1.0}, {"a": 1}) == ({}, 0.0, 1.0)


needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_mix_reaches_the_shares(spark):
    rnd = random.Random(3)
    rows = [(i, "word " * rnd.randrange(1, 30), s) for i, s in enumerate(rnd.choice(["A ", "b", "c", None, " ", "zz"]) for _ in range(3000))] + [(9000, None, "a"), (9001, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("x")).withColumn("block", F.lit(1))
    target = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("c", 0.1, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, target)
    s = {r["source"]: r for r in mixing.shares(got, target).collect()}
    assert {k: round(s[k]["share"], 2) for k in "abc"} == {"a": 0.6, "b": 0.3, "c": 0.1} and s["none"]["tokens"] == 0
    assert all(s[k]["most_uses"] <= s[k]["max_repeats"] for k in "abc")
    assert got.groupBy("doc_id", "use").count().where("count > 1").count() == 0
    per = got.groupBy("block").agg((F.sum(F.when(F.col("source") == "a", F.col("tokens"))) / F.sum("tokens")).alias("a")).agg(F.min("a"), F.max("a")).first()
    assert per[0] > 0.4 and per[1] < 0.8
    assert mixing.mix(docs.limit(0), target).count() == 0


@needs_vocabulary
def test_long_texts_are_counted_whole():
    from quarryline.llm.tokens import load

    count, enc = counter(), load()
    assert count(None) == count("") == 0
    for gap in (5000, 6001):
        for text in ("a" + " " * gap + "b", "\n" * gap, " " * gap + "支付", "支付\n" + "\u3000" * gap + "x  y" + " " * gap, "word " * 50_000):
            assert count(text) == len(enc.encode_ordinary(text))
    assert count(" " * 1_000_000 + "x") > 1 and count("x" * 1_000_000) > 1


@needs_vocabulary
def test_mix_tempers(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "a" if i < 20 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    target = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    whole = {r["source"]: r for r in mixing.shares(mixing.mix(docs, target, part=1.0), target).collect()}
    assert 0.05 < whole["a"]["share"] < 0.12 and whole["a"]["most_uses"] == 2 and whole["b"]["most_uses"] == 1
    even = {r["source"]: r["share"] for r in mixing.shares(mixing.mix(docs, target, entropy_at=0.9), target).collect()}
    assert mixing.entropy(even) == pytest.approx(0.9 * math.log(2), abs=0.03)


def test_reduction_fixes_pairs():
    sizes = {k: 3 for k in range(1, 101)}
    every, several = packing.fixed_containers(sizes, 100)
    assert every >= 100 and several >= 50


def test_republished_lines_are_no_boilerplate(spark):
    from quarryline.llm import repeated
    from tests.llm.test_pages import FETCH

    rows = []
    for i in range(40):
        own = f"Own text number {chr(65 + i % 26)}{chr(65 + i // 26)} of this page, which only stands here."
        rows.append((i, 1, True, f"https://s.example/{i}", None, ("Republished line in one article." if i % 2 else own) + "\nShare this page", None, None))
    df = spark.createDataFrame(rows, FETCH)
    df = df.drop("fetch_time").withColumn("fetch_time", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(fetch_id % 5 as int))"))
    plain = {(r["fetch_id"], r["line_no"]) for r in repeated.repeated_lines(df).collect()}
    strict = {(r["fetch_id"], r["line_no"]) for r in repeated.repeated_lines(df, min_clusters=10, min_days=3).collect()}
    assert {x for x in plain if x[1] == 1} and {x[1] for x in strict} == {2} and len(strict) == 40
    clean = {r["fetch_id"]: r["content"] for r in repeated.without_repeated(df, repeated.repeated_lines(df, min_clusters=10, min_days=3)).collect()}
    assert clean[1] == "Republished line in one article." and len(clean) == 40


def test_queries_have_found_names():
    assert {f"p{n}_found" for n in (2, 3, 5, 6, 7, 10)} <= set(queries.QUERIES)
