import random

from pyspark.sql import functions as F

from quarryline.operators import folders, hierarchy

FOLDER = "folder_id string, parent_id string, folder_name string, folder_path string, children array<string>, cache_time timestamp"


def brute(par):
    out = {}
    for k in par:
        chain, seen, x = [], set(), k
        while x is not None and x not in seen:
            seen.add(x)
            chain.append(x)
            x = par.get(x) if par.get(x) in par else None
        if x is None:
            out[k] = (chain[-1], len(chain), tuple(chain[::-1]), False)
        else:
            ring, y = [x], par[x]
            while y != x:
                ring.append(y)
                y = par[y]
            out[k] = (min(ring), None, None, True)
    return out


def test_random_forest_with_cycles_equals_brute_force(spark):
    rnd = random.Random(3)
    ids = [f"n{i:03d}" for i in range(160)]
    par = {k: (ids[rnd.randrange(i)] if i and rnd.random() < 0.9 else None) for i, k in enumerate(ids)}
    for a, b in (("n010", "n011"), ("n011", "n010"), ("n020", "n020"), ("n030", "n031"), ("n031", "n032"), ("n032", "n030")):
        par[a] = b
    par["n150"] = "gone"
    df = spark.createDataFrame([(k, p, k.upper(), 1) for k, p in par.items()], "id string, parent string, name string, level int")
    tree = hierarchy.build_hierarchy(df)
    got = {r["id"]: (r["root"], r["depth"], tuple(r["path_ids"]) if r["path_ids"] is not None else None, r["cyclic"]) for r in tree.collect()}
    want = brute(par)
    assert got == want
    sizes = {r["id"]: r["size"] for r in tree.where("not cyclic").collect()}
    below = {}
    for k, (_, _, path, cyc) in want.items():
        for a in path or ():
            below[a] = below.get(a, 0) + 1
    assert sizes == {k: below[k] for k in sizes}
    links = {(r["ancestor"], r["id"]) for r in hierarchy.descendants(tree).collect()}
    assert links == {(a, k) for k, (_, _, path, cyc) in want.items() if not cyc for a in path if a != k}


def test_descendants_on_and_below_cycles(spark):
    par = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "f": "e", "s": "s", "t": "s", "x": None, "y": "x"}
    df = spark.createDataFrame(list(par.items()), "id string, parent string").withColumn("name", F.col("id"))
    want = {}
    for k in par:
        up, n = par[k], 1
        while up is not None and n <= len(par):
            if up != k:
                want.setdefault((up, k), n)
            up, n = par[up], n + 1
    got = {(r["ancestor"], r["id"]): r["distance"] for r in hierarchy.all_descendants(hierarchy.build_hierarchy(df)).collect()}
    assert got == want


def test_chain_deeper_than_a_block_of_rounds(spark):
    df = spark.createDataFrame([(f"{i:02d}", f"{i - 1:02d}" if i else None, str(i)) for i in range(23)], "id string, parent string, name string")
    assert {r["id"]: r["depth"] for r in hierarchy.build_hierarchy(df, rounds=2).collect()} == {f"{i:02d}": i + 1 for i in range(23)}


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], FOLDER)
    assert folders.path_faults(folders.folder_tree(empty)).count() == 0
    nulls = spark.createDataFrame([(None,) * 6, ("a", None, None, None, None, None), ("a", None, None, None, None, None)], FOLDER)
    assert [tuple(r) for r in folders.path_faults(folders.folder_tree(nulls)).collect()] == []


def test_faults_ties_blanks_and_clashing_columns(spark):
    from datetime import datetime as dt

    rows = [
        ("a", " ", "A", " / A ", ["b", "gone", None], dt(2025, 1, 2)),
        ("a", "zz", "old", "/old", [], dt(2025, 1, 1)),
        ("b", None, "B", "/A/X", [], dt(2025, 1, 1)),
        ("c", "　b ", "C", "//A//B/C/", [], dt(2025, 1, 1)),
        ("c", "　b ", "C", "//A//B/C/", [], dt(2025, 1, 1)),
        ("d", "e", "D", None, [], dt(2025, 1, 1)),
        ("e", "d", "E", "/", [], dt(2025, 1, 1)),
        ("f", "e", "F", "/", [], dt(2025, 1, 1)),
        ("g", "nobody", "G", " / / ", [], None),
    ]
    df = spark.createDataFrame(rows, FOLDER).withColumn("parent", F.lit("x")).withColumn("by", F.lit(1)).withColumn("id", F.lit(2)).withColumn("level", F.lit(3))
    got = sorted(tuple(r) for r in folders.path_faults(folders.folder_tree(df)).collect())
    assert got == [("b", "a"), ("d", "d"), ("e", "d"), ("f", "d")]
