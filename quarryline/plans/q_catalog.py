"""Queries of links, the catalogue, plans and sheets and their SQL."""

from pyspark.sql import functions as F

from quarryline.functions import rules as R
from quarryline.operators import catalog as C
from quarryline.operators import folders, links, plans, shred, sheets

DOMAIN = "https://pad.cloud.example"


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _ruled(s, d):
    return links.with_site_rules(_t(s, d, "fetch_result").select("fetch_id", "url", "original_url", "title"), _t(s, d, "site_config"))


def link_kept(s, d):
    x = _ruled(s, d)
    return x.where(links.is_article(F.col("url"), F.col("link_patterns"), F.col("exclude_patterns"))).select("fetch_id", "site", "site_name")


def link_new(s, d):
    """Addresses of the later batches that no earlier batch has."""
    p = _t(s, d, "fetch_result").where("url is not null")
    mid = p.agg(F.floor(F.avg("batch_no"))).first()[0]
    old = p.where(F.col("batch_no") <= mid).select(F.substring(F.md5("url"), 1, 8).alias("url_hash")).distinct()
    return links.not_fetched(p.where(F.col("batch_no") > mid).select("fetch_id", "url"), old).select("fetch_id", "url_hash")


def docs_stale(s, d):
    x = C.distinct_docs(_t(s, d, "doc"))
    cached = x.where(F.col("ord") % 2 == 0).select(F.substring("obj_token", 1, 8).alias("short_id"), "edit_time")
    return C.stale_docs(x, cached).select("obj_token", "edit_time")


def _edges(s, d):
    return folders.folder_edges(folders.latest_folders(_t(s, d, "folder")))


def folder_counts(s, d):
    e = _edges(s, d).select("folder_id", "parent", "folder_name")
    return C.folder_counts(e, C.distinct_docs(_t(s, d, "doc"))).select("folder_id", "doc_count", "child_count")


def folder_totals(s, d):
    tree = folders.folder_tree(_t(s, d, "folder"))
    own = C.distinct_docs(_t(s, d, "doc")).where("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("doc_count"))
    return C.total_docs(tree, own)


def folder_docs(s, d):
    return C.flatten_docs(folders.folder_tree(_t(s, d, "folder")), C.distinct_docs(_t(s, d, "doc")).select("obj_token", "folder_id")).withColumn("depth", F.col("depth").cast("bigint"))


def name_hits(s, d):
    """Documents by name or by the path of their folder; those in no folder of the tree by name alone."""
    docs = C.distinct_docs(_t(s, d, "doc")).select("obj_token", "doc_name", "folder_id")
    paths = C.flatten_docs(folders.folder_tree(_t(s, d, "folder")), docs.select("obj_token", "folder_id")).select("obj_token", "folder_path")
    return C.search_names(docs.join(paths, "obj_token", "left"), "离线钱包")


_TASKS = [
    ("a", "1", None, [], None), ("a", "2", "pending", ["1"], None), ("a", "3", "pending", ["2", "1"], None),
    ("b", "1", "completed", [], None), ("b", "2", "running", ["1"], 50.0), ("b", "3", "pending", ["1"], None), ("b", "4", "pending", ["2"], None), ("b", "4", "failed", [], None),
]


def _tasks(s):
    return s.createDataFrame(_TASKS, "plan string, id string, status string, dependencies array<string>, progress double")


_CELLS = [("A1", '"x"'), ("B2", "5"), ("AA10", '{"value":0}'), ("R3C2", '{"text":{"content":"q"}}'), ("row_4_col_1", '{"text":" y "}'), ("??", "null"), ("C1", '{"text_data":{"10":"b","2":"a"}}')]


def _cells(s):
    return s.createDataFrame(_CELLS, "cell_key string, v string")


def sheet_dense(s, d):
    x = _cells(s).select(F.lit("k").alias("sheet"), sheets.cell_position(F.col("cell_key")).alias("p"), sheets.cell_value(F.col("v")).alias("text")).where("p is not null and p.row < 5 and p.col < 3").select("sheet", "p.row", "p.col", "text")
    return sheets.dense(x, "sheet").select("sheet", "row", F.array_join("cells", "|").alias("line"))


def block_sequence(s, d):
    """Each document's block ids in order of responses and sequence, the first place of an id counts."""
    r = _t(s, d, "block_response").where("code = 0 and doc_token is not null")
    x = r.select("doc_token", "ord", F.posexplode("block_sequence").alias("i", "block_id")).where("block_id is not null")
    return x.groupBy("doc_token", "block_id").agg(F.min(F.struct("ord", "i")).alias("p")).select("doc_token", "block_id", F.col("p.ord").cast("bigint").alias("ord"), F.col("p.i").cast("bigint").alias("place"))


QUERIES = {
    "link_site": lambda s, d: _ruled(s, d).groupBy("site", "site_name").agg(F.count("*").alias("n")),
    "link_kept": link_kept,
    "link_new": link_new,
    "link_hosts": lambda s, d: _t(s, d, "fetch_result").select(links.site(F.col("url")).alias("site")).groupBy("site").agg(F.count("*").alias("n")),
    "doc_distinct": lambda s, d: C.distinct_docs(_t(s, d, "doc")).select("obj_token", "folder_id", "doc_name", "url", "edit_time"),
    "doc_stale": docs_stale,
    "doc_kinds": lambda s, d: C.distinct_docs(_t(s, d, "doc")).select(R.item_kind(F.col("obj_token"), F.lit(0)).alias("kind"), F.substring("obj_token", 1, 3).alias("prefix")).groupBy("kind", "prefix").agg(F.count("*").alias("n")),
    "doc_urls": lambda s, d: C.distinct_docs(_t(s, d, "doc")).select("obj_token", R.item_url(F.col("obj_token"), F.col("url"), DOMAIN).alias("url")),
    "doc_url_parts": lambda s, d: C.distinct_docs(_t(s, d, "doc")).where("url is not null").select("obj_token", *[c.alias(k) for k, c in links.url_parts(F.col("url")).items()]),
    "doc_edit_times": lambda s, d: C.distinct_docs(_t(s, d, "doc")).select("obj_token", F.date_format(C.edit_instant(F.col("edit_time")), "yyyy-MM-dd HH:mm:ss").alias("edited")),
    "doc_name_hits": name_hits,
    "folder_counts": folder_counts,
    "folder_totals": folder_totals,
    "folder_docs": folder_docs,
    "folder_told_by": lambda s, d: C.parent_of_children(folders.latest_folders(_t(s, d, "folder"))),
    "folder_trash": lambda s, d: folders.latest_folders(_t(s, d, "folder")).where(~R.any_of(F.lower("folder_name"), R.TRASH)).groupBy().agg(F.count("*").alias("n")),
    "task_ready": lambda s, d: plans.ready(_tasks(s)),
    "task_progress": lambda s, d: plans.progress(_tasks(s)),
    "task_faults": lambda s, d: plans.faults(_tasks(s), s.createDataFrame([("b", [["1", "9"], ["2"]])], "plan string, parallel_groups array<array<string>>")),
    "user_idle": lambda s, d: _t(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("m")).crossJoin(_t(s, d, "events").agg(F.max("ts").alias("t"))).select("user_id", F.floor(F.timestamp_diff("SECOND", "m", "t") / 60).cast("bigint").alias("idle")).select("user_id", "idle", plans.idle_level(F.col("idle"), F.lit(0)).alias("level")),
    "cell_positions": lambda s, d: _cells(s).select("cell_key", sheets.cell_position(F.col("cell_key")).alias("p"), sheets.cell_value(F.col("v")).alias("text")).select("cell_key", "p.row", "p.col", "text"),
    "sheet_dense": sheet_dense,
    "block_sequence": block_sequence,
    "block_titles": lambda s, d: shred.meta_tables(_t(s, d, "block_response"))["document"].select("doc_token", "title"),
}

_LATEST = """WITH latest AS (SELECT folder_id, any_value(parent_id) parent_id, any_value(folder_name) folder_name, any_value(children) children
  FROM (SELECT *, rank() OVER (PARTITION BY folder_id ORDER BY cache_time DESC) rk FROM folder) WHERE rk = 1 GROUP BY folder_id),
told AS (SELECT folder_id, min(by_id) by_id FROM (SELECT unnest(children) folder_id, folder_id by_id FROM latest) GROUP BY 1),
e0 AS (SELECT l.folder_id, coalesce(nullif(trim(l.parent_id), ''), t.by_id) parent, folder_name FROM latest l LEFT JOIN told t ON t.folder_id = l.folder_id)
"""
_DOC = """dd AS (SELECT obj_token, folder_id, doc_name, url, edit_time, ord FROM (SELECT *, row_number() OVER (PARTITION BY obj_token
  ORDER BY coalesce(folder_id, chr(65535)), coalesce(ord, 2147483647), doc_name NULLS FIRST, url NULLS FIRST, edit_time NULLS FIRST) rn FROM doc WHERE obj_token IS NOT NULL) WHERE rn = 1)"""
_SITE = r"nullif(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^(www\.|m\.)', ''), '')"
_TASK_SQL = "t(plan, id, status, dependencies, progress) AS (VALUES ('a','1',NULL,[]::VARCHAR[],NULL),('a','2','pending',['1'],NULL),('a','3','pending',['2','1'],NULL),('b','1','completed',[],NULL),('b','2','running',['1'],50.0),('b','3','pending',['1'],NULL),('b','4','pending',['2'],NULL),('b','4','failed',[],NULL))"
_TREE = _LATEST.replace("WITH latest", "WITH RECURSIVE latest") + """, edges AS (SELECT e.folder_id, CASE WHEN p.folder_id IS NULL THEN NULL ELSE e.parent END parent, e.folder_name FROM e0 e LEFT JOIN e0 p ON e.parent = p.folder_id),
tree AS (SELECT folder_id, [folder_name] path, [folder_id] ids FROM edges WHERE parent IS NULL UNION ALL
  SELECT e.folder_id, list_append(t.path, e.folder_name), list_append(t.ids, e.folder_id) FROM edges e JOIN tree t ON e.parent = t.folder_id), """

SQL = {
    "link_site": f"WITH p AS (SELECT {_SITE} AS site FROM fetch_result) SELECT site, coalesce(site_name, regexp_extract(site, '^([^.]+)', 1)) AS site_name, count(*) AS n FROM p LEFT JOIN site_config ON site = lower(site_host) GROUP BY 1, 2",
    "link_kept": f"""WITH p AS (SELECT fetch_id, url, {_SITE} AS site FROM fetch_result), j AS (SELECT p.*, coalesce(site_name, regexp_extract(site, '^([^.]+)', 1)) AS site_name, link_patterns, exclude_patterns FROM p LEFT JOIN site_config ON site = lower(site_host))
SELECT fetch_id, site, site_name FROM j WHERE regexp_matches(url, '^https?://') AND NOT coalesce(len(list_filter(exclude_patterns, lambda x: regexp_matches(url, x))) > 0, false)
AND (coalesce(len(link_patterns), 0) = 0 OR len(list_filter(link_patterns, lambda x: regexp_matches(url, x))) > 0)""",
    "link_new": """WITH p AS (SELECT * FROM fetch_result WHERE url IS NOT NULL), m AS (SELECT floor(avg(batch_no)) AS mid FROM p)
SELECT fetch_id, substr(md5(url), 1, 8) AS url_hash FROM p, m WHERE batch_no > mid AND substr(md5(url), 1, 8) NOT IN (SELECT substr(md5(url), 1, 8) FROM p, m WHERE batch_no <= mid)""",
    "link_hosts": f"SELECT {_SITE} AS site, count(*) AS n FROM fetch_result GROUP BY 1",
    "doc_distinct": f"WITH {_DOC} SELECT obj_token, folder_id, doc_name, url, edit_time FROM dd",
    "doc_stale": f"WITH {_DOC}, c AS (SELECT DISTINCT substr(obj_token, 1, 8) s, edit_time e FROM dd WHERE ord % 2 = 0 AND edit_time IS NOT NULL) SELECT obj_token, edit_time FROM dd WHERE NOT EXISTS (SELECT 1 FROM c WHERE s = substr(obj_token, 1, 8) AND e = edit_time)",
    "doc_kinds": f"WITH {_DOC} SELECT CASE WHEN substr(obj_token, 1, 3) IN ('doc', 'dox', 'box', 'sht', 'wik') THEN 'doc' ELSE 'folder' END AS kind, substr(obj_token, 1, 3) AS prefix, count(*) AS n FROM dd GROUP BY 1, 2",
    "doc_urls": f"""WITH {_DOC} SELECT obj_token, CASE WHEN starts_with(coalesce(url, ''), 'http') THEN url WHEN starts_with(url, '/') THEN '{DOMAIN}' || url WHEN regexp_matches(url, '^(file|docx|sheets?|wiki)/') THEN '{DOMAIN}/' || url
ELSE '{DOMAIN}' || CASE substr(obj_token, 1, 3) WHEN 'sht' THEN '/sheets/' WHEN 'box' THEN '/file/' WHEN 'wik' THEN '/wiki/' ELSE '/docx/' END || obj_token END AS url FROM dd""",
    "doc_edit_times": f"""WITH {_DOC} SELECT obj_token, strftime(CASE WHEN regexp_matches(edit_time, '^\\d{{13}}$') THEN make_timestamp(CAST(edit_time AS BIGINT) * 1000) WHEN regexp_matches(edit_time, '^\\d{{1,12}}$') THEN make_timestamp(CAST(edit_time AS BIGINT) * 1000000)
ELSE try_strptime(substr(replace(edit_time, 'T', ' '), 1, 16), '%Y-%m-%d %H:%M') END, '%Y-%m-%d %H:%M:%S') AS edited FROM dd""",
    "doc_name_hits": _TREE
    + f"""{_DOC}, x AS (SELECT obj_token, lower(coalesce(doc_name, '')) n, lower(coalesce('/' || array_to_string(path, '/'), '')) p FROM dd LEFT JOIN tree t ON t.folder_id = dd.folder_id),
y AS (SELECT obj_token, CASE WHEN n = '离线钱包' THEN 1.0 WHEN contains(n, '离线钱包') THEN 0.8 WHEN contains(p, '离线钱包') THEN 0.5
ELSE round((contains(n, '离')::INT + contains(n, '线')::INT + contains(n, '钱')::INT + contains(n, '包')::INT) / 4.0 * 0.3, 6) END::DOUBLE AS score FROM x) SELECT * FROM y WHERE score >= 0.3""",
    "folder_counts": _LATEST
    + f""", {_DOC}, o AS (SELECT folder_id, count(*) n FROM dd WHERE folder_id IS NOT NULL GROUP BY 1), k AS (SELECT parent, count(*) n FROM e0 WHERE parent IS NOT NULL GROUP BY 1)
SELECT e0.folder_id, coalesce(o.n, 0) AS doc_count, coalesce(k.n, 0) AS child_count FROM e0 LEFT JOIN o ON o.folder_id = e0.folder_id LEFT JOIN k ON k.parent = e0.folder_id""",
    "folder_totals": _TREE + f"{_DOC}, o AS (SELECT folder_id, count(*) n FROM dd WHERE folder_id IS NOT NULL GROUP BY 1) SELECT a AS folder_id, CAST(sum(n) AS BIGINT) AS total FROM (SELECT folder_id, unnest(ids) a FROM tree) t JOIN o ON o.folder_id = t.folder_id GROUP BY 1",
    "folder_docs": _TREE + f"{_DOC} SELECT obj_token, dd.folder_id, '/' || array_to_string(path, '/') AS folder_path, len(ids) AS depth FROM dd JOIN tree t ON t.folder_id = dd.folder_id",
    "folder_told_by": _LATEST + "SELECT folder_id, by_id AS told_by FROM told",
    "folder_trash": _LATEST + "SELECT count(*) AS n FROM latest WHERE NOT coalesce(contains(lower(folder_name), '回收站') OR contains(lower(folder_name), 'trash') OR contains(lower(folder_name), '已删除'), false)",
    "task_ready": f"WITH {_TASK_SQL} SELECT plan, id FROM t WHERE coalesce(status, 'pending') = 'pending' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(t.dependencies) d) q WHERE d NOT IN (SELECT id FROM t u WHERE u.plan = t.plan AND u.status = 'completed'))",
    "task_progress": f"""WITH {_TASK_SQL}, x AS (SELECT plan, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(sum(progress / 100) FILTER (WHERE status = 'running'), 0)::DOUBLE AS run FROM t GROUP BY 1)
SELECT plan, total, completed, running, failed, total - completed - running - failed AS pending, round((completed + run) / total * 100, 1) AS pct, CASE WHEN completed > 0 THEN CAST(floor((total - completed - run) * 180) AS BIGINT) END AS eta_s FROM x""",
    "task_faults": f"WITH {_TASK_SQL} SELECT plan, 'duplicate id' AS fault, id AS item FROM t GROUP BY plan, id HAVING count(*) > 1 UNION ALL SELECT 'b', 'unknown in group', '9'",
    "user_idle": "WITH u AS (SELECT user_id, CAST(floor(date_sub('second', max(ts), (SELECT max(ts) FROM events)) / 60) AS BIGINT) AS idle FROM events GROUP BY 1) SELECT user_id, idle, CASE WHEN idle > 120 THEN 'stuck' WHEN idle > 60 THEN 'critical' WHEN idle > 30 THEN 'warning' ELSE 'healthy' END AS level FROM u",
    "cell_positions": "SELECT * FROM (VALUES ('A1', 0, 0, 'x'), ('B2', 1, 1, '5'), ('AA10', 9, 26, ''), ('R3C2', 2, 1, 'q'), ('row_4_col_1', 4, 1, 'y'), ('??', NULL, NULL, 'null'), ('C1', 0, 2, 'ba')) v(cell_key, row, col, text)".replace("0, 0, 'x'", "0::BIGINT, 0::BIGINT, 'x'"),
    "sheet_dense": "SELECT * FROM (VALUES ('k', 0::BIGINT, 'x||ba'), ('k', 1, '|5|'), ('k', 2, '|q|'), ('k', 4, '|y|')) v(sheet, row, line)",
    "block_sequence": """SELECT doc_token, block_id, CAST(ord AS BIGINT) AS ord, CAST(place AS BIGINT) AS place FROM (SELECT doc_token, block_id, ord, place, row_number() OVER (PARTITION BY doc_token, block_id ORDER BY ord, place) rn
FROM (SELECT doc_token, ord, unnest(block_sequence) block_id, generate_subscripts(block_sequence, 1) - 1 place FROM block_response WHERE code = 0 AND doc_token IS NOT NULL) WHERE block_id IS NOT NULL) WHERE rn = 1""",
}
