"""Queries of the core operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import folders, hierarchy, shred
from quarryline.plans import q_catalog, q_misc, q_search, q_usage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return folders.path_faults(folders.folder_tree(_t(spark, d, "folder")))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(folders.folder_tree(_t(spark, d, "folder"))).selectExpr("ancestor", "id", "cast(distance as bigint) distance")


def p1_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(folders.folder_tree(_t(spark, d, "folder"))).selectExpr("ancestor", "id", "cast(distance as bigint) distance")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.block_links(_t(spark, d, "block_response"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return shred.block_tables(_t(spark, d, "block_response"))["block"].select("doc_token", "block_id", F.col("ord").cast("bigint").alias("ord"), "version", F.col("data_type").alias("kind"), F.col("data_parent_id").alias("parent_id"))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    t = shred.block_tables(_t(spark, d, "block_response"))["block_data_cell_set"]
    return t.select("doc_token", F.col("block_id").alias("table_id"), F.col("data_cell_set_key").alias("cell_key"), F.col("merge_info_row_span").alias("row_span"), F.col("merge_info_col_span").alias("col_span"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return shred.text_pieces(_t(spark, d, "block_response")).withColumn("piece_no", F.col("piece_no").cast("bigint"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    t = shred.meta_tables(_t(spark, d, "block_response"))["document_members"]
    return t.select("doc_token", F.col("members_pos").cast("bigint").alias("member_no"), "open_id", F.col("perm_edit").alias("can_edit"))


_P4_CTE = """
WITH b0 AS (SELECT doc_token, ord, captured_at, block_map::VARCHAR bm, unnest(json_keys(block_map::JSON)) block_id FROM block_response WHERE code = 0 AND doc_token IS NOT NULL AND block_map IS NOT NULL),
b1 AS (SELECT doc_token, ord, captured_at, block_id, json_extract(bm, '$."' || block_id || '"') v FROM b0),
b AS (SELECT doc_token, block_id, ord, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_token, block_id ORDER BY ord, captured_at, v::VARCHAR) rn FROM b1 WHERE json_type(v) <> 'NULL') WHERE rn = 1)
"""

_P1_CTE = """
WITH RECURSIVE latest AS (
  SELECT folder_id, any_value(parent_id) parent_id, any_value(folder_name) folder_name, any_value(folder_path) folder_path, any_value(children) children
  FROM (SELECT *, rank() OVER (PARTITION BY folder_id ORDER BY cache_time DESC) rk FROM folder) WHERE rk = 1 GROUP BY folder_id),
told AS (SELECT trim(c) folder_id, min(folder_id) by_id FROM (SELECT folder_id, unnest(children) c FROM latest) GROUP BY 1),
e0 AS (SELECT l.folder_id, coalesce(nullif(trim(l.parent_id), ''), t.by_id) parent, folder_name, folder_path FROM latest l LEFT JOIN told t USING (folder_id)),
edges AS (SELECT e.folder_id, CASE WHEN p.folder_id IS NULL THEN NULL ELSE e.parent END parent, e.folder_name, e.folder_path FROM e0 e LEFT JOIN e0 p ON e.parent = p.folder_id),
tree AS (
  SELECT folder_id, folder_id root_id, [folder_name] path, [folder_id] ids, folder_path FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.folder_id, t.root_id, list_append(t.path, e.folder_name), list_append(t.ids, e.folder_id), e.folder_path FROM edges e JOIN tree t ON e.parent = t.folder_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_descendants": p1_descendants,
    "p1_descendants_all": p1_descendants_all,
    "p4_found": p4_found,
    "p4_blocks": p4_blocks,
    "p4_cells": p4_cells,
    "p4_text": p4_text,
    "p4_members": p4_members,
}

SQL: dict[str, str] = {
    "p4_blocks": _P4_CTE
    + """SELECT doc_token, block_id, ord::BIGINT AS ord, CAST(v->>'$.version' AS BIGINT) AS version, v->>'$.data.type' AS kind, v->>'$.data.parent_id' AS parent_id FROM b""",
    "p4_cells": _P4_CTE
    + """, c AS (SELECT doc_token, block_id table_id, v, unnest(json_keys(v, '$.data.cell_set')) cell_key FROM b WHERE json_type(v, '$.data.cell_set') = 'OBJECT')
SELECT doc_token, table_id, cell_key, CAST(v->'$.data.cell_set'->cell_key->>'$.merge_info.row_span' AS BIGINT) AS row_span, CAST(v->'$.data.cell_set'->cell_key->>'$.merge_info.col_span' AS BIGINT) AS col_span FROM c""",
    "p4_found": _P4_CTE
    + """, l AS (
SELECT doc_token, v->>'$.data.parent_id' p, block_id c FROM b
UNION SELECT doc_token, block_id, unnest(json_extract_string(v, '$.data.children[*]')) FROM b
UNION SELECT doc_token, block_id, unnest(json_extract_string(v, '$.data.cell_set.*.block_id')) FROM b
UNION SELECT doc_token, block_id, unnest(json_extract_string(v, '$.data.cells[*][*]')) FROM b)
SELECT DISTINCT l.doc_token, l.p AS parent_block_id, l.c AS block_id FROM l
JOIN b x ON x.doc_token = l.doc_token AND x.block_id = l.p JOIN b y ON y.doc_token = l.doc_token AND y.block_id = l.c WHERE l.p <> l.c""",
    "p1_descendants": _P1_CTE
    + """SELECT a.anc AS ancestor, a.folder_id AS id, a.depth - a.pos AS distance FROM (
  SELECT folder_id, len(ids) depth, unnest(ids) anc, generate_subscripts(ids, 1) pos FROM tree) a WHERE a.anc <> a.folder_id""",
    "p1_descendants_all": _P1_CTE
    + """, cyc AS (SELECT folder_id, parent FROM edges WHERE folder_id NOT IN (SELECT folder_id FROM tree)),
walk AS (SELECT folder_id, parent, 1 n FROM cyc UNION ALL SELECT w.folder_id, c.parent, n + 1 FROM walk w JOIN cyc c ON w.parent = c.folder_id WHERE n < 150)
SELECT a.anc AS ancestor, a.folder_id AS id, a.depth - a.pos AS distance FROM (
  SELECT folder_id, len(ids) depth, unnest(ids) anc, generate_subscripts(ids, 1) pos FROM tree) a WHERE a.anc <> a.folder_id
UNION ALL SELECT parent, folder_id, min(n)::BIGINT FROM walk WHERE parent <> folder_id GROUP BY ALL""",
    "p1_found": _P1_CTE
    + """, cyc AS (SELECT folder_id, parent FROM edges WHERE folder_id NOT IN (SELECT folder_id FROM tree)),
walk AS (SELECT folder_id, parent, 0 n FROM cyc UNION ALL SELECT w.folder_id, c.parent, n + 1 FROM walk w JOIN cyc c ON w.parent = c.folder_id WHERE n < 300)
SELECT folder_id, min(parent) root_id FROM walk WHERE n >= 150 GROUP BY folder_id
UNION ALL
SELECT folder_id, root_id FROM (SELECT *, list_filter(list_transform(string_split(folder_path, '/'), lambda x: trim(x)), lambda x: x <> '') pc FROM tree)
WHERE folder_path IS NOT NULL AND len(pc) > 0 AND pc <> path""",
}

for _m in (q_usage, q_search, q_catalog, q_misc):
    QUERIES.update(_m.QUERIES)
    SQL.update(_m.SQL)
