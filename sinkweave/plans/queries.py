"""Registered queries over the driver's tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import extract, link, paths, render, report, tools, traces, validate
from ..sources.catalog import ENTRY_FILES, EXTENSIONS, catalog_frame
from ..sources.scan import file_lines
from . import sources
from . import tables as tb

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


# --- scans, scalars, tools --------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT event_type || ' ? . ' || props AS raw, replace(replace(regexp_replace(event_type || ' ?. ' || props || '::x', '\s+', '', 'g'), '?.', '.'), '::', '.') AS callee FROM events""")
def normalize_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "events")
    return e.select(F.concat_ws("", "event_type", F.lit(" ? . "), "props").alias("raw"), sc.normalize_callee(F.concat("event_type", F.lit(" ?. "), "props", F.lit("::x"))).alias("callee")).distinct()


@query(_with(tb.SRC_FILES) + r"""SELECT path, translate(regexp_replace(path, '\.[^./\\]*$', ''), '/\', '..') AS module, translate(regexp_replace(path, '\.[^./\\]*$', ''), '/\', '..') || '.Main.' || lang AS uid,
  lang AS last_part, translate(regexp_replace(path, '\.[^./\\]*$', ''), '/\', '..') || '.Main' AS scope FROM src""")
def module_id_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tb.src_files(spark, sf_dir)
    uid = sc.def_uid(sc.module_id(F.col("path")), F.array(F.lit("Main")), F.col("lang"))
    return f.select("path", sc.module_id(F.col("path")).alias("module"), uid.alias("uid"), sc.last_segment(uid).alias("last_part"), sc.parent_scope(uid).alias("scope"))


@query(_with(tb.SRC_FILES) + "SELECT lang, count(*) AS n_files FROM src GROUP BY lang")
def lang_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.languages(tb.src_files(spark, sf_dir))


@query(_with(tb.SRC_FILES) + f"SELECT path, m[lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1))] AS language FROM src, (SELECT MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in EXTENSIONS.items())}}} AS m)")
def file_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.scan import language_of

    return tb.src_files(spark, sf_dir).select("path", language_of(F.col("path")).alias("language"))


@query(_with(tb.SRC_LINES) + "SELECT path, line, left(trim(code), 120) AS code FROM lines WHERE regexp_matches(code, '(?i)licen[cs]e|token\\s*=')")
def line_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.grep(tb.src_files(spark, sf_dir), r"licen[cs]e|token\s*=")


@query(_with(tb.SRC_LINES) + "SELECT path, line, left(trim(code), 120) AS code FROM lines WHERE regexp_matches(code, '(?i)license') ORDER BY path, line LIMIT 50")
def grep_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.grep(tb.src_files(spark, sf_dir), "license", most=50)


@query(_with(tb.SRC_FILES) + "SELECT path FROM src WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^1.*\\.PY$')")
def grep_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.grep_names(tb.src_files(spark, sf_dir), r"^1.*\.PY$")


@query(_with(tb.SRC_LINES) + "SELECT path, line, code FROM lines WHERE path = (SELECT path FROM src WHERE path LIKE '%/10.%') AND line BETWEEN 2 AND 200")
def read_lines_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tb.src_files(spark, sf_dir).where(F.col("path").rlike("/10[.]"))
    return file_lines(files).where(F.col("line").between(2, 200)).select("path", "line", "code")


@query(_with(tb.SRC_FILES) + "SELECT dir, count(*) AS n, array_to_string(list_sort(list(name))[1:80], ', ') AS names FROM (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name FROM src) GROUP BY dir")
def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.list_dir(tb.src_files(spark, sf_dir))


@query(_with(tb.SRC_LINES) + "SELECT src.path, lang, length(text) AS n_chars, coalesce(n, 0) AS n_lines, text = '' AS is_empty FROM src LEFT JOIN (SELECT path, count(*) AS n FROM lines GROUP BY path) c ON c.path = src.path")
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.file_info(tb.src_files(spark, sf_dir))


@query(r"SELECT page_id, callee, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '\b([A-Za-z_]\w*)\(\d', 1)) AS callee FROM pages) GROUP BY ALL")
def call_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"\b([A-Za-z_]\w*)\(\d"), F.lit(1))).alias("callee")).groupBy("page_id", "callee").agg(F.count("*").alias("n"))


_PHP = "CASE doc_id % 4 WHEN 0 THEN '$_GET[x] ' WHEN 1 THEN 'php://input ' WHEN 2 THEN '/* $_POST */ require_once a; // include b' || chr(10) ELSE '' END || text || ' # tail'"


def _php(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.expr(_PHP.replace("chr(10)", "char(10)")).alias("code"))


@query(f"SELECT doc_id, regexp_matches(code, {_q(sc.PHP_SOURCE)}) AS is_source FROM (SELECT doc_id, {_PHP} AS code FROM documents)")
def php_source_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _php(spark, sf_dir).select("doc_id", sc.is_php_source(F.col("code")).alias("is_source"))


@query(f"""SELECT doc_id, md5(stripped) AS stripped, array_to_string(list_transform(regexp_extract_all(stripped, {_q(sc.INCLUDE)}, 1), lambda x: lower(x)), ',') AS includes
  FROM (SELECT doc_id, regexp_replace(regexp_replace(code, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)(//[^\\n]*|#[^\\n]*)$', '', 'g') AS stripped FROM (SELECT doc_id, {_PHP} AS code FROM documents))""")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _php(spark, sf_dir).select("doc_id", sc.strip_php_comments(F.col("code")).alias("s"))
    return s.select("doc_id", F.md5("s").alias("stripped"), F.array_join(sc.include_keywords(F.col("s")), ",").alias("includes"))


@query(_with(tb.SRC_LINES) + "SELECT path, string_agg(code, chr(10) ORDER BY line) AS code FROM lines WHERE line BETWEEN 2 AND 4 GROUP BY path")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.src_files(spark, sf_dir).select("path", sc.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("code")).where("code IS NOT NULL")


@query(_with(tb.SRC_LINES) + "SELECT path, string_agg(code, chr(10) ORDER BY line) AS code FROM lines WHERE line BETWEEN 3 - 2 AND 3 + 2 GROUP BY path")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.src_files(spark, sf_dir).select("path", sc.context(F.col("text"), F.lit(3), 2).alias("code")).where("code IS NOT NULL")


@query(r"SELECT c_name AS name, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(' ' || c_name || '__' || c_mktsegment || ' ')), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'reports') AS bucket FROM customer UNION ALL SELECT '###', 'reports'")
def bucket_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.table(spark, sf_dir, "customer").select("c_name", F.concat(F.lit(" "), "c_name", F.lit("__"), "c_mktsegment", F.lit(" ")).alias("raw"))
    c = c.unionByName(spark.range(1).select(F.lit("###").alias("c_name"), F.lit("###").alias("raw")))
    return c.select(F.col("c_name").alias("name"), sc.bucket_name(F.col("raw")).alias("bucket"))


@query(_with(tb.SRC_FILES) + "SELECT path, lang = 'en' AND regexp_matches(path, '(^|/)(.*/)?[^/]*1\\.py$') AS is_match FROM src")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"file_patterns": [{"pattern": "**/*1.py", "language": "en"}]}
    return tb.src_files(spark, sf_dir).select("path", validate.file_match(F.col("path"), F.col("lang"), config).alias("is_match"))


@query("SELECT p_partkey, lower(p_name || '.py') AS path, p_name IN ('app', 'main') OR (p_size % 10 = 0) AS is_entry FROM part")
def web_entry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.table(spark, sf_dir, "part").withColumn("path", F.lower(F.concat("p_name", F.lit(".py"))))
    shown = F.when(F.col("p_size") % 10 == 0, F.lit("web/App.py")).otherwise(F.col("path"))
    return p.select("p_partkey", "path", sc.entry_file(F.lit("python"), shown, ENTRY_FILES).alias("is_entry"))


# --- linking and aggregation ------------------------------------------------------------------------------------


@query(_with(tb.CALL_NODES) + """SELECT uid, arg_min(name, ordinal) AS name, coalesce(min(CASE WHEN line > 0 THEN line END), 0)::INTEGER AS line, max(end_line)::INTEGER AS end_line, bool_or(is_source) AS is_source, arg_min(lang, ordinal) AS lang, min(ordinal)::BIGINT AS ordinal FROM cn GROUP BY uid""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.merge_nodes(tb.call_nodes(spark, sf_dir)).select("uid", "name", "line", "end_line", "is_source", "lang", "ordinal")


@query(_with(tb.ORDER_SITES) + "SELECT src_uid, dst_uid, count(*) AS n_sites, count(DISTINCT file || ':' || line) AS n_distinct FROM sites GROUP BY src_uid, dst_uid")
def edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.sites_by_edge(tb.order_sites(spark, sf_dir))


@query(_with(tb.ORDER_SITES) + "SELECT src_uid, dst_uid FROM edges")
def edge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.edges_of(tb.order_sites(spark, sf_dir))


_CATALOG = "cat(lang, sink) AS (VALUES " + ", ".join(f"({k!r}, {s!r})" for k, v in tb.CATALOG.items() for s in v) + ")"
_SINKS = _with(tb.CALL_EDGES, _CATALOG) + "SELECT ordinal, callee, lang, EXISTS (SELECT 1 FROM cat WHERE cat.lang = ce.lang AND (ce.callee = sink OR ends_with(ce.callee, '.' || sink))) AS is_sink FROM ce"


@query(_SINKS)
def sink_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.call_edges(spark, sf_dir).withColumn("callee", sc.normalize_callee(F.col("callee")))
    return link.classify_sinks(e, catalog_frame(spark, tb.CATALOG)).select("ordinal", "callee", "lang", "is_sink")


@query(_SINKS)
def sink_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.call_edges(spark, sf_dir).withColumn("callee", sc.normalize_callee(F.col("callee")))
    return e.select("ordinal", "callee", "lang", link.is_sink_in(F.col("lang"), F.col("callee"), tb.CATALOG).alias("is_sink"))


_LINK = _with(tb.CALL_NODES, tb.CALL_EDGES, _CATALOG, """r AS (
  SELECT ce.*, EXISTS (SELECT 1 FROM cat WHERE cat.lang = ce.lang AND (ce.callee = sink OR ends_with(ce.callee, '.' || sink))) AS is_sink, l.uid AS local_uid, n.uid AS named
  FROM ce LEFT JOIN (SELECT DISTINCT uid FROM cn) l ON NOT contains(ce.callee, '.') AND l.uid = regexp_replace(ce.src, '\\.[^.]*$', '') || '.' || ce.callee
  LEFT JOIN (SELECT lang, name, arg_min(uid, ordinal) AS uid FROM cn GROUP BY lang, name) n ON n.lang = ce.lang AND n.name = regexp_extract(ce.callee, '[^.]*$'))""",
  """d AS (SELECT *, CASE WHEN is_sink THEN 'sink' WHEN local_uid IS NOT NULL THEN 'local' WHEN named IS NOT NULL THEN 'name' ELSE 'ext' END AS found,
  CASE WHEN is_sink THEN 'builtin.' || lang || '.' || callee ELSE coalesce(local_uid, named, 'ext.' || lang || '.' || callee) END AS dst_uid FROM r)""")


@query(_LINK + "SELECT ordinal, src, found, dst_uid FROM d")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link.resolve(tb.call_nodes(spark, sf_dir), tb.call_edges(spark, sf_dir), catalog_frame(spark, tb.CATALOG))
    return out.select("ordinal", "src", "found", "dst_uid")


_TWO = _with(tb.CALL_NODES, tb.CALL_EDGES, _CATALOG,
  "n2 AS (SELECT 'repo' || (ordinal % 2) AS repo, 'repo' || (ordinal % 2) || '//' || uid AS uid, name, lang, ordinal, is_source FROM cn UNION ALL SELECT 'repo0', 'repo0//' || uid, name, lang, ordinal + 20000000, is_source FROM cn WHERE ordinal % 6 = 1)",
  "e2 AS (SELECT 'repo' || (ordinal % 3) AS repo, 'repo' || (ordinal % 3) || '//' || src AS src, callee, lang, ordinal FROM ce)", """r2 AS (
  SELECT e.*, EXISTS (SELECT 1 FROM cat WHERE cat.lang = e.lang AND (e.callee = sink OR ends_with(e.callee, '.' || sink))) AS is_sink, l.uid AS local_uid, n.uid AS named
  FROM e2 e LEFT JOIN (SELECT DISTINCT uid FROM n2) l ON NOT contains(e.callee, '.') AND l.uid = regexp_replace(e.src, '\\.[^.]*$', '') || '.' || e.callee
  LEFT JOIN (SELECT repo, lang, name, arg_min(uid, ordinal) AS uid FROM n2 GROUP BY repo, lang, name) n ON n.repo = e.repo AND n.lang = e.lang AND n.name = regexp_extract(e.callee, '[^.]*$'))""",
  """d2 AS (SELECT *, CASE WHEN is_sink THEN 'sink' WHEN local_uid IS NOT NULL THEN 'local' WHEN named IS NOT NULL THEN 'name' ELSE 'ext' END AS found,
  CASE WHEN is_sink THEN repo || '//builtin.' || lang || '.' || callee ELSE coalesce(local_uid, named, repo || '//ext.' || lang || '.' || callee) END AS dst FROM r2)""")


def _two_repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two repositories that share uids, names and callees, and a third of calls alone."""
    cn, ce = tb.call_nodes(spark, sf_dir), tb.call_edges(spark, sf_dir)
    repo = lambda n: F.concat(F.lit("repo"), (F.col("ordinal") % n).cast("string"))
    both = cn.withColumn("repo", repo(2)).unionByName(cn.where("ordinal % 6 = 1").withColumns({"repo": F.lit("repo0"), "ordinal": F.col("ordinal") + 20_000_000}))
    return link.qualified(both, "uid"), link.qualified(ce.withColumn("repo", repo(3)), "src"), catalog_frame(spark, tb.CATALOG)


@query(_TWO + "SELECT ordinal, repo, src, found, dst AS dst_uid FROM d2")
def link_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's calls find that repository's functions only."""
    return link.resolve(*_two_repositories(spark, sf_dir)).select("ordinal", "repo", "src", "found", "dst_uid")


@query(_TWO + """SELECT repo, uid, bool_or(is_source) AS is_source, bool_or(is_sink) AS is_sink FROM (
  SELECT repo, uid, is_source, false AS is_sink FROM n2 UNION ALL SELECT repo, src, false, false FROM d2 UNION ALL SELECT repo, dst, false, found = 'sink' FROM d2) GROUP BY repo, uid""")
def repository_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, one graph a repository: those of one name in two repositories stay two."""
    return link.link(*_two_repositories(spark, sf_dir))[0].select("repo", "uid", "is_source", "is_sink")


@query(_LINK + """SELECT uid, bool_or(is_sink) AS is_sink, bool_or(is_builtin) AS is_builtin FROM (
  SELECT uid, false AS is_sink, false AS is_builtin FROM cn UNION ALL SELECT src, false, false FROM d UNION ALL SELECT dst_uid, found = 'sink', found = 'sink' FROM d) GROUP BY uid""")
def linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = link.link(tb.call_nodes(spark, sf_dir), tb.call_edges(spark, sf_dir), catalog_frame(spark, tb.CATALOG))
    return nodes.select("uid", "is_sink", "is_builtin")


@query(_LINK + "SELECT ordinal, src, found, dst_uid FROM d SEMI JOIN (SELECT uid FROM cn UNION SELECT 'ord.' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0) k ON k.uid = d.src")
def link_known_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tb.call_nodes(spark, sf_dir).select("uid").union(tb.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("ord."), F.col("o_orderkey").cast("string"))))
    out = link.resolve(tb.call_nodes(spark, sf_dir), tb.call_edges(spark, sf_dir), catalog_frame(spark, tb.CATALOG))
    return out.join(known, F.col("src") == F.col("uid"), "left_semi").select("ordinal", "src", "found", "dst_uid")


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT dst_uid, name, count(*) AS n_sites FROM sites JOIN nodes ON uid = dst_uid WHERE is_sink GROUP BY dst_uid, name ORDER BY n_sites DESC, dst_uid LIMIT 30")
def sink_summary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.sink_summary(tb.order_nodes(spark, sf_dir), tb.order_sites(spark, sf_dir), 30)


@query(_with(tb.ORDER_NODES) + "SELECT count(*) AS n_nodes, count(*) FILTER (WHERE is_source) AS n_sources, count(*) FILTER (WHERE is_sink) AS n_sinks, count(*) FILTER (WHERE is_entry) AS n_entries FROM nodes")
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.totals(tb.order_nodes(spark, sf_dir))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT uid, name, coalesce(n, 0) AS n_calls FROM nodes LEFT JOIN (SELECT src_uid, count(*) AS n FROM edges GROUP BY src_uid) c ON c.src_uid = uid")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.out_degree(tb.order_nodes(spark, sf_dir), link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT min(n) AS least FROM (SELECT uid, count(src_uid) AS n FROM nodes LEFT JOIN edges ON dst_uid = uid GROUP BY uid)")
def min_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = link.edges_of(tb.order_sites(spark, sf_dir)).groupBy(F.col("dst_uid").alias("uid")).agg(F.count("*").alias("n"))
    return tb.order_nodes(spark, sf_dir).select("uid").join(called, "uid", "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))


@query(_with(tb.ORDER_NODES) + "SELECT name, lang, count(*) AS n FROM nodes WHERE is_sink GROUP BY name, lang")
def sink_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.sinks_by_language(tb.order_nodes(spark, sf_dir))


@query(_with(tb.ORDER_NODES) + "SELECT uid, name FROM nodes WHERE is_entry")
def entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.order_nodes(spark, sf_dir).where("is_entry").select("uid", "name")


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT DISTINCT src_uid, dst_uid FROM edges JOIN nodes ON uid = dst_uid WHERE is_sink AND name = 'AFRICA'")
def direct_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.direct_callers(tb.order_nodes(spark, sf_dir), link.edges_of(tb.order_sites(spark, sf_dir)), "AFRICA")




@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT dst_uid, min(src_uid) AS src_uid FROM edges JOIN nodes s ON s.uid = dst_uid AND s.is_sink JOIN nodes o ON o.uid = src_uid AND o.name = '1-URGENT' GROUP BY dst_uid")
def orphan_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tb.order_nodes(spark, sf_dir).withColumn("is_source", F.col("name") == "1-URGENT")
    return link.orphan_sinks(nodes, link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT uid, name FROM nodes WHERE is_sink AND NOT EXISTS (SELECT 1 FROM edges WHERE dst_uid = uid)")
def uncalled_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.uncalled_sinks(tb.order_nodes(spark, sf_dir), link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_NODES) + "SELECT uid FROM nodes WHERE is_entry UNION SELECT uid FROM nodes WHERE is_source")
def start_points_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tb.order_nodes(spark, sf_dir)
    return nodes.where("is_entry").select("uid").union(nodes.where("is_source").select("uid")).distinct()


@query(_with(tb.ORDER_NODES) + "SELECT uid, name || CASE WHEN is_entry OR is_source OR is_sink THEN ' [' || concat_ws('|', CASE WHEN is_entry THEN 'WEB_ENTRY' END, CASE WHEN is_source THEN 'SOURCE' END, CASE WHEN is_sink THEN 'SINK' END) || ']' ELSE '' END AS label, file || ':' || line || CASE WHEN end_line <> line AND end_line <> 0 THEN '-' || end_line ELSE '' END AS location FROM nodes")
def label_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return tb.order_nodes(spark, sf_dir).select("uid", sc.label(c("name"), c("is_source"), c("is_sink"), c("is_entry")).alias("label"), sc.location(c("file"), c("line"), c("end_line"), c("is_builtin")).alias("location"))


# --- paths ------------------------------------------------------------------------------------------------------

_BACK = """back(sink, head, path) AS (
  SELECT uid, uid, [uid] FROM nodes WHERE is_sink
  UNION ALL SELECT sink, src_uid, list_prepend(src_uid, path) FROM back JOIN edges ON dst_uid = head WHERE NOT list_contains(path, src_uid))"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("sink", "head", F.array_join("path", " > ").alias("path"))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, _BACK, recursive=True) + "SELECT sink, head, array_to_string(path, ' > ') AS path FROM back WHERE len(path) > 1")
def backward_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(paths.backward_paths(tb.order_nodes(spark, sf_dir).where("is_sink"), link.edges_of(tb.order_sites(spark, sf_dir))))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, _BACK, recursive=True) + "SELECT sink, head, array_to_string(path, ' > ') AS path FROM back JOIN nodes ON uid = head WHERE is_source AND len(path) > 1")
def validated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tb.order_nodes(spark, sf_dir)
    return _shown(paths.backward_paths(nodes.where("is_sink"), link.edges_of(tb.order_sites(spark, sf_dir)), nodes.where("is_source")))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, _BACK, recursive=True) + "SELECT sink, count(*) AS n_paths, count(DISTINCT head) AS n_heads, max(len(path))::INTEGER AS longest FROM back JOIN nodes ON uid = head WHERE is_source AND len(path) > 1 GROUP BY sink")
def validated_sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: validated source-to-sink paths, counted by sink."""
    nodes = tb.order_nodes(spark, sf_dir)
    found = paths.backward_paths(nodes.where("is_sink"), link.edges_of(tb.order_sites(spark, sf_dir)), nodes.where("is_source"))
    return found.groupBy("sink").agg(F.count("*").alias("n_paths"), F.countDistinct("head").alias("n_heads"), F.max(F.size("path")).alias("longest"))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, """fore(head, tail, path, done) AS (
  SELECT uid, uid, [uid], false FROM nodes WHERE is_source
  UNION ALL SELECT head, dst_uid, list_append(path, dst_uid), is_sink FROM fore JOIN edges ON src_uid = tail JOIN nodes ON uid = dst_uid WHERE NOT done AND NOT list_contains(path, dst_uid) AND len(path) < 17)""", recursive=True)
  + "SELECT tail AS sink, head, array_to_string(path, ' > ') AS path FROM fore WHERE done")
def forward_paths_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tb.order_nodes(spark, sf_dir)
    return _shown(paths.forward_paths(nodes.where("is_source"), link.edges_of(tb.order_sites(spark, sf_dir)), nodes.where("is_sink"), 17))


@query(_with(tb.EVENT_EDGES, "p(head, tail, path) AS (SELECT src_uid, dst_uid, [src_uid, dst_uid] FROM edges UNION ALL SELECT head, dst_uid, list_append(path, dst_uid) FROM p JOIN edges ON src_uid = tail WHERE NOT list_contains(path, dst_uid))", recursive=True) + "SELECT tail AS sink, head, array_to_string(path, ' > ') AS path FROM p")
def cyclic_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tb.event_edges(spark, sf_dir)
    return _shown(paths.backward_paths(edges.select(F.col("dst_uid").alias("uid")).distinct(), edges))


@query(_with(tb.EVENT_EDGES, """p(head, tail, path, used) AS (SELECT src_uid, dst_uid, [src_uid, dst_uid], [src_uid || '>' || dst_uid] FROM edges WHERE src_uid LIKE 'view%'
  UNION ALL SELECT head, dst_uid, list_append(path, dst_uid), list_append(used, tail || '>' || dst_uid) FROM p JOIN edges ON src_uid = tail WHERE len(used) < 5 AND NOT list_contains(used, tail || '>' || dst_uid))""", recursive=True)
  + "SELECT tail AS sink, head, array_to_string(path, ' > ') AS path FROM p WHERE tail LIKE 'purchase%'")
def edge_unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tb.event_edges(spark, sf_dir)
    ends = lambda kind: edges.select(F.explode(F.array("src_uid", "dst_uid")).alias("uid")).where(F.col("uid").startswith(kind)).distinct()
    return _shown(paths.edge_unique_paths(ends("view"), edges, ends("purchase"), 5))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, "seen(uid) AS (SELECT uid FROM nodes WHERE uid LIKE 'supp.%' AND is_sink UNION SELECT dst_uid FROM seen JOIN edges ON src_uid = uid)", recursive=True) + "SELECT uid FROM seen")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = tb.order_nodes(spark, sf_dir).where(F.col("is_sink") & F.col("uid").startswith("supp."))
    return paths.reachable(starts, link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES, """walk(uid, level) AS (
  SELECT uid, 0 FROM nodes WHERE is_entry OR NOT EXISTS (SELECT 1 FROM edges WHERE dst_uid = uid) UNION SELECT dst_uid, level + 1 FROM walk JOIN edges ON src_uid = uid WHERE level < 12)""", recursive=True)
  + "SELECT uid, min(level)::INTEGER AS level FROM walk GROUP BY uid")
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.levels(tb.order_nodes(spark, sf_dir), link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_SITES) + """, pair AS (SELECT src_uid AS a, dst_uid AS b FROM edges UNION SELECT dst_uid, src_uid FROM edges), one AS (SELECT b AS uid FROM pair WHERE a = 'part.1'), two AS (SELECT b AS uid FROM pair JOIN one ON a = uid)
  SELECT 'part.1' AS centre, uid, min(hop)::INTEGER AS hop FROM (SELECT 'part.1' AS uid, 0 AS hop UNION ALL SELECT uid, 1 FROM one UNION ALL SELECT uid, 2 FROM two) GROUP BY uid""")
def two_hop_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = tb.order_nodes(spark, sf_dir).where("uid = 'part.1'")
    return paths.neighborhood(link.edges_of(tb.order_sites(spark, sf_dir)), centre)


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + "SELECT uid, 'node' AS part FROM nodes WHERE lang IN ('go', 'php') UNION ALL SELECT DISTINCT unnest([src_uid, dst_uid]), 'edge' FROM sites WHERE file IN ('supplier', 'nation')")
def property_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, sites = tb.order_nodes(spark, sf_dir), tb.order_sites(spark, sf_dir)
    by_node = paths.filter_by_property(nodes, sites, "lang", ["go", "php"]).withColumn("part", F.lit("node"))
    return by_node.unionByName(paths.filter_by_property(nodes, sites, "file", ["supplier", "nation"], on="edge").withColumn("part", F.lit("edge")))


# --- validation -------------------------------------------------------------------------------------------------

_FILES_SQL = "regexp_matches(file, '(^|/)customer$') OR (regexp_matches(file, '(^|/)ord[^/]*s$') AND lang = 'python')"
_FUNCS_SQL = "regexp_matches(name, '(?i)^Customer#.*7$') OR lower(name) = 'customer#000000011' OR ends_with(lower(name), '.customer#000000011')"


@query(_with(tb.ORDER_NODES) + f"SELECT uid, ({_FILES_SQL}) AS by_file, ({_FUNCS_SQL}) AS by_function, ({_FILES_SQL}) OR ({_FUNCS_SQL}) AS by_either, lang = 'php' AND is_source AS by_none FROM nodes")
def source_rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    valid = lambda config: validate.valid_source(c("file"), c("name"), c("lang"), c("is_source"), config)
    return tb.order_nodes(spark, sf_dir).select("uid", valid(tb.CONFIG_FILES).alias("by_file"), valid(tb.CONFIG_FUNCTIONS).alias("by_function"), valid(tb.CONFIG_FILES | tb.CONFIG_FUNCTIONS).alias("by_either"), valid(None).alias("by_none"))


@query(_with(tb.SRC_FILES) + "SELECT path, contains(lower(text), 'license') OR (lang = 'en' AND regexp_matches(text, 'pass(word|wd)')) AS is_match FROM src")
def legacy_source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"source_indicators": ["License"], "language_specific": {"en": {"patterns": ["pass(word|wd)"]}}}
    return tb.src_files(spark, sf_dir).select("path", validate.legacy_match(F.col("text"), F.col("lang"), config).alias("is_match"))


# --- extraction -------------------------------------------------------------------------------------------------

_LANG_OF = "list_element([" + ", ".join(f"'{n}'" for n in sources.LANGUAGES) + "], (p_partkey % 9 + 1)::INTEGER)"


def _found(columns: str, rows: str) -> str:
    """SQL of what is to be found in each part's file: rows of (lang, columns) with ``{k}`` for the key."""
    names = columns.split(", ")
    shown = ", ".join(f"replace({c}, '{{k}}', p_partkey::VARCHAR) AS {c}" if c in ("uid", "src", "callee", "name") else c for c in names)
    return f"SELECT {shown} FROM part JOIN (VALUES {rows}) t(lang, {columns}) ON t.lang = {_LANG_OF}"


@query(_found("uid, name, line, end_line, is_entry, is_source", """
  ('python', 'app.py{k}.<global>', '<global>', 1, 10, false, false), ('python', 'app.py{k}.C{k}.m{k}', 'm{k}', 3, 5, false, false), ('python', 'app.py{k}.f{k}', 'f{k}', 7, 9, true, false),
  ('javascript', 'web.js{k}.<global>', '<global>', 1, 10, false, false), ('javascript', 'web.js{k}.f{k}', 'f{k}', 1, 3, false, false), ('javascript', 'web.js{k}.g{k}', 'g{k}', 4, 6, false, false), ('javascript', 'web.js{k}.<anon@7>', '<anon@7>', 7, 9, true, false),
  ('typescript', 'web.ts{k}.<global>', '<global>', 1, 9, false, false), ('typescript', 'web.ts{k}.C{k}.m{k}', 'm{k}', 2, 4, false, false), ('typescript', 'web.ts{k}.f{k}', 'f{k}', 6, 8, false, false),
  ('tsx', 'web.view{k}.<global>', '<global>', 1, 5, false, false), ('tsx', 'web.view{k}.View{k}', 'View{k}', 1, 4, false, false),
  ('java', 'src.J{k}.<global>', '<global>', 1, 7, false, false), ('java', 'src.J{k}.J{k}.m{k}', 'm{k}', 2, 5, false, false),
  ('go', 'cmd.go{k}.<global>', '<global>', 1, 9, false, false), ('go', 'cmd.go{k}.f{k}', 'f{k}', 2, 4, true, false), ('go', 'cmd.go{k}.main', 'main', 5, 8, false, false),
  ('php', 'www.p{k}.<global>', '<global>', 1, 6, false, true), ('php', 'www.p{k}.f{k}', 'f{k}', 2, 4, false, true),
  ('ruby', 'lib.r{k}.<global>', '<global>', 1, 9, false, false), ('ruby', 'lib.r{k}.R{k}.m{k}', 'm{k}', 2, 4, false, false), ('ruby', 'lib.r{k}.f{k}', 'f{k}', 6, 8, false, false),
  ('c_sharp', 'src.S{k}.<global>', '<global>', 1, 6, false, false), ('c_sharp', 'src.S{k}.S{k}.M{k}', 'M{k}', 2, 4, false, false)"""))
def extracted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one source file a part, in nine languages."""
    return extract.extract(sources.part_files(spark, sf_dir))[0].select("uid", "name", "line", "end_line", "is_entry", "is_source")


@query(_found("src, callee, line", """
  ('python', 'app.py{k}.C{k}.m{k}', 'os.system', 4), ('python', 'app.py{k}.C{k}.m{k}', 'self.h{k}', 5), ('python', 'app.py{k}.f{k}', 'C{k}().m{k}', 9), ('python', 'app.py{k}.f{k}', 'C{k}', 9), ('python', 'app.py{k}.f{k}', 'app.route', 7),
  ('javascript', 'web.js{k}.f{k}', 'db.query', 2), ('javascript', 'web.js{k}.g{k}', 'f{k}', 5), ('javascript', 'web.js{k}.<global>', 'app.get', 7), ('javascript', 'web.js{k}.<global>', 'g{k}', 8),
  ('typescript', 'web.ts{k}.C{k}.m{k}', 'eval', 3), ('typescript', 'web.ts{k}.f{k}', 'helper{k}', 7), ('tsx', 'web.view{k}.View{k}', 'load{k}', 2),
  ('java', 'src.J{k}.J{k}.m{k}', 'Runtime.getRuntime', 3), ('java', 'src.J{k}.J{k}.m{k}', 'Runtime.getRuntime.exec', 3), ('java', 'src.J{k}.J{k}.m{k}', 'h{k}', 4),
  ('go', 'cmd.go{k}.f{k}', 'exec.Command', 3), ('go', 'cmd.go{k}.main', 'f{k}', 6), ('go', 'cmd.go{k}.main', 'http.HandleFunc', 7), ('php', 'www.p{k}.f{k}', 'system', 3), ('php', 'www.p{k}.<global>', 'f{k}', 5),
  ('ruby', 'lib.r{k}.R{k}.m{k}', 'system', 3), ('ruby', 'lib.r{k}.f{k}', 'eval', 7), ('c_sharp', 'src.S{k}.S{k}.M{k}', 'Process.Start', 3)"""))
def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one source file a part, in nine languages."""
    return extract.extract(sources.part_files(spark, sf_dir))[1].select("src", "callee", "line")


@query(_found("name, line, end_line", "('python', 'C{k}', 2, 5), ('typescript', 'C{k}', 1, 5), ('java', 'J{k}', 1, 6), ('ruby', 'R{k}', 1, 5), ('c_sharp', 'S{k}', 1, 5)"))
def extracted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of one source file a part, in nine languages."""
    return extract.extract(sources.part_files(spark, sf_dir))[2].select("name", "line", "end_line")


# --- traces -----------------------------------------------------------------------------------------------------


@query(_with(tb.SPANS) + """SELECT trace_id, hop, file, shown, coalesce(shown - lag(shown) OVER (PARTITION BY trace_id, hop, file ORDER BY shown) > 1, false) AS gap FROM (
  SELECT trace_id, file, shown, min(hop) AS hop FROM (SELECT trace_id, hop, file, unnest(range(line, end_line + 1))::INTEGER AS shown FROM spans) GROUP BY trace_id, file, shown)""")
def first_seen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.first_shown(tb.spans(spark, sf_dir))


@query(_with(tb.CODED) + "SELECT sink, array_to_string(fs, ',') || ',' || sink AS path, code_hash, array_to_string(functions, ',') AS functions FROM coded")
def path_code_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths_, code = tb.coded(spark, sf_dir), spark.range(12).select(F.concat(F.lit("f."), F.col("id").cast("string")).alias("uid"))
    code = code.withColumn("code", F.concat(F.lit("code of "), F.col("uid")))
    out = traces.coded_paths(paths_.select("sink", "path"), code)
    return out.select("sink", F.array_join("path", ",").alias("path"), "code_hash", F.array_join("functions", ",").alias("functions"))


@query(_with(tb.CODED) + """SELECT code_hash, min(array_to_string(fs, ',') || ',' || sink) AS path, array_to_string(list_sort(list(DISTINCT sink)), ',') AS sinks, count(*) AS n_merged FROM coded GROUP BY code_hash""")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traces.deduplicate(tb.coded(spark, sf_dir), "exact")
    return out.select("code_hash", F.array_join("path", ",").alias("path"), F.array_join("sinks", ",").alias("sinks"), "n_merged")


@query(_with(tb.CODED) + """, g AS (SELECT code_hash, any_value(functions) AS functions, list(DISTINCT sink) AS sinks FROM coded GROUP BY code_hash),
  c AS (SELECT a.code_hash AS inner_hash, b.code_hash AS outer_hash, a.sinks FROM g a JOIN g b ON len(a.functions) < len(b.functions) AND list_has_all(b.functions, a.functions))
  SELECT g.code_hash, array_to_string(list_sort(list_distinct(list_concat(g.sinks, coalesce((SELECT flatten(list(c.sinks)) FROM c WHERE c.outer_hash = g.code_hash), [])))), ',') AS sinks FROM g WHERE g.code_hash NOT IN (SELECT inner_hash FROM c)""")
def dedup_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.deduplicate(tb.coded(spark, sf_dir), "maximal").select("code_hash", F.array_join("sinks", ",").alias("sinks"))


@query()
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature: tested against a plain model of the sequence."""
    out = traces.deduplicate(tb.coded(spark, sf_dir), "greedy")
    return out.select("code_hash", F.array_join("path", ",").alias("path"), F.array_join("sinks", ",").alias("sinks"), "n_merged")


@query(_with(tb.CODED) + """, t AS (SELECT row_number() OVER (ORDER BY sink, len(fs) + 1, array_to_string(fs, '>') || '>' || sink) AS trace_id, * FROM coded)
  SELECT min(trace_id) AS trace_id, code_hash, array_to_string(list_sort(list(DISTINCT sink)), ',') AS sinks, count(*) AS n_merged FROM t GROUP BY code_hash""")
def merge_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = link.numbered(tb.coded(spark, sf_dir).select("sink", F.size("path").alias("n"), F.array_join("path", ">").alias("p"), "code_hash"), "sink", "n", "p")
    out = traces.merge_by_hash(numbered.select("trace_id", "code_hash", F.array("sink").alias("sinks")))
    return out.select("trace_id", "code_hash", F.array_join("sinks", ",").alias("sinks"), "n_merged")


@query(_with(tb.CODED) + "SELECT sum(n - 1)::BIGINT AS n_merged, count(*) AS n_saved FROM (SELECT code_hash, count(*) AS n FROM coded GROUP BY code_hash)")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = tb.coded(spark, sf_dir).groupBy("code_hash").agg(F.count("*").alias("n_merged"))
    return traces.merge_counters(grouped)


_HOPS = """hops AS (SELECT o_orderkey AS trace_id, ['cust.' || o_custkey, 'ord.' || o_orderkey, 'part.' || p] AS path FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p"))
    o = tb.table(spark, sf_dir, "orders").join(first, "o_orderkey")
    uid = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return o.select(F.col("o_orderkey").alias("trace_id"), F.array(uid("cust.", "o_custkey"), uid("ord.", "o_orderkey"), uid("part.", "p")).alias("path"), F.array(uid("part.", "p")).alias("sinks"))


@query(_with(tb.ORDER_SITES, _HOPS) + """, pairs AS (SELECT trace_id, 0 AS hop, path[1] AS src_uid, path[2] AS dst_uid FROM hops UNION ALL SELECT trace_id, 1, path[2], path[3] FROM hops)
  SELECT trace_id, hop, src_uid, dst_uid, file, line FROM (SELECT p.*, file, line, row_number() OVER (PARTITION BY trace_id, hop ORDER BY file, line) AS rn FROM pairs p JOIN (SELECT DISTINCT * FROM sites) s USING (src_uid, dst_uid)) WHERE rn <= 10""")
def hop_callsites_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.hop_callsites(_order_traces(spark, sf_dir), tb.order_sites(spark, sf_dir))


@query(_with(tb.ORDER_NODES, _HOPS) + """, each AS (SELECT trace_id, unnest(path) AS uid, unnest(range(len(path))) AS hop FROM hops)
  SELECT trace_id, '[PATH] ' || string_agg(name || CASE WHEN is_source THEN ' [SOURCE]' WHEN is_sink THEN ' [SINK]' ELSE '' END, ' -> ' ORDER BY hop) AS text FROM each JOIN nodes USING (uid) GROUP BY trace_id""")
def path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = traces.hops(_order_traces(spark, sf_dir)).join(tb.order_nodes(spark, sf_dir), "uid")
    shown = sc.label(F.col("name"), F.col("is_source"), F.col("is_sink"))
    ordered = F.array_sort(F.collect_list(F.struct("hop", shown.alias("label"))))
    return each.groupBy("trace_id").agg(F.concat(F.lit("[PATH] "), F.array_join(F.transform(ordered, lambda h: h["label"]), " -> ")).alias("text"))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + """SELECT 'node' AS kind, '"' || uid || '" [label="' || name || '", color=' || CASE WHEN is_sink THEN 'red' WHEN is_source THEN 'green' ELSE 'lightblue' END || ']' AS line FROM nodes WHERE lang = 'php'
  UNION ALL SELECT 'edge', '"' || src_uid || '" -> "' || dst_uid || '"' || CASE WHEN b.is_sink THEN ' [color=red]' ELSE '' END FROM edges JOIN nodes a ON a.uid = src_uid AND a.lang = 'php' JOIN nodes b ON b.uid = dst_uid AND b.lang = 'php'""")
def dot_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.dot_lines(tb.order_nodes(spark, sf_dir).where("lang = 'php'"), link.edges_of(tb.order_sites(spark, sf_dir)))


@query(_with(tb.ORDER_NODES, tb.ORDER_SITES) + """SELECT uid, name AS label, 0 AS level, CASE WHEN is_sink THEN 'red' WHEN is_entry THEN 'orange' WHEN is_source THEN 'green' ELSE 'lightblue' END AS colour, least(50, 20 + 3 * coalesce(n, 0))::BIGINT AS size, 0::BIGINT AS y
  FROM nodes LEFT JOIN (SELECT src_uid, count(*) AS n FROM edges GROUP BY src_uid) c ON c.src_uid = uid""")
def network_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = tb.order_nodes(spark, sf_dir), link.edges_of(tb.order_sites(spark, sf_dir))
    return render.network_attributes(nodes, link.out_degree(nodes, edges), nodes.select("uid", F.lit(0).alias("level")).distinct())


@query()
def rendered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as YAML text; rows only, the tests parse the texts."""
    rows = traces.trace_rows(_order_traces(spark, sf_dir), tb.order_nodes(spark, sf_dir), tb.order_sites(spark, sf_dir))
    return render.render(rows)


@query()
def triaged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the deterministic stand-in for a model."""
    return report.triage(rendered_traces(spark, sf_dir))


@query(_with(tb.ORDER_SITES) + "SELECT src_uid, dst_uid, array_to_string(list_sort(list(DISTINCT file || ':' || line)), ',') AS callsites FROM sites GROUP BY src_uid, dst_uid")
def edge_callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their distinct call-sites, as the graph tables hold them."""
    grouped = tb.order_sites(spark, sf_dir).groupBy("src_uid", "dst_uid").agg(F.array_sort(F.collect_set(F.concat_ws(":", "file", "line"))).alias("c"))
    return grouped.select("src_uid", "dst_uid", F.array_join("c", ",").alias("callsites"))


_SPANS = "(VALUES ('m.A.f', 4, 4), ('m.f', 2, 3), ('m.B.g', 1, 2)) n(tail, line, end_line)"


@query(_with(tb.SRC_LINES) + f""", spans AS (SELECT src.path, path || ':' || tail AS uid, CASE tail WHEN 'm.A.f' THEN 2 ELSE line END AS a, CASE tail WHEN 'm.A.f' THEN 5 ELSE end_line END AS b FROM src, {_SPANS})
  SELECT uid, string_agg(code, chr(10) ORDER BY l.line) AS code FROM spans s JOIN lines l ON l.path = s.path AND l.line BETWEEN s.a AND s.b GROUP BY uid""")
def class_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of functions; a method whose class is found in the file shows the whole class."""
    files = tb.src_files(spark, sf_dir)
    spans = F.explode(F.array(*[F.struct(F.lit(t).alias("tail"), F.lit(a).alias("line"), F.lit(b).alias("end_line")) for t, a, b in (("m.A.f", 4, 4), ("m.f", 2, 3), ("m.B.g", 1, 2))])).alias("s")
    nodes = files.select(F.col("path").alias("file"), spans).select("file", F.concat(F.replace("file", F.lit("."), F.lit("/")), F.lit(":"), F.col("s.tail")).alias("uid"), "s.tail", "s.line", "s.end_line")
    classes = files.select(F.col("path").alias("file"), F.lit("A").alias("name"), F.lit(2).alias("line"), F.lit(5).alias("end_line"))
    code = traces.node_code(nodes, files, classes)
    names = nodes.select("uid", F.concat("file", F.lit(":"), "tail").alias("shown"))
    return code.where("code IS NOT NULL").join(names, "uid").select(F.col("shown").alias("uid"), "code")


_LINKED = """born AS (SELECT max(ordinal) + 1 AS n FROM cn), ex AS (SELECT ce.*, row_number() OVER (ORDER BY ordinal) - 1 AS k FROM ce),
  e AS (SELECT ex.*, n + 2 * k AS moment, EXISTS (SELECT 1 FROM cat WHERE cat.lang = ex.lang AND (ex.callee = sink OR ends_with(ex.callee, '.' || sink))) AS is_sink FROM ex, born),
  made AS (SELECT uid, name, ordinal AS born FROM cn UNION ALL SELECT src, regexp_extract(src, '[^.]*$'), moment FROM e WHERE src NOT IN (SELECT uid FROM cn) UNION ALL SELECT 'builtin.' || lang || '.' || callee, callee, moment + 1 FROM e WHERE is_sink),
  uids AS (SELECT uid, min(born) AS since FROM made GROUP BY uid),
  named AS (SELECT name, arg_min(uid, born) AS uid, min(born) AS since FROM (SELECT * FROM made UNION ALL SELECT 'ext.' || lang || '.' || callee, callee, moment + 1 FROM e WHERE NOT is_sink AND NOT contains(callee, '.')) GROUP BY name)"""


@query(_with(tb.CALL_NODES, tb.CALL_EDGES, _CATALOG, _LINKED) + """SELECT k, src, CASE WHEN is_sink THEN 'builtin.' || lang || '.' || callee ELSE coalesce(l.uid, m.uid, 'ext.' || lang || '.' || callee) END AS dst_uid
  FROM e LEFT JOIN uids l ON NOT contains(callee, '.') AND l.uid = regexp_replace(src, '\\.[^.]*$', '') || '.' || callee AND l.since <= moment
  LEFT JOIN named m ON m.name = regexp_extract(callee, '[^.]*$') AND m.since <= moment + 1""")
def link_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking in the order in which edges come, across languages."""
    edges = link.numbered(tb.call_edges(spark, sf_dir), "ordinal", name="k").withColumn("ordinal", F.col("k") - 1).drop("k")
    out = link.resolve(tb.call_nodes(spark, sf_dir), edges, catalog_frame(spark, tb.CATALOG, compat=True), compat=True)
    return out.select(F.col("ordinal").alias("k"), "src", "dst_uid")


@query(_with(tb.SRC_FILES) + "SELECT path FROM src WHERE lang NOT IN ('fr') AND NOT contains('/' || path, '/src1/')")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a language that is opted out, and without an excluded folder."""
    from ..sources.scan import without

    return without(tb.src_files(spark, sf_dir), languages=("fr",), folders=("src1",)).select("path")


# --- reports ----------------------------------------------------------------------------------------------------


@query(_with(tb.VERDICTS) + "SELECT trace_id, left(coalesce(nullif(reasoning, ''), nullif(exploit, ''), 'Vulnerability'), 500) AS name, coalesce(upper(left(confidence, 1)) || lower(substr(confidence, 2)), 'Medium') AS severity, coalesce(file, '') AS file FROM v WHERE vulnerability")
def vuln_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tb.verdicts(spark, sf_dir)
    return report.vulnerabilities(v.drop("file"), v.select("trace_id", "file"))


@query(_with(tb.VERDICTS) + "SELECT coalesce(upper(left(confidence, 1)) || lower(substr(confidence, 2)), 'Medium') AS severity, count(*) AS n, count(*) FILTER (WHERE vulnerability) AS n_vulnerable FROM v GROUP BY 1")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tb.verdicts(spark, sf_dir)
    return v.groupBy(sc.severity(F.col("confidence")).alias("severity")).agg(F.count("*").alias("n"), F.count_if("vulnerability").alias("n_vulnerable"))


_JSON = """CASE doc_id % 4 WHEN 0 THEN '{"vulnerability": true, "confidence": "high", "reasoning": "r' || doc_id || '"}' WHEN 1 THEN '{"vulnerability": false, "exploit": "x"}' WHEN 2 THEN '{}' ELSE '{"vulnerability": true, "confidence": "LOW", "reasoning": null}' END"""


@query(f"""SELECT doc_id, coalesce((j ->> 'vulnerability')::BOOLEAN, false) AS vulnerability, coalesce(upper(left(j ->> 'confidence', 1)) || lower(substr(j ->> 'confidence', 2)), 'Medium') AS confidence, j ->> 'reasoning' AS reasoning, j ->> 'exploit' AS exploit
  FROM (SELECT doc_id, ({_JSON})::JSON AS j FROM documents)""")
def verdict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers as verdicts."""
    answers = tb.table(spark, sf_dir, "documents").select("doc_id", F.expr(_JSON).alias("response"))
    return report.parsed_verdicts(answers).drop("response")


@query(_with(tb.ORDER_NODES) + "SELECT uid, file || ':' || line AS location FROM nodes")
def trace_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first location of a rendered trace."""
    text = F.concat(F.lit("- function: "), F.col("name"), F.lit('\n  location: "'), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit('"\n  calls:\n    - function: x\n      location: other:1\n'))
    return tb.order_nodes(spark, sf_dir).select("uid", sc.first_location(text).alias("location"))


@query("SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY conv_id")
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("role", "turn").alias("last"))


