"""The driver's tables seen as files, graphs and verdicts; each view is defined twice, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc

#: Languages of documents stand for file extensions.
EXTENSION_BY_LANG = {"en": "py", "fr": "js", "de": "php", "es": "go"}
CATALOG = {"python": ["cursor.execute", "eval"], "javascript": ["db.query", "red_widget"], "php": ["exec", "system"], "go": ["exec.Command"]}
CONFIG_FILES = {"file_patterns": [{"pattern": "customer"}, {"pattern": "ord*s", "language": "python"}]}
CONFIG_FUNCTIONS = {"function_patterns": ["^Customer#.*7$"], "function_names": ["Customer#000000011"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    extension = F.create_map(*[F.lit(x) for p in EXTENSION_BY_LANG.items() for x in p])
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(F.try_element_at(extension, F.col("lang")), F.lit("txt")))
    return d.select(F.lit("corpus").alias("repo"), path.alias("path"), "lang", "text")


SRC_FILES = "src AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'js' WHEN 'de' THEN 'php' WHEN 'es' THEN 'go' ELSE 'txt' END AS path, lang, text FROM documents)"
SRC_LINES = SRC_FILES + r""", lines AS (
  SELECT path, unnest(ls) AS code, unnest(range(1, len(ls) + 1))::INTEGER AS line FROM (
    SELECT path, CASE WHEN ls[len(ls)] = '' THEN ls[1 : len(ls) - 1] ELSE ls END AS ls FROM (SELECT path, string_split_regex(text, '\r\n|\r|\n') AS ls FROM src)))"""


def _node(df: DataFrame, uid, name, file: str, line, end_line, sink, source, entry, lang) -> DataFrame:
    return df.select(
        F.lit("shop").alias("repo"), uid.alias("uid"), name.alias("name"), F.lit(file).alias("file"), line.cast("int").alias("line"), end_line.cast("int").alias("end_line"),
        sink.alias("is_sink"), entry.alias("is_entry"), source.alias("is_source"), F.lit(False).alias("is_builtin"), lang.alias("lang"),
    )


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are sources and entries, parts and suppliers sinks; orders, nations and regions stand between."""
    c, no = F.col, F.lit(False)
    uid = lambda kind, key: F.concat(F.lit(kind + "."), c(key).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _node(t("customer"), uid("cust", "c_custkey"), c("c_name"), "customer", c("c_nationkey") + 1, c("c_nationkey") + 3, no, c("c_mktsegment") == "BUILDING", c("c_acctbal") < 0, F.lit("python")),
        _node(t("orders"), uid("ord", "o_orderkey"), c("o_orderpriority"), "orders", F.month("o_orderdate"), F.month("o_orderdate"), no, no, no, F.lit("python")),
        _node(t("part"), uid("part", "p_partkey"), c("p_name"), "part", c("p_size"), c("p_size") + 2, (c("p_size") == 1), no, no, F.lit("go")),
        _node(t("supplier"), uid("supp", "s_suppkey"), c("s_name"), "supplier", c("s_nationkey") + 1, c("s_nationkey") + 1, (c("s_acctbal") < 0), no, no, F.lit("php")),
        _node(t("nation"), uid("nation", "n_nationkey"), c("n_name"), "nation", c("n_nationkey") + 1, c("n_nationkey") + 1, no, no, no, F.lit("php")),
        _node(t("region"), uid("region", "r_regionkey"), c("r_name"), "region", c("r_regionkey") + 1, c("r_regionkey") + 1, c("r_regionkey") == 0, no, no, F.lit("php")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORDER_NODES = """nodes AS (
  SELECT 'cust.' || c_custkey AS uid, c_name AS name, 'customer' AS file, c_nationkey + 1 AS line, c_nationkey + 3 AS end_line, false AS is_sink, c_acctbal < 0 AS is_entry, c_mktsegment = 'BUILDING' AS is_source, 'python' AS lang FROM customer
  UNION ALL SELECT 'ord.' || o_orderkey, o_orderpriority, 'orders', month(o_orderdate), month(o_orderdate), false, false, false, 'python' FROM orders
  UNION ALL SELECT 'part.' || p_partkey, p_name, 'part', p_size, p_size + 2, p_size = 1, false, false, 'go' FROM part
  UNION ALL SELECT 'supp.' || s_suppkey, s_name, 'supplier', s_nationkey + 1, s_nationkey + 1, s_acctbal < 0, false, false, 'php' FROM supplier
  UNION ALL SELECT 'nation.' || n_nationkey, n_name, 'nation', n_nationkey + 1, n_nationkey + 1, false, false, false, 'php' FROM nation
  UNION ALL SELECT 'region.' || r_regionkey, r_name, 'region', r_regionkey + 1, r_regionkey + 1, r_regionkey = 0, false, false, 'php' FROM region)"""


def order_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-sites: customer to order to part to supplier to nation to region."""
    c = F.col
    uid = lambda kind, key: F.concat(F.lit(kind + "."), c(key).cast("string"))
    row = lambda df, a, b, file, line: df.select(a.alias("src_uid"), b.alias("dst_uid"), F.lit(file).alias("file"), line.cast("int").alias("line"))
    t = lambda n: table(spark, sf_dir, n)
    out = row(t("orders"), uid("cust", "o_custkey"), uid("ord", "o_orderkey"), "customer", F.month("o_orderdate"))
    out = out.unionByName(row(t("lineitem"), uid("ord", "l_orderkey"), uid("part", "l_partkey"), "orders", c("l_linenumber")))
    out = out.unionByName(row(t("lineitem"), uid("part", "l_partkey"), uid("supp", "l_suppkey"), "part", c("l_linenumber")))
    out = out.unionByName(row(t("supplier"), uid("supp", "s_suppkey"), uid("nation", "s_nationkey"), "supplier", F.lit(1)))
    return out.unionByName(row(t("nation"), uid("nation", "n_nationkey"), uid("region", "n_regionkey"), "nation", F.lit(1)))


ORDER_SITES = """sites AS (
  SELECT 'cust.' || o_custkey AS src_uid, 'ord.' || o_orderkey AS dst_uid, 'customer' AS file, month(o_orderdate)::INTEGER AS line FROM orders
  UNION ALL SELECT 'ord.' || l_orderkey, 'part.' || l_partkey, 'orders', l_linenumber::INTEGER FROM lineitem
  UNION ALL SELECT 'part.' || l_partkey, 'supp.' || l_suppkey, 'part', l_linenumber::INTEGER FROM lineitem
  UNION ALL SELECT 'supp.' || s_suppkey, 'nation.' || s_nationkey, 'supplier', 1 FROM supplier
  UNION ALL SELECT 'nation.' || n_nationkey, 'region.' || n_regionkey, 'nation', 1 FROM nation),
edges AS (SELECT DISTINCT src_uid, dst_uid FROM sites)"""


def event_edges(spark: SparkSession, sf_dir: str, states: int = 1) -> DataFrame:
    """Transitions between the event types of each user, with one of ``states`` user groups: a cyclic graph."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("uid", F.concat("event_type", F.lit("/"), (F.col("user_id") % states).cast("string")))
    before = F.lag("uid").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(before.alias("src_uid"), F.col("uid").alias("dst_uid")).where("src_uid IS NOT NULL AND src_uid <> dst_uid").distinct()


EVENT_EDGES = """edges AS (
  SELECT DISTINCT src_uid, dst_uid FROM (SELECT lag(event_type || '/' || (user_id % 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src_uid, event_type || '/' || (user_id % 1) AS dst_uid FROM events)
  WHERE src_uid IS NOT NULL AND src_uid <> dst_uid)"""

_LANGS = ("python", "javascript", "php", "go")


def call_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function nodes for linking: each part name in a library, and some in the scope of orders too; first come, first named."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    lib = p.select(F.concat(F.lit("lib"), (F.col("p_partkey") % 7).cast("string"), F.lit("."), name).alias("uid"), name.alias("name"), lang.alias("lang"), F.col("p_partkey").alias("ordinal"))
    own = p.where("p_size = 2").select(F.concat(F.lit("ord."), name).alias("uid"), name.alias("name"), lang.alias("lang"), (F.col("p_partkey") + 10_000_000).alias("ordinal"))
    both = lib.unionByName(own)
    flags = {c: F.lit(False) for c in ("is_sink", "is_entry", "is_builtin")}
    return both.select(F.lit("shop").alias("repo"), "uid", "name", F.lit("lib").alias("file"), (F.col("ordinal") % 50).cast("int").alias("line"), (F.col("ordinal") % 60).cast("int").alias("end_line"), flags["is_sink"].alias("is_sink"), flags["is_entry"].alias("is_entry"), (F.col("ordinal") % 11 == 0).alias("is_source"), flags["is_builtin"].alias("is_builtin"), "lang", "ordinal")


CALL_NODES = """cn0 AS (
  SELECT 'lib' || (p_partkey % 7) || '.' || replace(p_name, ' ', '_') AS uid, replace(p_name, ' ', '_') AS name, ['python', 'javascript', 'php', 'go'][(p_partkey % 4 + 1)::INTEGER] AS lang, p_partkey AS ordinal FROM part
  UNION ALL SELECT 'ord.' || replace(p_name, ' ', '_'), replace(p_name, ' ', '_'), ['python', 'javascript', 'php', 'go'][(p_partkey % 4 + 1)::INTEGER], p_partkey + 10000000 FROM part WHERE p_size = 2),
cn AS (SELECT *, (ordinal % 50)::INTEGER AS line, (ordinal % 60)::INTEGER AS end_line, ordinal % 11 = 0 AS is_source FROM cn0)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calls of orders: a sink by its suffix, a dotted name, a bare name, or one that nothing answers to."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    callee = (
        F.when(F.col("p_size") % 5 == 0, F.lit("conn . cursor?.execute")).when(F.col("p_size") % 5 == 1, F.concat(F.lit("app::"), name))
        .when(F.col("p_size") % 5 == 2, name).when(F.col("p_size") % 5 == 3, F.concat(F.lit("none_"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("x.db.query"), F.lit("")))
    )
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    joined = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    ordinal = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return joined.select(F.lit("shop").alias("repo"), F.concat(F.lit("ord."), F.col("l_orderkey").cast("string")).alias("src"), callee.alias("callee"), F.lit("orders").alias("file"), F.col("l_linenumber").cast("int").alias("line"), lang.alias("lang"), ordinal.cast("long").alias("ordinal")).dropDuplicates(["ordinal"])


CALL_EDGES = """ce AS (
  SELECT DISTINCT 'ord.' || l_orderkey AS src, CASE p_size % 5 WHEN 0 THEN 'conn.cursor.execute' WHEN 1 THEN 'app.' || replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN 'none_' || p_size ELSE 'x.db.query' END AS callee,
    l_linenumber::INTEGER AS line, ['python', 'javascript', 'php', 'go'][(l_orderkey % 4 + 1)::INTEGER] AS lang, (l_orderkey * 100000000 + l_partkey * 10 + l_linenumber)::BIGINT AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts: toxic is vulnerable, quality is confidence, the text's beginning is the reasoning."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    joined = labels.join(docs, "doc_id")
    return joined.select(F.col("doc_id").alias("trace_id"), (F.col("toxic") == 1).alias("vulnerability"), F.when(F.col("quality") == 1, F.lit("hIGH")).when(F.col("doc_id") % 3 == 0, F.lit("low")).alias("confidence"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.left("text", F.lit(600))).alias("reasoning"), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("an exploit")).alias("exploit"), F.col("source").alias("file"))


VERDICTS = """v AS (
  SELECT l.doc_id AS trace_id, toxic = 1 AS vulnerability, CASE WHEN quality = 1 THEN 'hIGH' WHEN l.doc_id % 3 = 0 THEN 'low' END AS confidence, CASE WHEN l.doc_id % 5 = 0 THEN '' ELSE left(text, 600) END AS reasoning,
    CASE WHEN l.doc_id % 2 = 0 THEN '' ELSE 'an exploit' END AS exploit, source AS file FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, hop, file, line, end_line): the line ranges that a part's suppliers show, hop by hop."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("hop"), (F.col("l_suppkey") % 3).cast("string").alias("file"), (F.col("l_partkey") % 30 + 1).cast("int").alias("line"), (F.col("l_partkey") % 30 + 1 + F.col("l_suppkey") % 7).cast("int").alias("end_line"))


SPANS = "spans AS (SELECT l_orderkey AS trace_id, l_linenumber AS hop, (l_suppkey % 3)::VARCHAR AS file, (l_partkey % 30 + 1)::INTEGER AS line, (l_partkey % 30 + 1 + l_suppkey % 7)::INTEGER AS end_line FROM lineitem)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sink, path, code_hash, functions): orders as paths over their suppliers, with made-up code; many share it."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 12).alias("s"))
    path = F.concat(F.transform(F.array_sort(F.collect_set("s")), lambda s: F.concat(F.lit("f."), s.cast("string"))), F.array(F.concat(F.lit("sink."), (F.col("l_orderkey") % 9).cast("string"))))
    paths = l.groupBy("l_orderkey").agg(path.alias("path")).select(F.try_element_at("path", F.lit(-1)).alias("sink"), "path").distinct()
    items = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda u: F.struct(u.alias("uid"), F.concat(F.lit("code of "), u).alias("code")))
    return paths.select("sink", "path", sc.path_code_hash(items).alias("code_hash"), sc.function_hashes(items).alias("functions"))


CODED = """cp0 AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 12)) AS s FROM lineitem GROUP BY l_orderkey),
coded AS (
  SELECT DISTINCT 'sink.' || (l_orderkey % 9) AS sink, list_transform(s, lambda x: 'f.' || x) AS fs,
    md5(array_to_string(list_sort(list_transform(s, lambda x: 'f.' || x || ':code of f.' || x)), chr(10) || '---' || chr(10))) AS code_hash,
    list_sort(list_transform(s, lambda x: md5('f.' || x || ':code of f.' || x))) AS functions FROM cp0)"""
