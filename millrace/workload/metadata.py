"""Catalogue, column usage and the column graph, derived from the shared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import catalogue, graph, usage
from millrace.plans.publish import MetadataStore
from millrace.workload.registry import query, table
from millrace.workspace import fresh_dir, stored

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    " UNION ALL ".join(
        f"""
    SELECT '10.0.0.1:0:lake:{t}' AS id, 'parquet' AS db_type, '{t}' AS "table",
           (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns
            WHERE table_name = '{t}') AS columns, count(*) AS row_count FROM {t}"""
        for t in _TABLES
    ),
    name="catalogue",
)
def catalogue_tables(spark, sf_dir):
    each = [
        catalogue.describe_table(table(spark, sf_dir, t), "parquet", "10.0.0.1", "0", "lake", t) for t in _TABLES
    ]
    return reduce(DataFrame.unionByName, each).select(
        "id", "db_type", "table", F.array_join("columns", ",").alias("columns"), "row_count"
    )


@query(
    """
    SELECT 'a:0:docs:events' AS id, 'event_id,user.id,user.kind' AS columns, count(*) AS row_count FROM events
    """
)
def catalogue_nested(spark, sf_dir):
    documents = table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user")
    )
    out = catalogue.describe_table(documents, "elasticsearch", "a", "0", "docs", "events")
    return out.select("id", F.array_join("columns", ",").alias("columns"), "row_count")


@query("""SELECT DISTINCT 'cf:' || event_type AS "column" FROM events UNION SELECT DISTINCT 'cf:' || o_orderpriority FROM orders""")
def catalogue_wide(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("map(concat('cf:', event_type), value) AS cells")
    orders = table(spark, sf_dir, "orders").selectExpr("map(concat('cf:', o_orderpriority), o_totalprice) AS cells")
    return catalogue.map_names(events.unionByName(orders), F.col("cells"))


@query("""SELECT DISTINCT regexp_extract(props, '"([a-z]+)"', 1) AS "column" FROM events UNION SELECT DISTINCT event_type FROM events""")
def catalogue_docs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    documents = events.select("props").unionByName(
        events.select(F.to_json(F.create_map("event_type", "value")).alias("props"))
    )
    return catalogue.document_names(documents, F.col("props"))


def _uses(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_type AS column", "user_id AS user", "ts")


@query("""SELECT event_type AS "column", count(*) AS column_count FROM events GROUP BY 1""", name="usage_count")
def usage_counts(spark, sf_dir):
    return usage.usage_count(_uses(spark, sf_dir), ["column"])


@query(
    """
    WITH s AS (SELECT event_type AS "column", date_trunc('second', ts) AS used_at, count(*) AS uses FROM events GROUP BY 1, 2)
    SELECT "column", strftime(used_at, '%Y-%m-%d %H:%M:%S') AS used_at, uses,
           coalesce(date_diff('second', lag(used_at) OVER (PARTITION BY "column" ORDER BY used_at), used_at), 0) AS gap_seconds
    FROM s
    """
)
def usage_gap(spark, sf_dir):
    out = usage.usage_gaps(_uses(spark, sf_dir), ["column"], "ts")
    return out.withColumn("used_at", F.date_format("used_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    """
    SELECT event_type AS "column", user_id AS "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_used
    FROM events GROUP BY 1, 2
    """
)
def usage_users(spark, sf_dir):
    out = usage.first_uses(_uses(spark, sf_dir), ["column"], "user", "ts")
    return out.withColumn("first_used", F.date_format("first_used", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def corpus(spark, sf_dir):
    """One task document per event: a source named by the event type, joined to a second one."""
    item = {
        "ToSum": "array(named_struct('IsEnable', if(value < 20, 'True', 'False'), 'Step', 1, 'TargetColumn', 'id', 'Naming', 's'))",
        "ToAvg": "array()",
        "ToMode": "array(named_struct('IsEnable', 'True', 'Step', 1, 'TargetColumn', concat('u', user_id % 7), 'Naming', 'm'))",
        "ToColumnCombine": "array(named_struct('IsEnable', 'True', 'Step', 2, 'Naming', 'c', 'Separator', '-', 'TargetColumnList', "
        "array(named_struct('TargetColumn', 'id', 'Order', 1), named_struct('TargetColumn', 'id', 'Order', 2))))",
        "ToPivot": "array(named_struct('IsEnable', 'True', 'Step', 3, 'TargetColumn', 'id', 'TargetValues', array(concat('u', user_id % 7))))",
        "ToArithmetic": "array(named_struct('IsEnable', 'True', 'Step', 3, 'Naming', 'a', 'Operator', 'ADD', 'TargetColumnList', "
        "array(named_struct('Column', concat('u', user_id % 7), 'Order', 1))))",
    }
    functions = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in item.items()) + ")"
    connection = "named_struct('DbType', 'mysql', 'Ip', 'h', 'Port', '1', 'UserName', 'u')"
    first = (
        f"named_struct('ConnectionInfo', {connection}, 'DbInfo', named_struct('DbName', 'd', 'TableName', event_type, "
        f"'ColumnsName', array('id', concat('u', user_id % 7))), 'Condition', named_struct('FunctionCondition', {functions}))"
    )
    second = (
        f"named_struct('ConnectionInfo', {connection}, 'DbInfo', named_struct('DbName', 'd', 'TableName', "
        "if(value < 50, event_type, 'other'), 'ColumnsName', array('id')))"
    )
    keys = "array(named_struct('MergeColumnName', array('id')), named_struct('MergeColumnName', array('id')))"
    # the two sources differ in shape, so the list is put together as text
    document = (
        f"concat('{{\"TaskAction\":{{\"SubmittedUser\":\"', user_id, '\"}},\"Base\":{{\"Databases\":[', to_json({first}), ',', "
        f"to_json({second}), ']}},\"Merge\":{{\"Tables\":[', to_json({keys}), ']}}}}')"
    )
    # the documents are far larger than the rows they come from: spread the rows first
    events = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism, "event_id")
    texts = events.selectExpr("event_id", "ts", f"{document} AS doc")
    return usage.read_corpus(texts, "event_id", "ts", "doc")


_CORPUS_SQL = """
    used AS (
      SELECT event_id, ts, user_id, event_type AS "table", 'id' AS "column", 0 AS pos,
             CAST(value >= 50 AS BIGINT) AS merge_count, CAST(value < 20 AS BIGINT) AS sum_count,
             0::BIGINT AS mode_count, 2::BIGINT AS combine_count, 1::BIGINT AS pivot_count, 0::BIGINT AS arithmetic_count FROM events
      UNION ALL
      SELECT event_id, ts, user_id, event_type, 'u' || (user_id % 7), 0, 0, 0, 1, 0, 1, 1 FROM events
      UNION ALL
      SELECT event_id, ts, user_id, CASE WHEN value < 50 THEN event_type ELSE 'other' END, 'id', 1, 1, 0, 0, 0, 0, 0 FROM events)
"""


@query(
    f"""
    WITH {_CORPUS_SQL}
    SELECT event_id AS submission, "table", "column", pos, merge_count FROM used WHERE "column" = 'id'
    """
)
def merge_key_count(spark, sf_dir):
    return usage.merge_keys(corpus(spark, sf_dir)).select("submission", "table", "column", "pos", "merge_count")


@query(
    f"""
    WITH {_CORPUS_SQL}
    SELECT event_id AS submission, "table", "column", 1::BIGINT AS column_count, merge_count, sum_count, 0::BIGINT AS avg_count,
           mode_count, combine_count, pivot_count, arithmetic_count FROM used
    """
)
def usage_functions(spark, sf_dir):
    counts = list(usage.FUNCTION_COUNTS.values())
    return usage.task_usage(corpus(spark, sf_dir)).select(
        "submission", "table", "column", "column_count", "merge_count", *counts
    )


@query(
    f"""
    WITH {_CORPUS_SQL},
    seconds AS (SELECT "table", "column", date_trunc('second', ts) AS s, count(*) AS n FROM used GROUP BY ALL),
    gaps AS (SELECT *, CASE WHEN n > 1 THEN 0 ELSE coalesce(date_diff('second',
               lag(s) OVER (PARTITION BY "table", "column" ORDER BY s), s), 0) END AS gap,
               row_number() OVER (PARTITION BY "table", "column" ORDER BY s DESC) AS back FROM seconds)
    SELECT 'h:1:d:' || "table" || ':' || "column" AS id, count(*) AS column_count, CAST(sum(merge_count) AS BIGINT) AS merge_count,
           CAST(sum(sum_count) AS BIGINT) AS sum_count, CAST(sum(combine_count) AS BIGINT) AS combine_count,
           CAST(sum(pivot_count) AS BIGINT) AS pivot_count, count(DISTINCT user_id) AS users,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used, any_value(gap) AS gap_seconds
    FROM used JOIN (SELECT "table", "column", gap FROM gaps WHERE back = 1) USING ("table", "column")
    GROUP BY "table", "column"
    """
)
def usage_totals(spark, sf_dir):
    # read by two aggregates: stored, so that documents are written and parsed once
    out = usage.accumulate(stored(usage.task_usage(corpus(spark, sf_dir)), "tasks"))
    shown = F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_used")
    return out.select(
        "id", "column_count", "merge_count", "sum_count", "combine_count", "pivot_count", "users", shown, "gap_seconds"
    )


def _members(spark, sf_dir):
    """Orders as tasks, parts as columns, suppliers as tables."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS task", "l_partkey AS column", "l_suppkey AS table", "l_returnflag AS db", "l_linestatus AS db_type"
    )


_MEMBERS_SQL = """
    m AS (SELECT l_orderkey AS task, l_partkey AS c, l_suppkey AS t, l_returnflag AS db, l_linestatus AS dbtype FROM lineitem)
"""


@query(
    f"""
    WITH {_MEMBERS_SQL}
    SELECT DISTINCT 'Column' AS kind, coalesce(nullif(db, 'N'), '\\N') || ':' || t || '\\:x:' || c AS id FROM m
    UNION SELECT 'Table', coalesce(nullif(db, 'N'), '\\N') || ':' || t || '\\:x' FROM m
    UNION SELECT 'Database', coalesce(nullif(db, 'N'), '\\N') FROM m UNION SELECT 'DBType', dbtype FROM m
    """
)
def graph_vertices(spark, sf_dir):
    """With members that lack a database, and colons in table names."""
    kinds = {"Column": ["db", "table", "column"], "Table": ["db", "table"], "Database": ["db"], "DBType": ["db_type"]}
    members = _members(spark, sf_dir).withColumns(
        {"db": F.nullif("db", F.lit("N")), "table": F.concat(F.col("table").cast("string"), F.lit(":x"))}
    )
    return graph.vertices(members, kinds)


@query(
    f"""
    WITH {_MEMBERS_SQL}
    SELECT DISTINCT dbtype AS src, db AS dst, 'HAS_DATABASE' AS kind FROM m
    UNION SELECT db, db || ':' || t, 'HAS_TABLE' FROM m
    UNION SELECT db || ':' || t, db || ':' || t || ':' || c, 'HAS_COLUMN' FROM m
    """
)
def contains_edges(spark, sf_dir):
    levels = [
        ("HAS_DATABASE", ["db_type"], ["db"]),
        ("HAS_TABLE", ["db"], ["db", "table"]),
        ("HAS_COLUMN", ["db", "table"], ["db", "table", "column"]),
    ]
    return graph.containment_edges(_members(spark, sf_dir), levels)


def _pairs_sql(item: str) -> str:
    return f"""
    p AS (SELECT DISTINCT task, CAST({item} AS VARCHAR) AS i FROM m),
    e AS (SELECT DISTINCT a.i AS src, b.i AS dst FROM p a JOIN p b USING (task) WHERE a.i <> b.i)
    """


def _edges_sql(item: str, kind: str) -> str:
    return f"SELECT DISTINCT CAST({item} AS VARCHAR) AS src, CAST(task AS VARCHAR) AS dst, '{kind}' AS kind FROM m"


@query(f"WITH {_MEMBERS_SQL} {_edges_sql('c', 'RELATED')}")
def related_edges(spark, sf_dir):
    return graph.related_edges(_members(spark, sf_dir), "task", "column")


@query(f"WITH {_MEMBERS_SQL} {_edges_sql('t', 'TABLE_RELATED')}")
def table_edges(spark, sf_dir):
    return graph.related_edges(_members(spark, sf_dir), "task", "table", graph.TABLE_RELATED)


@query(f"WITH {_MEMBERS_SQL}, {_pairs_sql('c')} SELECT src, dst FROM e WHERE CAST(src AS BIGINT) % 100 = 0")
def related_neighbours(spark, sf_dir):
    """The parts whose number is divisible by 100 are asked for."""
    edges = graph.related_edges(_members(spark, sf_dir), "task", "column")
    asked = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    return graph.neighbours(edges, asked.select(F.col("p_partkey").cast("string").alias("src")))


_HASH = "CAST('0x' || substr(md5(dst), 1, 8) AS BIGINT)"


@query(
    f"""
    WITH {_MEMBERS_SQL}, {_pairs_sql('c')},
    d AS (SELECT src, count(*) AS size FROM e GROUP BY 1)
    SELECT src, size, (size + 49) // 50 AS parts, {_HASH} % ((size + 49) // 50) AS part, string_agg(dst, ',' ORDER BY dst) AS related
    FROM e JOIN d USING (src) GROUP BY ALL
    """
)
def related_list(spark, sf_dir):
    edges = graph.related_edges(_members(spark, sf_dir), "task", "column")
    lists = graph.related_lists(edges, limit=50)
    return lists.withColumn("related", F.array_join("related", ","))


@query(
    f"""
    WITH {_MEMBERS_SQL}, {_pairs_sql('t')},
    d AS (SELECT src, (count(*) + 19) // 20 AS parts FROM e GROUP BY 1),
    r AS (SELECT src, {_HASH} % parts AS part, string_agg('"' || dst || '"', ',' ORDER BY dst) AS related FROM e JOIN d USING (src) GROUP BY 1, 2),
    n AS (SELECT CAST(t AS VARCHAR) AS id, count(*) AS uses FROM m GROUP BY 1)
    SELECT id, coalesce(part, 0) AS part,
           '{{"name":"' || id || '","usagecount":' || uses || ',"related_columns":[' || coalesce(related, '') || ']}}' AS document
    FROM n LEFT JOIN r ON id = src
    """
)
def search_doc(spark, sf_dir):
    """Lists of at most about 20 tables, so that popular tables have several documents."""
    members = _members(spark, sf_dir)
    totals = usage.usage_count(members.select(F.col("table").cast("string").alias("id")), ["id"])
    totals = totals.select("id", F.col("id").alias("name"), F.col("column_count").alias("usagecount"))
    related = graph.related_lists(graph.related_edges(members, "task", "table"), limit=20)
    return graph.search_documents(totals, related, ["name", "usagecount"])


@query(
    f"""
    WITH {_CORPUS_SQL}
    SELECT 'h:1:d:' || "table" || ':' || "column" AS id, count(*) AS column_count, CAST(sum(merge_count) AS BIGINT) AS merge_count,
           CAST(sum(sum_count) AS BIGINT) AS sum_count, count(DISTINCT user_id) AS users,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used
    FROM used GROUP BY "table", "column"
    """
)
def usage_merged(spark, sf_dir):
    """Two halves of the corpus, folded, are the whole corpus."""
    tasks = stored(usage.task_usage(corpus(spark, sf_dir)), "tasks")
    halves = [tasks.where(F.pmod("submission", F.lit(2)) == k) for k in (0, 1)]
    users = usage.merge_users(*[usage.first_uses(h, usage.USAGE_KEY, "user", "submitted_at") for h in halves])
    out = usage.merge_usage(*map(usage.accumulate, halves), users)
    shown = F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_used")
    return out.select("id", "column_count", "merge_count", "sum_count", "users", shown)


def _published(spark, sf_dir):
    """Two runs: one is published twice, the other was cut short before its counters and then published."""
    store = MetadataStore(spark, fresh_dir(spark, "metadata"), buckets=4)
    whole = stored(corpus(spark, sf_dir), "corpus")
    runs = {f"run{k}": whole.where(F.pmod("submission", F.lit(2)) == k) for k in (0, 1)}
    store.publish("run0", runs["run0"])
    store._facts(runs["run1"], stored(usage.task_usage(runs["run1"]), "published"), None)
    for run in ("run1", "run0"):
        store.publish(run, runs[run])
    return store


@query(
    f"""
    WITH {_CORPUS_SQL}
    SELECT 'h:1:d:' || "table" || ':' || "column" AS src, CAST(event_id AS VARCHAR) AS dst, 'RELATED' AS kind FROM used
    UNION SELECT 'h:1:d:' || "table", CAST(event_id AS VARCHAR), 'TABLE_RELATED' FROM used
    UNION SELECT 'h:1:d:' || "table", 'h:1:d:' || "table" || ':' || "column", 'HAS_COLUMN' FROM used
    UNION SELECT 'h:1:d', 'h:1:d:' || "table", 'HAS_TABLE' FROM used
    UNION SELECT 'mysql', 'h:1:d', 'HAS_DATABASE' FROM used
    UNION SELECT 'Column', 'h:1:d:' || "table" || ':' || "column", 'vertex' FROM used
    UNION SELECT 'Table', 'h:1:d:' || "table", 'vertex' FROM used
    UNION SELECT 'Database', 'h:1:d', 'vertex' FROM used UNION SELECT 'DBType', 'mysql', 'vertex' FROM used
    UNION SELECT "table", "column", 'catalogue' FROM used
    UNION ALL SELECT 'h:1:d:' || "table" || ':' || "column",
      concat_ws('|', count(*), sum(merge_count), sum(sum_count), count(DISTINCT user_id), strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f')), 'usage'
    FROM used GROUP BY "table", "column"
    """
)
def published_tables(spark, sf_dir):
    """All edges, vertices, catalogue rows and usage counters of the store."""
    store = _published(spark, sf_dir)
    last = F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    counters = F.concat_ws("|", *[F.col(c).cast("string") for c in ("column_count", "merge_count", "sum_count", "users")], last)
    parts = [
        store.read("vertices").select(F.col("kind").alias("src"), F.col("id").alias("dst"), F.lit("vertex").alias("kind")),
        store.read("catalogue").select(F.col("table").alias("src"), F.col("column").alias("dst"), F.lit("catalogue").alias("kind")),
        store.read("usage").select(F.col("id").alias("src"), counters.alias("dst"), F.lit("usage").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts, store.read("edges"))
