"""Queries of the sources and sinks: tables written in each form and read back, each with the SQL of what must come back.

Files go to the session's shared folder, under a name of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import derive, matrix, passes
from lexiloom.plans.materialise import fresh_path
from lexiloom.queries import EVENT_TYPES, query, read
from lexiloom.sources import tables


def _written(df: DataFrame, tag: str, kind: str = "csv") -> str:
    path = fresh_path(df.sparkSession, tag)
    tables.write_table(df, path, kind)
    return path


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what they are, as a matrix."""
    part = read(spark, sf_dir, "customer")
    return part.select(F.concat(F.lit(" "), F.upper("c_name")).alias("Name"), F.col("c_nationkey").cast("double").alias("is far"), F.when(F.col("c_acctbal") > 0, F.round("c_acctbal")).alias('says "yes"'))


@query("""
with c as (select lower(c_name) as word_normalized, c_nationkey::double as a, case when c_acctbal > 0 then round(c_acctbal) end as b from customer)
select word_normalized, 0 as feature_id, 'is far' as feature_text, a as value from c union all select word_normalized, 1, 'says "yes"', b from c""")
def matrix_scan(spark, sf_dir):
    return tables.read_matrix(spark, _written(_wide(spark, sf_dir), "matrix"))


@query("""select * from (values (0, 'is far'), (1, 'says "yes"')) as t(feature_id, feature_text)""")
def header_scan(spark, sf_dir):
    return tables.feature_schema(spark, _written(_wide(spark, sf_dir), "matrix"), "Name")


@query("select doc_id::varchar as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents")
def string_scan(spark, sf_dir):
    """Texts with quotes and line breaks, as CSV; empty ones and nulls are both empty."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return tables.read_csv(spark, _written(docs, "strings"), all_strings=True)


@query("select p_name as word, row_number() over (order by p_partkey) - 1 as place from part where p_size <> 7 and p_name <> ''")
def items_scan(spark, sf_dir):
    """Items in the file's order, by the named column."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_name")).alias("word"))
    path = fresh_path(spark, "items")
    tables.write_ordered(part, path, "p_partkey")
    items = tables.read_items(spark, path)
    from lexiloom.plans.running import numbered

    return numbered(items, F.col("input_seq"), out="place").select("word", "place")


@query("select c_name as word, lower(c_name) as word_normalized, c_mktsegment as category from customer")
def categories_scan(spark, sf_dir):
    return tables.read_categories(spark, _written(read(spark, sf_dir, "customer").select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Category")), "categories"))


@query("select 'pointer' as name, true as refused union all select 'table', false")
def pointer_guard(spark, sf_dir):
    """A pointer to large-file storage is refused, a table is not."""
    out = []
    for name, line in (("pointer", tables.POINTER + "/v1"), ("table", "Name,x")):
        path = fresh_path(spark, name)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)
        try:
            tables.guard_pointer(spark, path)
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


@query("select 'é' as key, '[1, 2]' as value union all select 'model', '\"a\"'")
def manifest_scan(spark, sf_dir):
    path = fresh_path(spark, "manifest")
    tables.write_manifest(spark, {"model": "a", "é": [1, 2]}, path)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in tables.read_manifest(spark, path).items()], "key string, value string")


@query("select 'hello' || chr(10) || 'world' as text, sha256('  hello' || chr(10) || 'world ' || chr(10)) as sha256")
def text_scan(spark, sf_dir):
    """A text file, stripped, and the hash of its bytes."""
    path = fresh_path(spark, "text")
    spark.createDataFrame([("  hello\nworld ",)], "value string").coalesce(1).write.text(path)
    hashes = tables.file_hashes(spark, path).where("path like '%part-%'")
    return hashes.select(F.lit(tables.read_text(spark, path)).alias("text"), "sha256")


@query("select doc_id, coalesce(lang, '') as lang from documents")
def json_sink(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return spark.read.schema(docs.schema).json(_written(docs, "json", "json"))


@query("select 'no resume' as run, true as refused union all select 'resume', false")
def overwrite_guard(spark, sf_dir):
    """Without resume, a table that is there is an error; with it, the table is replaced."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey")
    path, out = _written(nation, "guard", "parquet"), []
    for run, resume in (("no resume", False), ("resume", True)):
        try:
            tables.write_table(nation, path, resume=resume)
            out.append((run, False))
        except Exception:
            out.append((run, True))
    return spark.createDataFrame(out, "run string, refused boolean")


@query("""
select e.event_id, case when e.event_id % 3 = 0 then 'second' else 'first' end as said, n.rows as log_rows, n.rows as seqs from events e, (select count(*) + count_if(event_id % 3 = 0) as rows from events) n""")
def log_append(spark, sf_dir):
    """Two runs appended to a log: the last row of each event, and that no two rows share a number."""
    events = read(spark, sf_dir, "events").select("event_id").repartition(7)
    path = fresh_path(spark, "log")
    tables.append_log(events.withColumn("said", F.lit("first")), path, 1)
    tables.append_log(events.where("event_id % 3 = 0").withColumn("said", F.lit("second")), path, 2)
    log = spark.read.parquet(path)
    return derive.latest(log, ["event_id"], "ingest_seq").select("event_id", "said").crossJoin(log.agg(F.count("*").alias("log_rows"), F.count_distinct("ingest_seq").alias("seqs")))


@query("""
with d as (select doc_id, doc_id % 3 as r from documents)
select 'r' || doc_id as response_id, case when r = 0 then 'b,c' else 'a' end as features, case when r = 1 then 'failed' else '' end as parse_error from d""")
def log_scan(spark, sf_dir):
    """A response log of several CSV files, the later of which come by name: the last row of each response counts."""
    names = [c.split() for c in tables.LOG_SCHEMA.split(", ")]
    docs = read(spark, sf_dir, "documents").select("doc_id")

    def rows(df, features, error):
        own = {"response_id": F.concat(F.lit("r"), "doc_id"), "features_json": features, "parse_error": error, "raw_json": F.lit('{\n"x": 1}')}
        return df.select(F.col("doc_id").alias("__id"), *[own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names])

    first = rows(docs, F.lit('["a"]'), F.when(F.col("doc_id") % 3 == 1, "failed"))
    later = rows(docs.where("doc_id % 3 = 0"), F.lit('["b", "c"]'), F.lit(None))
    path = fresh_path(spark, "responses")
    both = first.withColumn("__run", F.lit(0)).unionByName(later.withColumn("__run", F.lit(1)))
    tables.write_table(both.repartitionByRange(8, "__run", "__id").sortWithinPartitions("__run", "__id").drop("__run", "__id"), path, "csv")
    log = tables.read_generation_log(spark, path)
    return derive.latest(log, ["response_id"], "ingest_seq").select("response_id", F.array_join("features", ",").alias("features"), "parse_error")


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders")
def ordered_export(spark, sf_dir):
    """A table exported in order and read back in the files' order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = fresh_path(spark, "export")
    tables.write_ordered(orders, path, "o_totalprice", "o_orderkey")
    back = tables.in_file_order(tables.read_csv(spark, path, "o_orderkey long, o_totalprice double").select("o_orderkey", "_metadata.file_path"), "seq")
    from lexiloom.plans.running import numbered

    return numbered(back, F.col("seq"), out="place").select("o_orderkey", "place")


# Expansion.


@query("""
with items as (select n_name as word, lower(n_name) as w, n_nationkey as seq from nation union all select 'New ' || n_name, 'new ' || lower(n_name), 100 + n_nationkey from nation union all select '  new ' || n_name || ' ', 'new ' || lower(n_name), 200 + n_nationkey from nation),
plural as (select *, case when w like 'new %' and w < 'new j' then w || 's' else w end as word_normalized from items)
select word_normalized, word from (select *, row_number() over (partition by word_normalized order by seq) as rn from plural) where rn = 1 and word_normalized not in (select lower(n_name) from nation)""")
def plural_items(spark, sf_dir):
    """Items that a matrix lacks, some of them taken to their plural by a table whose last row counts."""
    nation = read(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    new = F.concat(F.lit("New "), "n_name")
    items = nation.select(F.col("n_name").alias("word"), F.col("n_nationkey").cast("long").alias("seq"))
    items = items.union(nation.select(new, F.col("n_nationkey") + 100)).union(nation.select(F.concat(F.lit("  new "), "n_name", F.lit(" ")), F.col("n_nationkey") + 200))
    path = fresh_path(spark, "items")
    tables.write_ordered(items, path, "seq")
    named = nation.where(F.lower(new) < "new j")
    plurals = named.select(new.alias("singular"), F.lit("wrong").alias("plural"), F.lit(0).alias("n")).union(named.select(F.lower(new), F.concat(new, F.lit("s")), F.lit(1)))
    other = fresh_path(spark, "plurals")
    tables.write_ordered(plurals, other, "n", "singular")
    known = nation.select(F.lower("n_name").alias("word_normalized"))
    return matrix.new_items(tables.read_items(spark, path), known, tables.read_plurals(spark, other)).select("word_normalized", "word")


@query("""
with k as (select user_id, event_type, event_id % 5 as v, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events where user_id % 2 = 1),
cells as (select user_id, event_type, v from k where rn = 1),
""" + "wide as (select user_id, " + ", ".join(f"coalesce(max(v) filter (event_type = '{t}'), 0)::double as \"{t}\"" for t in EVENT_TYPES) + """, count_if(v > 0) as n_positive_features, count_if(v = 4) as n_adjudicated, bool_or(v = 3) as needs_human_audit from cells group by 1),
old as (select user_id, """ + ", ".join(f"count_if(event_type = '{t}')::double as \"{t}\"" for t in EVENT_TYPES) + """ from events where user_id % 2 = 0 group by 1)
select 'u' || user_id as word, 'original' as source, true as in_original, 'human' as completion_method, """ + ", ".join(f'"{t}"' for t in EVENT_TYPES) + """, null as n_positive_features, null as n_adjudicated, null as needs_human_audit from old
union all select 'U' || user_id, 'expansion', false, 'model', """ + ", ".join(f'"{t}"' for t in EVENT_TYPES) + """, n_positive_features, n_adjudicated, needs_human_audit from wide""")
def expansion_pass(spark, sf_dir):
    """Users with even numbers are a matrix of counts; those with odd ones are added from resolved cells."""
    events = read(spark, sf_dir, "events")
    name = F.concat(F.lit("u"), "user_id")
    old = events.where("user_id % 2 = 0").groupBy(name.alias("Name")).agg(*[F.count_if(F.col("event_type") == t).cast("double").alias(t) for t in EVENT_TYPES])
    odd = events.where("user_id % 2 = 1").withColumn("feature_id", F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1)
    cells = derive.latest(odd, ["user_id", "feature_id"], "event_id").withColumn("final_value", (F.col("event_id") % 5).cast("double"))
    resolutions = cells.select(name.alias("word_normalized"), "feature_id", "final_value", (F.col("final_value") == 4).alias("adjudicated"), (F.col("final_value") == 3).alias("needs_audit"))
    items = events.select("user_id").distinct().select(F.concat(F.lit("U"), "user_id").alias("word"), F.col("user_id").alias("input_seq"))
    out = passes.run_expansion(old, "Name", items, resolutions)
    return out.select("word", "source", "in_original", "completion_method", *EVENT_TYPES, "n_positive_features", "n_adjudicated", "needs_human_audit")
