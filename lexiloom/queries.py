"""The engine's own queries over the driver's tables, each with the SQL that restates its rule.

The tables stand in for the engine's relations: documents for a response log,
line items for votes, embeddings for rows of a matrix, and so on; every query
reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.json_rules import validate_judgement
from lexiloom.functions.prompts import PROMPTS
from lexiloom.operators import derive, matrix, metrics, resolve
from lexiloom.plans import jobs
from lexiloom.plans.materialise import fresh_path
from lexiloom.streaming.ingest import current, ingest, run_windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENT_TYPES = ("click", "view", "purchase", "signup", "logout")
SEED = 42


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The response log: documents are responses, their lines the features.

def _folded(x: str) -> str:
    """Full case folding, character by character, by Unicode's rule."""
    singles, to, several = T.casefold_table()
    out = f"translate(lower({x}), '{singles}', '{to}')"
    for ch, text in several.items():
        out = f"replace({out}, '{ch}', '{text}')"
    return out


_FOLD = rf"trim(regexp_replace(regexp_replace(regexp_replace({_folded('f')}, '^\s+|\s+$', '', 'g'), '\.+$', ''), '\s+', ' ', 'g'))"
_LONG = f"select doc_id, lang, source, i, f, {_FOLD} as norm from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as f, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)"


def variants_sql(kind: str, version: str) -> str:
    """The prompts of a kind as a relation of v and text."""
    rows = [f"('{v}', '{text.replace(chr(39), chr(39) * 2)}')" for (k, w, v), text in PROMPTS.items() if (k, w) == (kind, version)]
    return f"select * from (values {', '.join(rows)}) as t(v, text)"


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("response_id"), F.col("doc_id").alias("ingest_seq"), F.col("lang").alias("prompt_variant"), F.col("source").alias("word_normalized"), F.split("text", "\n").alias("features"))


@query(f"""
with long as ({_LONG}), per as (
    select lang, source, norm, doc_id, arg_min(f, i) as f from long where norm <> '' group by all
), totals as (select lang, source, count(distinct doc_id) as n from documents where text is not null group by all)
select p.lang as prompt_variant, p.source as word_normalized, norm as feature_text_normalized, arg_min(f, doc_id) as feature_text_example,
       count(*) as response_frequency, any_value(n) as valid_response_count, count(*) / any_value(n) as response_proportion
from per p join totals t on p.lang = t.lang and p.source = t.source group by 1, 2, 3""")
def feature_frequencies(spark, sf_dir):
    return derive.frequencies(response_log(spark, sf_dir), ["prompt_variant", "word_normalized"]).where("feature_text_normalized <> ''")


@query(f"select doc_id as response_id, cast(i as int) as feature_rank, f as feature_text, norm as feature_text_normalized from ({_LONG})")
def features_long(spark, sf_dir):
    return derive.explode_features(response_log(spark, sf_dir))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(lower(strip_accents(text)), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as normalized_md5 from documents")
def normalize_words(spark, sf_dir):
    return T.normalize_exact(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "normalized").select("doc_id", F.md5("normalized").alias("normalized_md5"))


# Identities and plans.


@query("select p_partkey, sha256(p_name || '|' || p_size) as row_hash from part")
def row_hashes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.row_hash("p_name", "p_size").alias("row_hash"))


_SEED = f"cast(cast('0x' || substr(sha256('{SEED}|' || p_name || '|' || r), 1, 16) as ubigint) & 9223372036854775807 as bigint)"


@query(f"""
with s as (select p_partkey, r as replicate_id, {_SEED} as sampling_seed from part, (select unnest(range(3)) as r))
select p_partkey, cast(replicate_id as int) as replicate_id, sampling_seed, cast((cast(sampling_seed as hugeint) + 1000000007) % 9223372036854775808 as bigint) as retry_seed from s""")
def sampling_seeds(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replicate_id"))
    return rows.withColumn("sampling_seed", T.sampling_seed(SEED, "p_name", "replicate_id")).select("p_partkey", "replicate_id", "sampling_seed", T.retry_seed("sampling_seed", 1).alias("retry_seed"))


@query(f"""
with s as (select p_partkey, p_name, v, r, {_SEED} as seed, sha256(text || chr(10) || '---' || chr(10) || '{{"target_word":"' || p_name || '"}}') as h from part, ({variants_sql("generation", "v3")}), (select unnest(range(2)) as r))
select p_partkey, v as prompt_variant, cast(r as int) as replicate_id, seed as sampling_seed, sha256(p_name || '|' || v || '|' || r || '|some-model|' || seed || '|' || h) as response_id from s""")
def job_plan(spark, sf_dir):
    words = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("word"))
    return jobs.generation_jobs(words, ("A", "B", "C"), 2, SEED, "some-model").select("p_partkey", "prompt_variant", "replicate_id", "sampling_seed", "response_id")


@query("""
with o as (select p_partkey, row_number() over (order by p_partkey) - 1 as i, count(*) over () as n from part),
p as (select distinct round_even(j * (n - 1) / 36.0, 0) as i from (select max(n) as n from o), (select unnest(range(37)) as j))
select p_partkey from o where n <= 37 or i in (select i from p)""")
def even_subset(spark, sf_dir):
    return jobs.even_subset(read(spark, sf_dir, "part").select("p_partkey"), 37, "p_partkey")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem group by 1 having count(l_suppkey) >= 30)")
def resume_pending(spark, sf_dir):
    votes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("judge_id"))
    return jobs.pending(read(spark, sf_dir, "part").select("p_partkey"), jobs.completed_pairs(votes, ["p_partkey"], 30), ["p_partkey"])


# Compaction of a log: line items of an order are its rows.

_SEQ = ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")


def _last(condition: str, key: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in _SEQ)
    return f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as shipdate from (select *, row_number() over (partition by {key} order by {order}) as rn from lineitem where {condition}) where rn = 1"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"))


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("parse_error", F.when(F.col("l_linestatus") == "F", "failed").otherwise(""))


@query(_last("true", "l_orderkey", "desc"))
def latest_log(spark, sf_dir):
    return _shown(derive.latest(line_log(spark, sf_dir), ["l_orderkey"], *_SEQ))


@query(_last("l_linestatus <> 'F'", "l_orderkey", "desc"))
def latest_valid_log(spark, sf_dir):
    return _shown(derive.latest_valid(line_log(spark, sf_dir), ["l_orderkey"], *_SEQ))


@query(_last("true", "l_partkey", "asc"))
def first_wins(spark, sf_dir):
    return _shown(derive.earliest(line_log(spark, sf_dir), ["l_partkey"], *_SEQ))


@query(f"""
with last as (select l_returnflag, l_linestatus from (select *, row_number() over (partition by l_orderkey order by {", ".join(f"{c} desc" for c in (*_SEQ, "l_returnflag", "l_linestatus"))}) as rn from lineitem) where rn = 1),
c as (select l_returnflag, count(*) as responses, count_if(l_linestatus <> 'F') as valid from last group by 1)
select r.l_returnflag, log_rows, responses, cast(valid as bigint) as valid, cast(responses - valid as bigint) as failed from (select l_returnflag, count(*) as log_rows from lineitem group by 1) r join c on r.l_returnflag = c.l_returnflag""")
def manifest_counts(spark, sf_dir):
    return derive.counters(line_log(spark, sf_dir), "l_returnflag", ["l_orderkey"], *_SEQ, "l_returnflag", "l_linestatus")


# Validation: events make good, fenced, Python-like, over-full, cut and mismatched answers.


@query("""
with e as (select event_id, event_id % 6 as form, cast(props->>'$.k' as bigint) % 6 as v from events)
select event_id, case when form > 2 or v = 5 then null else cast(v as double) end as feature_value,
       case form when 3 then 'Schema validation error: unknown key' when 4 then 'JSON parse error: not one JSON value'
            else case when v = 5 then 'Schema validation error: feature_value' when form = 5 then 'Returned word does not match' else '' end end as parse_error
from e""")
def json_validate(spark, sf_dir):
    form = F.col("event_id") % 6
    value = (F.get_json_object("props", "$.k").cast("long") % 6).cast("string")
    word = F.when(form == 5, "other").otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"word": "'), word, F.lit('", "feature_id": '), F.col("user_id").cast("string"), F.lit(', "feature_value": '), value, F.lit(', "confidence": 0.5, "ambiguous": '), F.when(form == 2, "None").otherwise("null"), F.when(form == 3, ', "more": 1').otherwise(""), F.lit(', "reason": "so"'), F.when(form == 4, "").otherwise("}"))
    raw = F.when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    checked = read(spark, sf_dir, "events").withColumn("v", validate_judgement(raw, F.col("event_type"), F.col("user_id")))
    return checked.select("event_id", F.col("v.record.feature_value").alias("feature_value"), F.col("v.parse_error").alias("parse_error"))


# Votes: line items 1 to 3 of an order are its judges', 4 to 6 its adjudicators', 7 its verifier's.

_LINES = f"""lines as (
    select l_orderkey, l_linenumber as j, case when l_linestatus = 'F' and l_tax < 0.01 then null else least(4.0, l_orderkey % 3 + (cast(floor(l_quantity) as bigint) % 10) * 0.25)::double end as v,
           (0.7::double + 2 * (l_discount + 0.0)::double) as c, l_returnflag = 'R' as amb, (l_linestatus = 'F' and l_tax < 0.01) as err
    from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {", ".join((*_SEQ, "l_discount", "l_tax", "l_returnflag", "l_linestatus"))}) as rn from lineitem) where rn = 1),
judged as (
    select l_orderkey, list(v order by j) filter (v is not null) as vs, list(v order by j) filter (v is not null)[1] as first, count(v) as n, min(v) as lo, max(v) as hi, avg(v) as mean, coalesce(bool_or(err), false) as err, count_if(amb) as n_amb, count(distinct round_even(v, 0)) as n_rounded
    from lines where j <= 3 group by 1),
modes as (
    select l_orderkey, r as mode from (select l_orderkey, r, row_number() over (partition by l_orderkey order by count(*) desc, r) as rn from (select l_orderkey, round_even(v, 0) as r from lines where j <= 3 and v is not null) group by 1, 2) where rn = 1),
dissent as (
    select l.l_orderkey, bool_or(round_even(v, 0) <> mode and c >= 0.8) as strong from lines l join modes m on l.l_orderkey = m.l_orderkey where j <= 3 and v is not null group by 1),
triggered as (
    select g.*, mode, case when g.err then 'parse_error' when n < 3 then 'insufficient_valid_votes' when hi - lo >= 2 then 'range_' || printf('%.1f', round_even(hi - lo, 1))
        when n_rounded > 1 and strong then 'high_confidence_dissent' when n_amb >= 2 then 'ambiguous_majority' end as trigger
    from judged g left join modes m on g.l_orderkey = m.l_orderkey left join dissent d on g.l_orderkey = d.l_orderkey),
passed as (
    select *, case when n = 0 then null when n_rounded = 1 then first else mean end as p_value, case when n = 0 then 'failed' when n_rounded = 1 then 'unanimous' else 'mean_small_disagreement' end as p_method, n = 0 as p_audit from triggered),
panel as (
    select t.l_orderkey, a, b, c, (case when a is null then 0 else 1 end) + (case when b is null then 0 else 1 end) + (case when c is null then 0 else 1 end) as k,
           coalesce(cast(abs(a - b) <= 0.5 as int), 0) as ab, coalesce(cast(abs(a - c) <= 0.5 as int), 0) as ac, coalesce(cast(abs(b - c) <= 0.5 as int), 0) as bc
    from triggered t left join (select l_orderkey, max(v) filter (j = 4) as a, max(v) filter (j = 5) as b, max(v) filter (j = 6) as c from lines group by 1) p on t.l_orderkey = p.l_orderkey),
settled as (
    select l_orderkey, case when k = 0 then null when k = 1 then coalesce(a, b, c) when ab + ac + bc > 0 then (ab * (coalesce(a, 0) + coalesce(b, 0)) + ac * (coalesce(a, 0) + coalesce(c, 0)) + bc * (coalesce(b, 0) + coalesce(c, 0))) / (2.0::double * (ab + ac + bc)) else (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / k::double end as s_value,
           case when k = 0 then 'adjudicator_failed' when k = 1 then 'adjudicator_single' when ab + ac + bc > 0 then 'adjudicator_agree' else 'adjudicator_disagree_provisional_mean' end as s_method,
           k = 0 or (k > 1 and ab + ac + bc = 0) as s_audit from panel),
resolved as (
    select p.l_orderkey, case when trigger is null then p_value else s_value end as final_value, case when trigger is null then p_method else s_method end as method,
           case when trigger is null then p_audit else s_audit end as needs_audit, trigger is not null as adjudicated, trigger as adjudication_trigger
    from passed p join settled s on p.l_orderkey = s.l_orderkey),
verified as (
    select r.l_orderkey, final_value as pre, v7, case when final_value is null or final_value < 1 then 'not_candidate' when v7 is null then 'parse_error' when v7 >= 1 then 'retained' else 'rejected' end as status, needs_audit
    from resolved r left join (select l_orderkey, v as v7 from lines where j = 7) q on r.l_orderkey = q.l_orderkey)"""


def line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.earliest(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *_SEQ, "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    failed = (F.col("l_linestatus") == "F") & (F.col("l_tax") < 0.01)
    value = F.least(F.lit(4.0), F.col("l_orderkey") % 3 + (F.floor("l_quantity") % 10) * 0.25)
    return rows.select("l_orderkey", F.col("l_linenumber").alias("judge_id"), F.when(~failed, value).alias("value"), (F.lit(0.7) + 2 * (F.col("l_discount") + F.lit(0.0))).alias("confidence"), (F.col("l_returnflag") == "R").alias("ambiguous"), F.when(failed, "failed").otherwise("").alias("parse_error"))


def _judges(spark, sf_dir):
    return line_votes(spark, sf_dir).where("judge_id <= 3")


def _resolved(spark, sf_dir):
    votes = line_votes(spark, sf_dir)
    return resolve.resolve(votes.where("judge_id <= 3"), votes.where("judge_id between 4 and 6"), ["l_orderkey"])


def _verified(spark, sf_dir):
    answers = line_votes(spark, sf_dir).where("judge_id = 7").select("l_orderkey", F.col("value").alias("verified_value"))
    return resolve.verify(_resolved(spark, sf_dir), answers, ["l_orderkey"])


@query(f"with {_LINES} select l_orderkey, cast(n as int) as n_valid, lo as min_value, hi as max_value, hi - lo as value_range, mean as mean_value, mode as mode_value from triggered")
def votes(spark, sf_dir):
    return resolve.summarise(resolve.gather(_judges(spark, sf_dir), ["l_orderkey"])).drop("votes")


@query(f"with {_LINES} select l_orderkey, trigger as adjudication_trigger from triggered")
def disagreement(spark, sf_dir):
    return resolve.gather(_judges(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", resolve.trigger().alias("adjudication_trigger"))


@query(f"with {_LINES} select l_orderkey, p_value as final_value, p_method as method, p_audit as needs_audit from passed")
def resolutions(spark, sf_dir):
    return resolve.gather(_judges(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", resolve.first_pass().alias("r")).select("l_orderkey", "r.*")


@query(f"with {_LINES} select * from resolved")
def adjudicated(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"""with {_LINES} select l_orderkey, pre as pre_verification_value, status as verification_status, case when status = 'not_candidate' then null else v7 end as verified_value,
case status when 'retained' then v7 when 'rejected' then 0.0 else pre end as final_value, needs_audit or status = 'parse_error' as needs_audit from verified""")
def verified(spark, sf_dir):
    return _verified(spark, sf_dir).select("l_orderkey", "pre_verification_value", "verification_status", "verified_value", "final_value", "needs_audit")


@query(f"""with {_LINES} select r.l_orderkey % 97 as word_normalized, cast(count_if(final_value > 0) as bigint) as n_positive_features, cast(count_if(adjudicated) as bigint) as n_adjudicated, bool_or(needs_audit) as needs_human_audit,
round(any_value(conf), 9) as mean_feature_confidence, any_value(low) as n_low_confidence, any_value(amb) as n_ambiguous
from resolved r join (select l_orderkey % 97 as w, avg(c) as conf, cast(count_if(c < 0.8) as bigint) as low, cast(count_if(amb) as bigint) as amb from lines where j <= 3 group by 1) q on r.l_orderkey % 97 = q.w group by 1""")
def word_rollup(spark, sf_dir):
    word = (F.col("l_orderkey") % 97).alias("word_normalized")
    rows = matrix.rollup(_resolved(spark, sf_dir).withColumn("word_normalized", word), _judges(spark, sf_dir).withColumn("word_normalized", word))
    return rows.withColumn("mean_feature_confidence", F.round("mean_feature_confidence", 9))


# Matrices, occurrences and coverage.


def _covered(spark, sf_dir):
    known = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("word_normalized"))
    return matrix.covered(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), known, "doc_id")


_COVERED = "(select d.doc_id, lang, source, d.doc_id in (select doc_id from labels) as covered from documents d)"
_RATE = "count(*) as n_items, cast(count_if(covered) as bigint) as n_covered, coalesce(count_if(covered) / nullif(count(*), 0), 0.0) as coverage_rate"


@query(f"select {_RATE} from {_COVERED}")
def coverage_summary(spark, sf_dir):
    return matrix.coverage_summary(_covered(spark, sf_dir))


@query(f"select source, {_RATE}, round_even(count_if(covered) / count(*), 4) = 1.0 as is_complete from {_COVERED} where source is not null group by 1")
def coverage_by_list(spark, sf_dir):
    return matrix.coverage_by(_covered(spark, sf_dir), "source")


@query(f"select {_RATE} from {_COVERED} where lang = 'en'")
def lure_coverage(spark, sf_dir):
    return matrix.lure_coverage(_covered(spark, sf_dir).withColumn("is_critical_lure", F.when(F.col("lang") == "en", "Yes").otherwise("0")), "is_critical_lure")


@query(r"""
with items as (select c_custkey as i, c_name as word from customer union all select c_custkey + 1000000000, ' ' || upper(c_name) || ' ' from customer),
k as (select word, lower(strip_accents(trim(word))) as w, row_number() over (partition by lower(strip_accents(trim(word))) order by i) as rn from items)
select w as word_normalized, word from k where rn = 1 and w not in (select lower(strip_accents(trim(c_name))) from customer where c_acctbal > 0)""")
def expand_items(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    known = customer.where("c_acctbal > 0").select(T.normalize_word("c_name").alias("word_normalized"))
    again = customer.select(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("word"), (F.col("c_custkey") + 1_000_000_000).alias("input_seq"))
    items = customer.select(F.col("c_name").alias("word"), F.col("c_custkey").alias("input_seq")).union(again)
    return matrix.new_items(items, known).select("word_normalized", "word")


@query("""
select c_custkey, coalesce(c_mktsegment, '') as word, case when c_acctbal > 0 then 'original' else 'expansion' end as source, c_acctbal > 0 as in_original, not c_acctbal > 0 as in_expansion,
       case when c_acctbal > 0 then 'human' else 'model' end as completion_method from customer""")
def expanded_matrix(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("word_normalized"), "c_acctbal")
    added = rows.where("not c_acctbal > 0").select("c_custkey", "word_normalized", F.col("word_normalized").alias("word"))
    out = matrix.expand(rows.where("c_acctbal > 0").select("c_custkey", "word_normalized", F.lit(None).cast("string").alias("word")), added)
    return out.select("c_custkey", F.coalesce("word", F.lit("")).alias("word"), "source", "in_original", "in_expansion", "completion_method")


@query("select o_orderkey, o_custkey as word_key, case when c_custkey is null then 'missing' else 'original' end as source from orders left join (select c_custkey from customer where c_acctbal > 0) on o_custkey = c_custkey")
def occurrence_join(spark, sf_dir):
    words = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("word_normalized"), F.lit("original").alias("source"))
    return matrix.annotate_occurrences(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("word_key")), words)


def _split_sql(table: str, stratum: str, fraction: float) -> str:
    return f"""select doc_id, stratum, row_number() over (partition by stratum order by sha256('split|' || doc_id), doc_id) <= greatest(1, round_even(count(*) over (partition by stratum) * {fraction}, 0)) as is_test
from (select doc_id, {stratum} as stratum from {table})"""


@query(_split_sql("documents", "coalesce(lang, 'unknown')", 0.2))
def word_split(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return jobs.stratified_split(rows, "doc_id", F.coalesce("lang", F.lit("unknown")), 0.2, "split").select("doc_id", "stratum", "is_test")


@query(_split_sql("labels", "case when quality > 0 then 'positive' else 'zero' end", 0.25))
def cell_split(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return jobs.stratified_split(rows, "doc_id", F.when(F.col("quality") > 0, "positive").otherwise("zero"), 0.25, "split").select("doc_id", "stratum", "is_test")


_CELLS = "events_cells as (select user_id, " + ", ".join(f"cast(least(4, count_if(event_type = '{t}')) as double) as \"{t}\"" for t in EVENT_TYPES) + " from events group by 1)"


def _event_cells(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.select("user_id", "event_type", F.least(F.lit(4.0), F.col("n").cast("double")).alias("value"))


@query(f"with {_CELLS} select * from events_cells")
def matrix_pivot(spark, sf_dir):
    return matrix.pivot(_event_cells(spark, sf_dir), "user_id", EVENT_TYPES, "event_type")


@query(f"with {_CELLS}" + " union all ".join(f" select user_id, {i} as feature_id, '{t}' as feature_text, \"{t}\" as value from events_cells" for i, t in enumerate(EVENT_TYPES)))
def matrix_unpivot(spark, sf_dir):
    return matrix.unpivot(matrix_pivot(spark, sf_dir), "user_id", EVENT_TYPES)


@query(f"with {_CELLS} select user_id, [" + ", ".join(f'"{t}"' for t in EVENT_TYPES) + "]::varchar as vector from events_cells")
def matrix_vectors(spark, sf_dir):
    number = F.when(F.lit(False), 0)
    for i, t in enumerate(EVENT_TYPES):
        number = number.when(F.col("event_type") == t, i)
    rows = matrix.vectors(_event_cells(spark, sf_dir).withColumn("feature_id", number), "user_id", len(EVENT_TYPES))
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "), F.lit("]")).alias("vector"))


@query("select count(*) as n_words, avg(n) as positive_density from (select user_id, count(distinct event_type) as n from events group by 1)")
def density(spark, sf_dir):
    return metrics.density(_event_cells(spark, sf_dir), "user_id")


# Scores: labels are gold, lengths in steps of 500 the prediction.

_SCORED = "scored as (select l.doc_id, quality::double as gold, toxic, d.n_chars as score, cast(least(4, d.n_chars // 500) as double) as pred from labels l join documents d on l.doc_id = d.doc_id)"


def _scored(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("double").alias("gold"), "toxic", F.col("n_chars").alias("score"), F.least(F.lit(4.0), F.expr("n_chars div 500").cast("double")).alias("pred"))


def _prf(undefined: str) -> str:
    return f"coalesce(tp / nullif(tp + fp, 0), {undefined}) as precision, coalesce(tp / nullif(tp + fn, 0), {undefined}) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), {undefined}) as f1"


def _tally(gold: str, pred: str) -> str:
    return ", ".join(f"cast(count_if({'' if g else 'not '}({gold}) and {'' if p else 'not '}({pred})) as bigint) as {n}" for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))


@query(f"with {_SCORED}, c as (select {_tally('gold > 0', 'pred > 0')}, avg(abs(pred - gold)) as mae, sqrt(avg((pred - gold) * (pred - gold))) as rmse from scored) select *, {_prf('0.0')}, (tp + tn) / (tp + fp + fn + tn) as accuracy from c")
def cell_metrics(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir))


@query(f"with {_SCORED}, c as (select t::double as threshold, {_tally('gold > 0', 'pred >= t')} from scored, (select unnest([1.0, 1.5, 2.0, 2.5, 3.0]) as t) group by 1) select *, {_prf('0.0')} from c")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_scored(spark, sf_dir))


@query(f"""
with {_SCORED}, s as (select *, case when pred < 1 then 'not_candidate' when toxic = 1 then 'rejected' else 'retained' end as status from scored),
f as (select *, case status when 'rejected' then 0.0 else pred end as final from s),
c as (select 'pre' as stage, {_tally('gold > 0', 'pred >= 1')} from f union all select 'post', {_tally('gold > 0', 'final >= 1')} from f),
n as (select cast(count_if(status = 'retained') as bigint) as n_retained, cast(count_if(status = 'rejected') as bigint) as n_rejected from f)
select c.*, n_retained + n_rejected as n_candidates, n_retained, n_rejected, {_prf("'nan'::double")} from c, n""")
def verification_delta(spark, sf_dir):
    status = F.when(F.col("pred") < 1, "not_candidate").when(F.col("toxic") == 1, "rejected").otherwise("retained")
    rows = _scored(spark, sf_dir).withColumn("verification_status", status).withColumns({"pre_verification_value": F.col("pred"), "final_value": F.when(F.col("verification_status") == "rejected", 0.0).otherwise(F.col("pred"))})
    return metrics.verification_delta(rows)


@query(f"""
with {_SCORED}, r as (select gold, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from scored),
c as (select sum(rk) filter (gold > 0) as s, count_if(gold > 0)::double as p, count_if(not gold > 0)::double as q from r)
select cast(p as bigint) as n_positive, cast(q as bigint) as n_negative, (s - p * (p + 1) / 2) / (p * q) as roc_auc from c""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir))


@query(f"""
with {_SCORED}, g as (select score, count(*) as n, count_if(gold > 0) as p from scored group by 1),
c as (select p, sum(n) over (order by score desc) as seen, sum(p) over (order by score desc) as hits from g)
select cast(sum(p) as bigint) as n_positive, round(sum(p * hits::double / seen::double) / sum(p), 9) as average_precision from c""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir)).withColumn("average_precision", F.round("average_precision", 9))


@query(f"""
with {_SCORED}, r as (select gold, score, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as a, rank() over (order by gold) + (count(*) over (partition by gold) - 1) / 2.0 as b from scored)
select round(corr(score, gold), 6) as pearson, round(corr(a, b), 6) as spearman from r""")
def rank_correlation(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.agg(F.round(metrics.pearson("score", "gold"), 6).alias("pearson")).crossJoin(metrics.spearman(rows, "score", "gold").select(F.round("spearman", 6).alias("spearman")))


# Geometry: embeddings are gold vectors, their values in steps of a tenth the predicted ones.

_LONG_VECTORS = "cells as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as g, floor(unnest(embedding)::double * 10 + 0.5) / 10 as p from embeddings)"


def _vectors(spark, sf_dir):
    gold = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", gold.alias("gold"), F.transform(gold, lambda x: F.floor(x * 10 + 0.5).cast("double") / 10).alias("pred"))


@query(f"""
with {_LONG_VECTORS}, r as (select *, rank() over (partition by vec_id order by g) + (count(*) over (partition by vec_id, g) - 1) / 2.0 as rg, rank() over (partition by vec_id order by p) + (count(*) over (partition by vec_id, p) - 1) / 2.0 as rp from cells)
select vec_id, round(sum(g * p) / (sqrt(sum(g * g)) * sqrt(sum(p * p)) + 1e-12), 6) as cosine, round(corr(g, p), 6) as pearson, round(corr(rg, rp), 6) as spearman from r group by 1""")
def word_metrics(spark, sf_dir):
    return metrics.word_metrics(_vectors(spark, sf_dir)).select("vec_id", *[F.round(c, 6).alias(c) for c in ("cosine", "pearson", "spearman")])


@query(f"""
with {_LONG_VECTORS}, r as (select vec_id, row_number() over (partition by vec_id order by g desc, i desc) as a, row_number() over (partition by vec_id order by p desc, i desc) as b from cells)
select vec_id, count_if(a <= 10 and b <= 10) / 10 as topk_recall from r group by 1""")
def topk_recall(spark, sf_dir):
    return metrics.topk_recall(_vectors(spark, sf_dir)).select("vec_id", "topk_recall")


_PAIRS = "pairs as (select least(a.label::varchar, b.label::varchar) as c, greatest(a.label::varchar, b.label::varchar) as d, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id < b.vec_id)"


@query(f"with {_PAIRS} select c as category_a, d as category_b, count(*) as n_pairs, round(avg(s), 6) as mean_similarity from pairs group by 1, 2")
def category_similarity(spark, sf_dir):
    return metrics.category_similarity(_vectors(spark, sf_dir), "label", "gold").where("n_pairs > 0").withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("select median(c_acctbal) as account, median(c_nationkey)::double as nation, null::double as nothing from customer")
def medians(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    one = lambda df, column, name: metrics.median(df, column).withColumnRenamed("median", name)
    return one(rows, "c_acctbal", "account").crossJoin(one(rows, "c_nationkey", "nation")).crossJoin(one(rows.where("c_custkey < 0"), "c_acctbal", "nothing"))


_BOTH = "v as (select vec_id, label, embedding::double[] as g, list_transform(embedding, lambda x: floor(x::double * 10 + 0.5) / 10) as p from embeddings), both_ as (select round(list_cosine_similarity(a.g, b.g), 12) as g, round(list_cosine_similarity(a.p, b.p), 12) as p from v a join v b on a.vec_id < b.vec_id), ranked as (select g, p, rank() over (order by g) + (count(*) over (partition by g) - 1) / 2.0 as rg, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from both_)"


@query(f"with {_BOTH} select round(corr(g, p), 6) as pairwise_pearson, round(corr(rg, rp), 6) as pairwise_spearman from ranked")
def pairwise_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return metrics.pairwise_pearson(v).crossJoin(metrics.pairwise_spearman(v, "vec_id")).select(F.round("pairwise_pearson", 6).alias("pairwise_pearson"), F.round("pairwise_spearman", 6).alias("pairwise_spearman"))


@query(f"""
with {_BOTH}, {_LONG_VECTORS}, each_ as (select vec_id, list_cosine_similarity(g, p) as c, len(list_filter(g, lambda x: x > 0)) as ng, len(list_filter(p, lambda x: x > 0)) as np from v),
pairs as (select a.label = b.label as same, list_cosine_similarity(a.g, b.g) as g, list_cosine_similarity(a.p, b.p) as p from v a join v b on a.vec_id < b.vec_id),
n as (select a.vec_id, b.vec_id as o, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.g, b.g), 12) desc, b.vec_id) as rg, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.p, b.p), 12) desc, b.vec_id) as rp from v a join v b on a.vec_id <> b.vec_id),
j as (select count_if(rg <= 5 and rp <= 5) / count_if(rg <= 5 or rp <= 5) as jaccard from n group by vec_id),
m as (select i, avg(g) as g, avg(p) as p from cells group by 1)
select count(*) as n_items, round(avg(c), 6) as mean_cosine, round(median(c), 6) as median_cosine, round(avg(ng), 6) as gold_density, round(avg(np), 6) as pred_density,
       (select round(corr(g, p), 6) from ranked) as pairwise_pearson, (select round(corr(rg, rp), 6) from ranked) as pairwise_spearman, (select round(avg(jaccard), 6) from j) as mean_nn_jaccard, (select round(corr(g, p), 6) from m) as prevalence_pearson,
       (select round(avg(g) filter (same), 6) from pairs) as gold_within_similarity, (select round(avg(g) filter (not same), 6) from pairs) as gold_between_similarity, (select round(avg(g) filter (same) - avg(g) filter (not same), 6) from pairs) as gold_separation,
       (select round(avg(p) filter (same), 6) from pairs) as pred_within_similarity, (select round(avg(p) filter (not same), 6) from pairs) as pred_between_similarity, (select round(avg(p) filter (same) - avg(p) filter (not same), 6) from pairs) as pred_separation
from each_""")
def geometry_report(spark, sf_dir):
    from lexiloom.operators.passes import geometry

    out = geometry(_vectors(spark, sf_dir), "vec_id", "label").drop("prevalence_spearman")
    return out.select(*[F.round(c, 6).alias(c) if c != "n_items" else F.col(c) for c in out.columns])


@query(f"with {_PAIRS} select round(avg(s) filter (c = d), 6) as within_similarity, round(avg(s) filter (c <> d), 6) as between_similarity, round(avg(s) filter (c = d) - avg(s) filter (c <> d), 6) as separation from pairs")
def category_separation(spark, sf_dir):
    out = metrics.category_separation(metrics.category_similarity(_vectors(spark, sf_dir), "label", "gold"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""
with {_LONG_VECTORS}, m as (select i, avg(g) as g, avg(p) as p from cells group by 1),
r as (select g, p, rank() over (order by g) + (count(*) over (partition by g) - 1) / 2.0 as a, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as b from m)
select count(*) as n_features, round(corr(g, p), 6) as pearson, round(corr(a, b), 4) as spearman from r""")
def prevalence(spark, sf_dir):
    cells = _vectors(spark, sf_dir).select(F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("gold") - 1).alias("feature_id"), "gold", "pred")).alias("c")).select("c.*")
    return metrics.prevalence(cells).select("n_features", F.round("pearson", 6).alias("pearson"), F.round("spearman", 4).alias("spearman"))


@query("""
with v as (select vec_id, embedding::double[] as g, list_transform(embedding, lambda x: floor(x::double * 10 + 0.5) / 10) as p from embeddings),
n as (select a.vec_id, b.vec_id as o, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.g, b.g), 12) desc, b.vec_id) as rg, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.p, b.p), 12) desc, b.vec_id) as rp from v a join v b on a.vec_id <> b.vec_id)
select vec_id, count_if(rg <= 5 and rp <= 5) / count_if(rg <= 5 or rp <= 5) as jaccard from n group by 1""")
def nn_jaccard(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return metrics.neighbour_jaccard(v.select("vec_id", F.col("gold").alias("v")), v.select("vec_id", F.col("pred").alias("v")), "vec_id", "v")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n_rows from events group by 1, 2")
def windowed_counts(spark, sf_dir):
    """As a stream, over a few files, one a step."""
    events = read(spark, sf_dir, "events").select("ts", "event_type")
    source, table, checkpoint = (fresh_path(spark, tag) for tag in ("events", "windows", "progress"))
    events.repartition(3).write.parquet(source)
    return run_windowed_counts(spark, source, events.schema, table, checkpoint, "ts", "event_type")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def stream_ingest(spark, sf_dir):
    """A log that grows between two runs of a stream, compacted: the last row of each key."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    source, table, checkpoint = (fresh_path(spark, tag) for tag in ("log", "table", "progress"))
    for rest in (0, 1):
        events.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(source)
        ingest(spark, source, events.schema, table, checkpoint, ["user_id"], "event_id")
    return current(spark, table, ["user_id"], "event_id").select("user_id", "event_id", "event_type")
