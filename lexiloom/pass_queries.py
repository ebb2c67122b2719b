"""Queries of the model passes, each with the SQL that restates its rule.

The client is a stand-in whose answers follow from a hash of the prompt, so SQL
can tell what it answers, fails and answers again. Parts stand in for words and pairs.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from lexiloom.functions import prompts as P
from lexiloom.functions import text as T
from lexiloom.functions.json_rules import validate_generation, validate_verification
from lexiloom.operators import derive, models, passes, resolve
from lexiloom.plans import jobs
from lexiloom.queries import SEED, query, read, variants_sql
from lexiloom.sources.tables import in_run_order

VARIANTS, MODEL = ("A", "B", "C"), "stub"


def _rating(user: str, digest: int) -> str:
    """Judges and the verifier are asked in JSON, adjudicators in lines."""
    if digest % 11 == 0:
        return "no answer"
    if user.startswith("{"):
        asked = json.loads(user)
        word, feature = asked["word"], asked["feature_id"]
    else:
        asked = {}
        word, feature = re.match(r"Thing: (.*)\nProperty (\d+)", user).groups()
    body = {"word": word, "feature_id": int(feature)}
    if "rating" in asked:
        return json.dumps(body | {"verified_feature_value": digest % 5, "retain_positive": None, "confidence": 1, "reason": ""})
    return json.dumps(body | {"feature_value": digest % 5, "confidence": digest % 100 / 100, "ambiguous": digest % 7 == 0, "reason": "as asked"})


def _listing(user: str, digest: int) -> str:
    word = json.loads(user)["target_word"]
    body = json.dumps({"target_word": word, "features": [f"is {word}", f"has part {digest % 9}", f"IS {word}"]})
    return body if digest % 5 else body[:-1]


def _busy(user: str, digest: int) -> str:
    if digest % 3 == 0:
        raise models.ModelError("busy")
    return _rating(user, digest)


def stub_ratings() -> models.HashClient:
    return models.HashClient(_rating)


def stub_listings() -> models.HashClient:
    return models.HashClient(_listing)


def stub_busy() -> models.HashClient:
    return models.HashClient(_busy)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(system: str, user: str, seed: str) -> str:
    return f"cast('0x' || substr(sha256({system} || chr(31) || {user} || chr(31) || {seed}), 1, 16) as ubigint)"


# Generation.

_USER = """'{"target_word":"' || word || '"}'"""
_SAMPLING = f"cast(cast('0x' || substr(sha256('{SEED}|' || word || '|' || r), 1, 16) as ubigint) & 9223372036854775807 as bigint)"


def _generation_sql(words: str) -> str:
    return f"""plan as (
    select *, sha256(text || chr(10) || '---' || chr(10) || {_USER}) as prompt_hash from (
        select word, v as prompt_variant, text, cast(r as int) as replicate_id, {_SAMPLING} as seed
        from ({words}), ({variants_sql('generation', 'v3')}), (select unnest(range(2)) as r))),
named as (select *, sha256(word || '|' || prompt_variant || '|' || replicate_id || '|{MODEL}|' || seed || '|' || prompt_hash) as response_id,
    cast((cast(seed as hugeint) + 1000000007) % 9223372036854775808 as bigint) as again from plan),
tried as (select *, {_digest('text', _USER, 'seed')} as d1, {_digest('text', _USER, 'again')} as d2 from named),
answered as (select *, case when d1 % 5 <> 0 then d1 else d2 end as d, case when d1 % 5 <> 0 then seed else again end as sampling_seed from tried),
logged as (select word, prompt_variant, replicate_id, response_id, prompt_hash, sampling_seed, d % 9 as part, d % 5 <> 0 as valid from answered)"""


@query(f"""with {_generation_sql("select distinct p_name as word from part")}
select word, prompt_variant, replicate_id, response_id, prompt_hash, sampling_seed, case when valid then 2 else 0 end as n_features, case when valid then 'has part ' || part end as second_feature,
       case when valid then '' else 'JSON parse error: not one JSON value' end as parse_error, 'stop' as finish_reason from logged""")
def generation_run(spark, sf_dir):
    words = read(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()
    plan = jobs.generation_jobs(words, VARIANTS, 2, SEED, MODEL)
    log = models.generate_features(plan, stub_listings, run_id=1)
    return log.select("word", "prompt_variant", "replicate_id", "response_id", "prompt_hash", "sampling_seed", "n_features", F.get("features", F.lit(1)).alias("second_feature"), "parse_error", "finish_reason")


_NAMES = "select distinct trim(lower(p_name)) as word from part"


def _names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()


@query(f"""with {_generation_sql(_NAMES)},
long as (select word, prompt_variant, 'is ' || word as f, response_id from logged where valid union all select word, prompt_variant, 'has part ' || part, response_id from logged where valid),
totals as (select word, prompt_variant, count(*) as n from logged where valid group by all)
select prompt_variant, word as word_normalized, f as feature_text_normalized, count(*) as response_frequency, any_value(n) as valid_response_count, count(*) / any_value(n) as response_proportion
from long join totals using (word, prompt_variant) group by all""")
def generation_pass(spark, sf_dir):
    """A run in two parts, the second of which resumes."""
    words = _names(spark, sf_dir)
    first = passes.run_generation(words.where(F.crc32("word") % 2 == 0), stub_listings, VARIANTS, 2, SEED, MODEL)
    return passes.run_generation(words, stub_listings, VARIANTS, 2, SEED, MODEL, log=first.log, run_id=2).frequencies.drop("feature_text_example")


@query(f"""with {_generation_sql(_NAMES)}
select prompt_variant, count(*) as log_rows, count(*) as responses, count_if(valid) as valid, count_if(not valid) as failed from logged group by 1""")
def generation_counters(spark, sf_dir):
    return passes.run_generation(_names(spark, sf_dir), stub_listings, VARIANTS, 2, SEED, MODEL).counters


@query("select count(distinct p_name) * 6 as jobs, count(distinct p_name) as words, count(distinct p_name) * 6 - count(distinct p_name) * 3 as pending, 0 as seed_collisions from part")
def preflight(spark, sf_dir):
    words = _names(spark, sf_dir)
    done = jobs.generation_jobs(words, VARIANTS, 2, SEED, MODEL).where("replicate_id = 0")
    return jobs.preflight(words, VARIANTS, 2, SEED, MODEL, 0.8, done)


_RAW = """case doc_id % 4 when 0 then '```json' || chr(10) || '{"target_word": "w' || doc_id || '", "features": ["One ", "one", "two"]}' || chr(10) || '```' when 1 then '{"target_word": "other", "features": []}' when 2 then 'cut {' else '' end"""


@query(f"""select doc_id as response_id, doc_id % 4 = 0 as valid, case when doc_id % 4 = 0 then 'One|two' else '' end as features, case when doc_id % 4 = 0 then 2 else 1 end as log_rows from documents
union all select -1, null, 'candidates', count(*) from documents union all select -1, null, 'repaired', count_if(doc_id % 4 = 0) from documents""")
def revalidation(spark, sf_dir):
    """Failed responses whose raw texts are parsed again, and what the manifest says of it."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.concat(F.lit("w"), "doc_id").alias("word"), F.expr(_RAW).alias("raw_json"))
    log = in_run_order(docs.select("*", F.col("word").alias("word_normalized"), F.lit("A").alias("prompt_variant"), F.lit("failed").alias("parse_error"), F.expr("cast(array() as array<string>)").alias("features")), 1)
    found = passes.run_revalidation(log, {"total_planned_responses": 7}, "2024-01-01T00:00:00Z")
    rows = found.log.groupBy("response_id").agg(F.max(F.col("parse_error") == "").alias("valid"), F.max(F.array_join("features", "|")).alias("features"), F.count("*").alias("log_rows"))
    past = found.manifest["revalidation_history"][-1]
    said = spark.createDataFrame([(-1, None, "candidates", past["candidate_errors"]), (-1, None, "repaired", past["repaired_responses"])], rows.schema)
    return rows.unionByName(said)


# Judges, adjudicators, verifier.

_JUDGED = f"""asked as (
    select p_name as word, p_partkey as feature_id, p_type as feature_text, v as judge_id, s, {_digest('text', '''('{"word":"' || p_name || '","feature_id":' || p_partkey || ',"feature":"' || p_type || '"}')''', 's')} as d
    from part, ({variants_sql('judge', 'v2')}), (select unnest([0, 1]) as s)),
votes as (
    select word, feature_id, feature_text, judge_id, s as sampling_seed, case when d % 11 <> 0 then cast(d % 5 as double) end as value, case when d % 11 <> 0 then (d % 100) / 100 else 0 end as confidence,
           d % 11 <> 0 and d % 7 = 0 as ambiguous, case when d % 11 = 0 then 'JSON parse error: not one JSON value' else '' end as parse_error
    from asked a where s = 0 and d % 11 <> 0 or s = 1 and exists (select 1 from asked b where b.s = 0 and b.d % 11 = 0 and b.feature_id = a.feature_id and b.judge_id = a.judge_id))"""


def _pairs(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("feature_text"))


@query(f"with {_JUDGED} select word, feature_id, judge_id, sampling_seed, value, confidence, ambiguous, parse_error from votes")
def judge_panel(spark, sf_dir):
    return models.judge_panel(_pairs(spark, sf_dir), stub_ratings).select("word", "feature_id", "judge_id", "sampling_seed", "value", "confidence", "ambiguous", "parse_error")


_RESOLVED = f"""{_JUDGED},
counted as (select feature_id, value, count(*) as k from votes where value is not null group by 1, 2),
modes as (select feature_id, arg_min(value, (-k) * 10 + value) as mode from counted group by 1),
gathered as (
    select v.feature_id, any_value(word) as word, any_value(feature_text) as feature_text, count(value) as n, min(value) as lo, max(value) as hi, avg(value) as mean, count(distinct value) as kinds,
           arg_min(value, judge_id) as first, bool_or(parse_error <> '') as failed, count_if(ambiguous) as n_ambiguous, bool_or(coalesce(value <> mode and confidence >= 0.8, false)) as dissent,
           string_agg(judge_id || ': ' || case when value is null then 'none' else printf('%.2f', value) end || ' (confidence ' || printf('%.2f', confidence) || ')', chr(10) order by judge_id) as lines
    from votes v left join modes m on v.feature_id = m.feature_id group by 1),
triggered as (
    select *, case when failed then 'parse_error' when n < 3 then 'insufficient_valid_votes' when hi - lo >= 2 then 'range_' || printf('%.1f', hi - lo) when kinds > 1 and dissent then 'high_confidence_dissent' when n_ambiguous >= 2 then 'ambiguous_majority' end as trigger from gathered),
adjudicated as (select *, {_digest(_literal(P.load('adjudicator', 'v2')), "('Thing: ' || word || chr(10) || 'Property ' || feature_id || ': ' || feature_text || chr(10) || lines)", "'None'")} as a from triggered),
resolved as (
    select *, case when trigger is null then case when kinds = 1 then first else mean end when a % 11 <> 0 then cast(a % 5 as double) end as value,
           case when trigger is null then case when kinds = 1 then 'unanimous' else 'mean_small_disagreement' end when a % 11 <> 0 then 'adjudicator_agree' else 'adjudicator_failed' end as method,
           trigger is not null and a % 11 = 0 as audit
    from adjudicated)"""


@query(f"with {_RESOLVED} select word, feature_id, i::varchar as judge_id, case when a % 11 <> 0 then cast(a % 5 as double) end as value, a % 11 = 0 as failed from resolved, (select unnest([1, 2, 3]) as i) where trigger is not null")
def adjudicator_pass(spark, sf_dir):
    found = passes.run_labelling(_pairs(spark, sf_dir), stub_ratings, verify=False)
    return found.adjudications.select("word", "feature_id", "judge_id", "value", (F.col("parse_error") != "").alias("failed"))


_VERIFIED = f"""{_RESOLVED},
checked as (
    select *, case when value is null or value < 1 then null when d1 % 11 <> 0 then d1 % 5 when d2 % 11 <> 0 then d2 % 5 end as seen
    from (select *, {_digest(_literal(P.load('verifier', 'v1')), '''('{"word":"' || word || '","feature_id":' || feature_id || ',"feature":"' || feature_text || '","rating":"' || printf('%.2f', value) || '"}')''', "'0'")} as d1,
                 {_digest(_literal(P.load('verifier', 'v1')), '''('{"word":"' || word || '","feature_id":' || feature_id || ',"feature":"' || feature_text || '","rating":"' || printf('%.2f', value) || '"}')''', "'1'")} as d2 from resolved)),
labelled as (
    select *, case when value is null or value < 1 then 'not_candidate' when seen is null then 'parse_error' when seen >= 1 then 'retained' else 'rejected' end as status from checked)"""


@query(f"""with {_VERIFIED}
select word, feature_id, round(case status when 'retained' then seen when 'rejected' then 0 else value end, 9)::double as final_value, method, trigger is not null as adjudicated, trigger as adjudication_trigger, status as verification_status,
       round(value, 9) as pre_verification_value, seen::double as verified_value, audit or status = 'parse_error' as needs_audit from labelled""")
def labelling_pass(spark, sf_dir):
    found = passes.run_labelling(_pairs(spark, sf_dir), stub_ratings).resolutions
    return found.select("word", "feature_id", F.round("final_value", 9).alias("final_value"), "method", "adjudicated", "adjudication_trigger", "verification_status", F.round("pre_verification_value", 9).alias("pre_verification_value"), "verified_value", "needs_audit")


@query(f"with {_JUDGED.replace('from part,', 'from (select * from part where p_size > 40),')} select count(*) as n_votes, count(distinct feature_id) as n_pairs from votes")
def labelling_resumes(spark, sf_dir):
    """Pairs that have three votes are not judged again."""
    pairs = _pairs(spark, sf_dir)
    big = read(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("feature_id"))
    before = models.judge_panel(pairs.join(big, "feature_id", "left_anti"), stub_ratings)
    found = passes.run_labelling(pairs, stub_ratings, before, verify=False).votes
    return found.join(big, "feature_id", "left_semi").agg(F.count("*").alias("n_votes"), F.count_distinct("feature_id").alias("n_pairs"))


_BUSY = """with asked as (select p_partkey as feature_id, v as judge_id, {d0} as d0, {d1} as d1 from part, ({judges}))
select feature_id, judge_id, case when d0 % 3 = 0 or d0 % 11 = 0 then case when d1 % 3 = 0 then 'LLM call error: ModelError: busy' when d1 % 11 = 0 then 'JSON parse error: not one JSON value' else '' end else '' end as parse_error,
       case when d0 % 3 <> 0 and d0 % 11 <> 0 then cast(d0 % 5 as double) when d1 % 3 <> 0 and d1 % 11 <> 0 then cast(d1 % 5 as double) end as value from asked"""
_ASKED = """('{"word":"' || p_name || '","feature_id":' || p_partkey || ',"feature":"' || p_type || '"}')"""


@query(_BUSY.format(d0=_digest("text", _ASKED, "'0'"), d1=_digest("text", _ASKED, "'1'"), judges=variants_sql("judge", "v2")))
def failed_votes(spark, sf_dir):
    """A client that refuses some calls: its errors by class, and no pair lost."""
    return models.judge_panel(_pairs(spark, sf_dir), stub_busy).select("feature_id", "judge_id", "parse_error", "value")


# Validation of generations and verifications: events make good, fenced, mismatched, over-full and cut answers.


@query("""
with e as (select event_id, event_type, event_id % 6 as form from events)
select event_id, case when form in (0, 1, 5) then 'Has ' || event_type || '|is it' end as features,
       case form when 2 then 'Returned target_word does not match' when 3 then 'Schema validation error: unknown key' when 4 then 'JSON parse error: not one JSON value' else '' end as parse_error from e""")
def generation_validate(spark, sf_dir):
    form = F.col("event_id") % 6
    word = F.when(form == 2, F.lit("other")).when(form == 5, F.concat(F.lit(" ("), F.upper("event_type"), F.lit(") "))).otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"target_word": "'), word, F.lit('", "features": ["Has '), "event_type", F.lit('", " has  '), F.upper("event_type"), F.lit(' ", "is it"]'), F.when(form == 3, ', "n": 1').otherwise(""), F.when(form == 4, "").otherwise("}"))
    raw = F.when(form == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    checked = read(spark, sf_dir, "events").withColumn("v", validate_generation(raw, F.col("event_type")))
    return checked.select("event_id", F.array_join("v.record.features", "|").alias("features"), F.col("v.parse_error").alias("parse_error"))


@query("""
with e as (select event_id, event_id % 5 as form, user_id % 6 as k from events)
select event_id, case when form < 3 and k < 5 then k::double end as verified_feature_value, case when form < 3 and k < 5 then k >= 1 end as retain_positive,
       case when k = 5 and form <> 4 then 'Schema validation error: verified_feature_value' when form = 3 then 'Returned feature_id does not match' when form = 4 then 'Schema validation error: missing key' else '' end as parse_error from e""")
def verifier_validate(spark, sf_dir):
    form, k = F.col("event_id") % 5, (F.col("user_id") % 6).cast("string")
    said = F.when(form == 0, F.lit("None")).when(form == 1, F.lit("False")).otherwise(F.lit("true"))
    body = F.concat(F.lit('{"word": "'), "event_type", F.lit('", "feature_id": '), F.when(form == 3, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string"), F.lit(', "verified_feature_value": '), k, F.lit(', "retain_positive": '), said, F.lit(', "confidence": 1.0'), F.when(form == 4, "").otherwise(', "reason": "r"'), F.lit("}"))
    checked = read(spark, sf_dir, "events").withColumn("v", validate_verification(body, F.col("event_type"), F.col("user_id")))
    return checked.select("event_id", F.col("v.record.verified_feature_value").alias("verified_feature_value"), F.col("v.record.retain_positive").alias("retain_positive"), F.col("v.parse_error").alias("parse_error"))


# Prompts and hashes.


@query(f"""select p_partkey, sha256(text || chr(10) || '---' || chr(10) || '{{"target_word":"' || p_name || '"}}') as prompt_hash, v as prompt_variant from part, ({variants_sql("generation", "v3.1")})""")
def prompt_hashes(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("prompt_variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    return rows.select("p_partkey", "prompt_variant", T.prompt_hash(P.generation_system("prompt_variant", "v3.1"), P.generation_user("p_name")).alias("prompt_hash"))


@query(f"select kind, version, variant, sha256(text) as sha256 from (values {', '.join('(' + ', '.join(map(_literal, (*k, t))) + ')' for k, t in P.PROMPTS.items())}) as t(kind, version, variant, text)")
def prompt_assets(spark, sf_dir):
    return P.prompt_table(spark).drop("text")


@query("""select p_partkey, '{"word":"' || p_name || '","feature_id":' || p_partkey || ',"feature":"' || p_type || '"}' as judge, '{"word":"' || p_name || '","feature_id":' || p_partkey || ',"feature":"' || p_type || '","rating":"' || printf('%.2f', p_size / 10) || '"}' as verifier,
    'Thing: ' || p_name || chr(10) || 'Property ' || p_partkey || ': ' || p_type || chr(10) || 'A: ' || printf('%.2f', p_size / 10) || ' (confidence 0.50)' || chr(10) || 'B: none (confidence 0.00)' as adjudicator from part""")
def rendered_prompts(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("rating", F.col("p_size") / 10)
    votes = F.array(F.struct(F.lit("A").alias("judge"), F.col("rating").alias("value"), F.lit(0.5).alias("confidence")), F.struct(F.lit("B").alias("judge"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("confidence")))
    return rows.withColumn("votes", votes).select("p_partkey", P.judge_user("p_name", "p_partkey", "p_type").alias("judge"), P.verifier_user("p_name", "p_partkey", "p_type", "rating").alias("verifier"), P.adjudicator_user("p_name", "p_partkey", "p_type", "votes").alias("adjudicator"))


_LEAKS = "|".join(P.LEAKS)


@query(rf"select conv_id, turn, coalesce(regexp_matches(lower(text), '\b({_LEAKS})\b'), false) as leaks from conversations union all select -1, row_number() over () , x from (values (true), (false)) t(x)")
def leakage(spark, sf_dir):
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(P.leaks("text"), F.lit(False)).alias("leaks"))
    planted = spark.createDataFrame([(-1, 1, "a Memory test"), (-1, 2, "memories of allure")], "conv_id long, turn long, text string")
    return found.unionByName(planted.select("conv_id", "turn", P.leaks("text").alias("leaks")))


@query("select l_orderkey, l_linenumber, count(*) as n, count_if(l_quantity / 50 >= 0.8) as n_high, count_if(l_quantity / 50 >= 0.5) as n_half from lineitem group by 1, 2")
def high_confidence(spark, sf_dir):
    share = F.col("l_quantity") / 50
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(T.high_confidence(share)).alias("n_high"), F.count_if(T.high_confidence(share, 0.5)).alias("n_half"))


@query("select p_partkey, lower(trim(p_name)) as match_key, lower(trim(p_name)) || ' ' || lower(trim(p_type)) as match_both from part")
def target_word_keys(spark, sf_dir):
    both = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ("), "p_type", F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", T.match_key(F.concat(F.lit("( "), "p_name", F.lit(")  "))).alias("match_key"), T.match_key(both).alias("match_both"))


@query("select p_partkey, [p_name, p_type || '.', 'Maße']::varchar as features from part")
def distinct_feature_lists(spark, sf_dir):
    several = F.array(F.concat(F.lit(" "), "p_name"), F.upper("p_name"), F.lit("  "), F.concat("p_type", F.lit(".")), F.lit("Maße"), F.lit("MASSE"), F.lit("masse"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(T.distinct_features(several), ", "), F.lit("]")).alias("features"))


#: Of texts and what full case folding makes of each.
FOLDED = {"ΟΔΟΣ": "οδοσ", "ὀδός": "ὀδόσ", "ﬁsh": "fish", "ŉ": "ʼn", "Straße": "strasse", "STRAẞE": "strasse", "µm": "μm", "ſo": "so", "\u01f0": "j\u030c", "ᾈ": "ἀι", "ﬃ": "ffi", "Ⅷ": "ⅷ", "ÅNGSTRÖM": "ångström", "plain": "plain"}


@query("select * from (values " + ", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in FOLDED.items()) + ") as t(raw, folded)")
def case_folding(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in FOLDED], "raw string").select("raw", T.casefold("raw").alias("folded"))


@query("select l_orderkey, mode_value, needs_review from (select l_orderkey, round_even(max(l_quantity), 0) as mode_value, count(*) > 3 as needs_review from lineitem group by 1)")
def half_even_maxima(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(T.half_even(F.max("l_quantity")).alias("mode_value"), (F.count("*") > 3).alias("needs_review"))


@query("select 'model' as key, 'now' as state union all select 'replicates', 'same'")
def drift(spark, sf_dir):
    """Which keys of a configuration have drifted from a manifest, as preflight reports them."""
    now, stored = {"model": "a", "replicates": 2}, {"model": "b", "replicates": 2, "old": 1}
    rows = []
    for key, value in now.items():
        try:
            jobs.check_drift({key: value}, stored)
            rows.append((key, "same"))
        except jobs.DriftError as e:
            rows.append((key, "now" if "now 'a'" in str(e) else "?"))
    return spark.createDataFrame(rows, "key string, state string")


@query("select p_partkey as word, i as feature_id, ['heavy', 'round', 'edible'][i + 1] as feature_text from part, (select unnest(range(3))::int as i)")
def labelling_plan(spark, sf_dir):
    features = spark.createDataFrame([(0, "heavy"), (1, "round"), (2, "edible")], "feature_id int, feature_text string")
    return jobs.labelling_jobs(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("word")), features)
