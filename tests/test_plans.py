"""Job plans, compaction, running totals, components, sources and streaming."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import derive, matrix
from lexiloom.plans import jobs
from lexiloom.plans.components import connected_components
from lexiloom.plans.materialise import MADE, fresh_path, materialise, release, shared_dir, sweep
from lexiloom.plans.running import average_ranks, numbered, running
from lexiloom.sources import tables
from lexiloom.streaming import ingest


def test_even_subset(spark):
    df = spark.range(293).toDF("i").repartition(7)
    picked = lambda k: sorted(r["i"] for r in jobs.even_subset(df, k, "i").collect())
    for k in (1, 2, 3, 4, 10):
        assert picked(k) == sorted({round(j * 292 / max(1, k - 1)) for j in range(k)})
    assert picked(293) == picked(1000) == [*range(293)]
    with pytest.raises(ValueError):
        jobs.even_subset(df, 0, "i")


def test_jobs_are_paired_and_resume(spark):
    words = spark.createDataFrame([("dog",), ("chair",)], "word string")
    plan = jobs.generation_jobs(words, ("A", "B", "C"), 3, 42, "m")
    rows = plan.collect()
    assert len(rows) == 18 == len({r["response_id"] for r in rows})
    seeds = {(r["word"], r["replicate_id"]): set() for r in rows}
    for r in rows:
        seeds[r["word"], r["replicate_id"]].add(r["sampling_seed"])
    assert all(len(s) == 1 for s in seeds.values()) and len({*map(frozenset, seeds.values())}) == 6
    done = plan.limit(5)
    ids = materialise(done, "done")
    assert jobs.pending(plan, ids, ["response_id"]).count() == 13
    assert jobs.preflight(words, ("A", "B", "C"), 3, 42, "m", 0.8, ids).first().asDict() == {"jobs": 18, "words": 2, "pending": 13, "seed_collisions": 0}
    with pytest.raises(ValueError):
        jobs.preflight(words, ("A",), 2, 42, "m", 0.0)
    with pytest.raises(jobs.DriftError):
        jobs.preflight(words, ("A",), 1, 42, "m", 0.0, manifest={"model": "other"})
    release(ids)


def test_drift():
    jobs.check_drift({"a": 1}, None)
    jobs.check_drift({"a": 1}, {"a": 1, "old": 2})
    with pytest.raises(jobs.DriftError, match="a: stored 2, now 1"):
        jobs.check_drift({"a": 1}, {"a": 2})
    assert jobs.config_hash({"b": 1, "a": 2}) == jobs.config_hash({"a": 2, "b": 1})


def test_labelling_jobs(spark):
    words, features = spark.createDataFrame([("a",), ("b",)], "word string"), spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "feature_id int, feature_text string")
    assert jobs.labelling_jobs(words, features).count() == 6
    with pytest.raises(ValueError):
        jobs.labelling_jobs(words, features, most_features=2)
    votes = spark.createDataFrame([("a", 0, "A"), ("a", 0, "B"), ("a", 0, "C"), ("a", 1, "A")], "word string, feature_id int, judge_id string")
    assert [tuple(r) for r in jobs.completed_pairs(votes, ["word", "feature_id"]).collect()] == [("a", 0)]


def test_splits(spark):
    rows = [(f"k{i}", None if i % 40 == 0 else "abc"[min(2, i % 7 // 2)]) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, cat string")
    split = lambda n: {(r["key"], r["is_test"]) for r in jobs.stratified_split(df.repartition(n), "key", F.coalesce("cat", F.lit("unknown")), 0.2, "s").collect()}
    assert split(1) == split(9)
    found = jobs.stratified_split(df, "key", F.coalesce("cat", F.lit("unknown")), 0.2, "s").groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r["t"] == max(1, round(r["n"] * 0.2)) for r in found) and sum(r["n"] for r in found) == 400
    assert jobs.stratified_split(df.limit(0), "key", F.col("cat"), 0.2, "s").count() == 0


LOG = "response_id string, prompt_variant string, word string, ingest_seq long, parse_error string, features array<string>, raw_json string"


def test_compaction_keeps_both_rules(spark):
    log = spark.createDataFrame([("r1", "A", "dog", 1, "", ["a"], ""), ("r1", "A", "dog", 2, "bad", [], ""), ("r2", "A", "dog", 3, "bad", [], ""), ("r2", "A", "dog", 4, None, ["b"], "")], LOG)
    assert {(r["response_id"], r["ingest_seq"]) for r in derive.latest(log, ["response_id"], "ingest_seq").collect()} == {("r1", 2), ("r2", 4)}
    assert {(r["response_id"], r["ingest_seq"]) for r in derive.latest_valid(log, ["response_id"], "ingest_seq").collect()} == {("r1", 1), ("r2", 4)}
    assert {(r["response_id"], r["ingest_seq"]) for r in derive.earliest(log, ["response_id"], "ingest_seq").collect()} == {("r1", 1), ("r2", 3)}
    assert derive.counters(log, "prompt_variant", ["response_id"], "ingest_seq").first().asDict() == {"prompt_variant": "A", "log_rows": 4, "responses": 2, "valid": 1, "failed": 1}


def test_frequencies(spark):
    log = spark.createDataFrame([("r1", "A", "dog", 1, "", ["Has fur", "has fur.", "barks"], ""), ("r2", "A", "dog", 2, "", ["HAS FUR"], ""), ("r3", "B", "dog", 3, "", [], "")], LOG)
    found = {(r["prompt_variant"], r["feature_text_normalized"]): r for r in derive.frequencies(log, ["prompt_variant", "word"]).collect()}
    fur = found["A", "has fur"]
    assert (fur["response_frequency"], fur["valid_response_count"], fur["response_proportion"], fur["feature_text_example"]) == (2, 2, 1.0, "Has fur")
    assert len(found) == 2
    assert [r["feature_rank"] for r in derive.explode_features(log.where("response_id = 'r1'")).orderBy("feature_rank").collect()] == [1, 2, 3]


def test_revalidation_appends(spark):
    good = '```json\n{"target_word": "dog", "features": ["barks"]}\n```'
    log = spark.createDataFrame([("r1", "A", "dog", 1, "bad", [], good), ("r2", "A", "dog", 2, "bad", [], "nope"), ("r3", "A", "dog", 3, "", ["x"], good)], LOG)
    found = derive.revalidate(log, ["response_id"], "ingest_seq").collect()
    assert [(r["response_id"], r["features"], r["parse_error"], r["ingest_seq"]) for r in found] == [("r1", ["barks"], "", 2)]
    both = log.unionByName(derive.revalidate(log, ["response_id"], "ingest_seq"))
    assert derive.latest_valid(both, ["response_id"], "ingest_seq").count() == 2


def test_running_totals(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(6)
    found = running(df, [F.col("v"), F.col("i")], {"total": F.col("v")}).orderBy("v", "i").collect()
    total = 0
    for r in found:
        total += r["v"]
        assert r["total"] == total
    assert [r["row_index"] for r in numbered(df, F.col("i")).orderBy("i").collect()] == [*range(500)]
    ranks = {r["v"]: r["rank"] for r in average_ranks(df, "v", "rank").collect()}
    assert all(ranks[v] == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in set(values))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sources(spark, tmp_path):
    wide = tmp_path / "matrix.csv"
    wide.write_text('Name,is an animal,"says ""woof"""\n Dog ,4,3\nCafé,0,\nnull,1,1\n')
    found = {(r["word_normalized"], r["feature_id"]): r["value"] for r in tables.read_matrix(spark, str(wide)).collect()}
    assert found == {("dog", 0): 4.0, ("dog", 1): 3.0, ("cafe", 0): 0.0, ("cafe", 1): None, ("null", 0): 1.0, ("null", 1): 1.0}
    assert [tuple(r) for r in tables.feature_schema(spark, str(wide)).collect()] == [(0, "is an animal"), (1, 'says "woof"')]
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(wide), "Item")
    items = tmp_path / "items.csv"
    items.write_text("thing,word\nx,sleep\ny,\nz,rest\n")
    assert [r["word"] for r in tables.read_items(spark, str(items)).collect()] == ["sleep", "rest"]
    assert [r["word"] for r in tables.read_items(spark, str(items), "no").collect()] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        tables.read_categories(spark, str(items))
    pointer = tmp_path / "pointer.csv"
    pointer.write_text(tables.POINTER + "/v1\noid sha256:0\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(pointer))
    log = tmp_path / "log.csv"
    names = [c.split()[0] for c in tables.LOG_SCHEMA.split(", ")]
    row = {n: "" for n in names} | {"response_id": "r", "features_json": '"[""a"", ""b""]"', "raw_json": '"{\n""x"": 1\n}"', "replicate_id": "0"}
    log.write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    read = tables.read_generation_log(spark, str(log)).first()
    assert (read["features"], read["raw_json"], read["parse_error"], read["temperature"]) == (["a", "b"], '{\n"x": 1\n}', "", None)
    assert tables.read_csv(spark, str(items), all_strings=True).where("word = ''").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, x string")
    for run in (1, 2):
        tables.append_log(df, str(tmp_path / "log"), run)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["run_id"], r["ingest_seq"]) for r in log.collect()) == [(1, 1 << 40), (2, 2 << 40)]
    for kind in ("parquet", "csv", "json"):
        tables.write_table(df, str(tmp_path / kind), kind)
        tables.write_table(df, str(tmp_path / kind), kind)
        with pytest.raises(Exception, match="exist"):
            tables.write_table(df, str(tmp_path / kind), kind, resume=False)
    tables.write_manifest(spark, {"a": 1, "é": [1, 2]}, str(tmp_path / "manifest"))
    assert tables.read_manifest(spark, str(tmp_path / "manifest")) == {"a": 1, "é": [1, 2]}
    (tmp_path / "p.txt").write_text("  hello\nworld \n")
    assert tables.read_text(spark, str(tmp_path / "p.txt")) == "hello\nworld"


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 3), (8, 4), (500, 13)])
def test_appended_rows_have_numbers_of_their_own(spark, tmp_path, n, parts):
    df = spark.range(n).repartition(parts)
    for run in (1, 2):
        tables.append_log(df, str(tmp_path / "log"), run)
    found = sorted(r["ingest_seq"] for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert found == [(run << 40) + i for run in (1, 2) for i in range(n)]
    with pytest.raises(ValueError):
        tables.in_run_order(df, 1 << 23)


def test_logs_of_several_files_follow_their_names(spark, tmp_path):
    names = [c.split()[0] for c in tables.LOG_SCHEMA.split(", ")]
    for f, rows in {"b": ["2", "3"], "a": ["1"] * 400, "c": ["4"]}.items():  # the larger file is not the first to be packed
        lines = [",".join({"response_id": "r", "raw_json": x}.get(n, "") for n in names) for x in rows]
        (tmp_path / f"{f}.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    log = tables.read_generation_log(spark, str(tmp_path))
    assert [r["raw_json"] for r in log.orderBy("ingest_seq").collect()] == ["1"] * 400 + ["2", "3", "4"]
    assert log.select("ingest_seq").distinct().count() == 403


def test_items_and_plurals_compose_from_files(spark, tmp_path):
    (tmp_path / "items.csv").write_text("word\nSleep\nsleep\ndog\nchild\n")
    (tmp_path / "plurals.csv").write_text("singular,plural\nChild,kids\nchild,Children\n")
    items, plurals = tables.read_items(spark, str(tmp_path / "items.csv")), tables.read_plurals(spark, str(tmp_path / "plurals.csv"))
    added = matrix.new_items(items, spark.createDataFrame([("dog",)], "word_normalized string"), plurals)
    assert {(r["word_normalized"], r["word"]) for r in added.collect()} == {("sleep", "Sleep"), ("children", "child")}
    with pytest.raises(ValueError):
        tables.read_plurals(spark, str(tmp_path / "items.csv"))


def test_files_are_hashed_byte_by_byte(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x\r\n\x00")
    assert tables.file_hashes(spark, str(tmp_path / "a.csv")).first()["sha256"] == hashlib.sha256(b"x\r\n\x00").hexdigest()


def test_export_in_order(spark, tmp_path):
    rows = [(i * 37 % 500,) for i in range(500)]
    tables.write_ordered(spark.createDataFrame(rows, "i int").repartition(5), str(tmp_path / "out"), "i")
    files = sorted(f for f in (tmp_path / "out").iterdir() if f.suffix == ".csv")
    assert [int(x) for f in files for x in f.read_text().split("\n")[1:] if x] == [*range(500)]


def test_null_keys_stay_in_a_split(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", "x")], "key string, cat string")
    assert jobs.stratified_split(df, "key", F.col("cat"), 0.4, "s").count() == 3


def test_tables_are_swept(spark, monkeypatch):
    import os

    monkeypatch.setattr("lexiloom.plans.materialise.MADE", mine := [])
    one, two = materialise(spark.range(3), "one"), materialise(spark.range(3), "two")
    assert len(mine) == 2 and fresh_path(spark, "never made") in mine and MADE is not mine
    release(one)
    assert len(mine) == 2 and os.path.exists(two._lexiloom_path)
    sweep(spark)
    assert not mine and not os.path.exists(two._lexiloom_path)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///x/"
    assert shared_dir(Session) == "hdfs:///x"


def test_matrix_forms(spark):
    wide = spark.createDataFrame([("dog", 4.0, 0.0), ("cat", None, 2.0)], "Name string, f0 double, f1 double")
    long = matrix.unpivot(wide, "Name")
    assert long.count() == 4
    back = {r["Name"]: (r["0"], r["1"]) for r in matrix.pivot(long, "Name", [0, 1]).collect()}
    assert back == {"dog": (4.0, 0.0), "cat": (0.0, 2.0)}
    twice = spark.createDataFrame([("dog", 0, 1.0, 1), ("dog", 0, 3.0, 2), ("dog", 0, None, 3), ("dog", 7, 9.0, 1)], "Name string, feature_id int, value double, seq int")
    assert matrix.pivot(twice, "Name", [0], seq="seq").first()["0"] == 3.0
    assert matrix.vectors(twice, "Name", 3).first()["vector"] == [3.0, 0.0, 0.0]


def test_expansion(spark):
    items = spark.createDataFrame([(0, "Sleep"), (1, "sleep"), (2, "dog"), (3, "child"), (4, " "), (5, "rest")], "input_seq int, word string")
    existing = spark.createDataFrame([("dog",)], "word_normalized string")
    plurals = spark.createDataFrame([("Child", "kids", 1), ("child", "Children", 2)], "singular string, plural string, seq int")
    added = matrix.new_items(items, existing, plurals)
    assert {(r["word_normalized"], r["word"]) for r in added.collect()} == {("sleep", "Sleep"), ("children", "child"), ("rest", "rest")}
    full = matrix.expand(existing.withColumn("word", F.lit(None).cast("string")), added.select("word_normalized", "word"))
    rows = {r["word_normalized"]: r for r in full.collect()}
    assert rows["dog"]["word"] == "dog" and rows["dog"]["source"] == "original" and rows["rest"]["in_expansion"]
    seen = spark.createDataFrame([("dog",), ("xyz",), (None,)], "word_key string")
    assert sorted(r["source"] for r in matrix.annotate_occurrences(seen, full).collect()) == ["missing", "missing", "original"]


def test_coverage(spark):
    known = spark.createDataFrame([("dog",), ("cat",), ("sleep",), ("dream",), ("dream",)], "word_normalized string")
    drm = spark.createDataFrame([("sleep", "l1", "yes"), ("dream", "l1", "1.0"), ("rest", "l1", "TRUE"), ("memory", "l2", None), ("dog", None, None)], "word string, list_id string, lure string")
    flagged = matrix.covered(drm, known, "word")
    assert tuple(matrix.coverage_summary(flagged).first()) == (5, 3, 0.6)
    assert tuple(matrix.coverage_summary(flagged.limit(0)).first()) == (0, 0, 0.0)
    by = {r["list_id"]: (r["n_items"], r["n_covered"], r["is_complete"]) for r in matrix.coverage_by(flagged, "list_id").collect()}
    assert by == {"l1": (3, 2, False), "l2": (1, 0, False)}
    assert tuple(matrix.lure_coverage(flagged, "lure").first())[:2] == (2, 1)


def test_rollup(spark):
    resolutions = spark.createDataFrame([("dog", 0, 3.0, True, False), ("dog", 1, 0.0, False, True), ("cat", 0, None, False, False)], "word_normalized string, feature_id int, final_value double, adjudicated boolean, needs_audit boolean")
    rows = {r["word_normalized"]: r for r in matrix.rollup(resolutions, strict=True).collect()}
    assert (rows["dog"]["n_positive_features"], rows["dog"]["n_adjudicated"], rows["dog"]["needs_human_audit"], rows["cat"]["n_positive_features"]) == (1, 1, True, 0)
    votes = spark.createDataFrame([("dog", 0.5, True), ("dog", 1.0, False)], "word_normalized string, confidence double, ambiguous boolean")
    found = {r["word_normalized"]: r for r in matrix.rollup(resolutions, votes).collect()}["dog"]
    assert (found["mean_feature_confidence"], found["n_low_confidence"], found["n_ambiguous"]) == (0.75, 1, 1)


def test_stream_ingest_is_repeatable(spark, tmp_path):
    schema = "response_id string, ingest_seq long, x string"
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, table, mark, ["response_id"], "ingest_seq")
    spark.createDataFrame([("a", 3, "newest")], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, table, mark, ["response_id"], "ingest_seq")
    ingest.ingest(spark, source, schema, table, mark, ["response_id"], "ingest_seq")
    assert {(r["response_id"], r["x"]) for r in ingest.current(spark, table, ["response_id"], "ingest_seq").collect()} == {("a", "newest"), ("b", "only")}


def test_windowed_counts_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n_rows")).first()[0] == events.count()
    assert not math.isnan(spark.table("windows").count())
