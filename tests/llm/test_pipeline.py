"""The pipeline and its filter of near copies against plain versions."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import queries, simhash
from tests.llm.test_operators import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain_groups(rows, similarity=0.8):
    """Groups of row positions by Jaccard similarity of shingle sets, directly or through others."""
    sets = [shingles(t) for _, t in rows]
    root, by = list(range(len(rows))), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in by[x])
        if not s:
            common = collections.Counter({j: 1 for j in range(i) if not sets[j]})
        for j, n in common.items():
            if not s or n >= similarity * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            by[x].append(i)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return [*out.values()]


def check_kept(before, after):
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    kept = collections.Counter(r["doc_id"] for r in after.select("doc_id").collect())
    least = [min((rows[i][0] is not None, rows[i][0] or 0) for i in g) for g in plain_groups(rows)]
    assert kept == collections.Counter(i if known else None for known, i in least)


def test_one_of_each(spark, documents, awkward, nothing):
    for df in (documents, awkward):
        found = simhash.deduplicate(df)
        assert found.columns == df.columns
        check_kept(df, found)
    assert simhash.deduplicate(nothing).count() == 0


def test_recall_on_whole_documents(spark):
    """Every group that all pairs of sf0.01 make, and no other: recall and precision of 1 against brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_kept(docs, simhash.deduplicate(docs))


def test_near_copies_of_every_kind(spark):
    """Large and small groups with changed words, upper case and endings, among texts of their own."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 200))) for _ in range(150)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(120))}" for _ in range(40)]  # a common passage is no copy
    for base in texts[:20]:
        for _ in range(rng.choice([1, 2, 3, 30])):
            words = base.split()
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += [texts[30], texts[31].upper(), texts[32] + " more", texts[33] + "\n\n"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    check_kept(df, simhash.deduplicate(df))


def test_crowds_lose_no_near_copy(spark, monkeypatch):
    """Over a thousand variants of one text, and near copies among texts that are mostly one passage."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 200, raising=False)  # several blocks
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))

    def edited(words, n, start=0):
        words = [*words]
        for _ in range(n):
            words[rng.randrange(start, len(words))] = word()
        return words

    base, passage = [word() for _ in range(80)], [word() for _ in range(150)]
    texts = [edited(base, rng.randint(1, 4)) for _ in range(1200)]
    for _ in range(200):
        first = passage + [word() for _ in range(30)]
        texts += [first, edited(first, 1, 150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_kept(df, simhash.deduplicate(df))


@pytest.mark.parametrize("seed", range(4))
def test_block_links_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(50, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.concatenate([x[1:], x[:1] + np.uint64(1)])) for x in (rng.integers(0, 1 << 60, 30).astype(np.uint64) for _ in range(40)) for _ in (0, 1)]
    side = rng.random(len(sets)) < 0.5
    for left, right in ((np.arange(len(sets)),) * 2, (np.flatnonzero(side), np.flatnonzero(~side))):
        like = lambda x, y: (n := len(np.intersect1d(sets[x], sets[y]))) >= 0.8 * (len(sets[x]) + len(sets[y]) - n)
        links = [(x, y) for x in left.tolist() for y in right.tolist() if x != y and like(x, y)]
        found = list(zip(*simhash.block_links(sets, np.arange(len(sets)), left, right, 0.8)))
        assert set(found) <= set(links)
        groups = []
        for edges in (links, found):
            root = list(range(len(sets)))
            for x, y in edges:
                a, b = root[x], root[y]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
            groups.append(root)
        assert groups[0] == groups[1]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, small), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, small, steps):
    assert [n for n, _, _ in steps] == ["language_id", "toxicity", "simhash_dedup", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == COLUMNS and after.count() == after.join(before, "doc_id", "left_semi").count() > 0
    (_, _, spoken), (_, _, clean), (_, before, single), (_, last, pieces) = steps
    rejected = queries.op1_language_id(spark, small).where("rejected").select("doc_id")
    assert spoken.join(rejected, "doc_id").count() == 0
    labels = spark.read.parquet(f"{small}/labels.parquet")
    lost = spoken.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("toxic = 0").count() <= 0.05 * labels.where("toxic = 0").count()
    check_kept(before, single)
    check_packing([(r["doc_id"], r["text"]) for r in last.collect()], pieces.collect())


def test_run_gives_the_last_stage(spark, small, steps):
    run = corpus_pipeline.run(spark, small)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect() if r["start"] == 0)
    assert {k[0] for k in key(run)} == {k[0] for k in key(steps[-1][2])}
    assert run.agg(F.sum("length")).first() == steps[-1][2].agg(F.sum("length")).first()


def test_the_awkward_table_passes_every_stage(spark, small, awkward):
    docs, extra = awkward.drop("toxic"), [c for c in awkward.columns if c not in (*COLUMNS, "toxic")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, small), "awkward")
        assert after.columns == [*COLUMNS, *extra] and 0 < after.count() <= docs.count(), name
        docs = after
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], corpus_pipeline.STAGES[-1][1](spark, docs, small).collect())


def test_empty_tables_pass(spark, small, nothing):
    docs = nothing.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
