"""Each operator against a plain version, an exact round trip or held-out labels."""

import collections
import hashlib
import io
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.plans.materialise import materialise
from lexiloom.llm import iblt, language_id, media, packing, pieces, queries, sharding, simhash, token_counts, toxicity, warc
from lexiloom.llm._shared import fold_of

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(rows, expected):
    assert sorted(rows, key=key) == sorted(expected, key=key)


# 1 language ID


def test_language_is_learned_without_the_held_out_fold(spark, small):
    found = queries.op1_language_id(spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert sum(r["rejected"] for r in found) <= 2


def test_language_of_awkward_texts(documents, awkward, nothing):
    model = language_id.fit(documents)
    found = {r["doc_id"]: r for r in language_id.identify(awkward, model).collect()}
    for i in (0, 1, 2, None, 18, 19):  # nothing, white space, signs, digits
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[4]["lang_pred"] in model.languages
    assert language_id.identify(awkward, model).count() == awkward.count()
    assert language_id.identify(nothing, model).count() == 0
    empty = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.identify(awkward, empty).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    cyrillic = " ".join(random.Random(1).choice(["который", "было", "время", "слово"]) for _ in range(600))
    assert language_id.predict([cyrillic], model)[2][0]


def test_short_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = language_id.fit(docs), random.Random(2)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava"
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    chinese = "所有人生而自由在尊严和权利上一律平等他们赋有理性和良心"
    assert language_id.predict([finnish, chinese, chinese * 3], model)[2].all()
    assert language_id.predict([letters(n) for n in (20, 60, 300) for _ in range(50)], model)[2].mean() > 0.95
    cuts = [t[:n] for _, t in texts_of(docs) if t for n in (40, 120, 400) if len(t) > n]
    assert language_id.predict(cuts, model)[2].mean() < 0.02
    alone = language_id.fit(docs.where("lang <> 'es'").unionByName(docs.where("lang = 'es'").limit(3)))  # a language of few texts
    assert language_id.predict([chinese], alone)[2][0] and (alone.floor > 0).all()


def test_profile_does_not_depend_on_pieces(monkeypatch):
    texts = ["Alpha beta, gamma 12 délta! " * 50, "ΟΔΟΣ İstanbul " * 30, "a", "1 2 3", "ab" * 100]
    whole = [language_id.profile(t) for t in texts]
    for piece in (2, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t, w in zip(texts, whole):
            again = language_id.profile(t)
            assert (again is None and w is None) or (again == w).all()


def plain_profile(text):
    """Counts of the hashed n-grams, one by one."""
    low, mask, out = [c if c.isalpha() else " " for c in text.lower()], (1 << 32) - 1, collections.Counter()
    point = [ord(c) for c in low]
    pair = lambda i: (point[i] * 2246822519 + point[i + 1] * 3266489917) & mask
    grams = [p * 2654435761 & mask for p, c in zip(point, low) if c != " "]
    grams += [pair(i) for i in range(len(low) - 1) if low[i] != " " or low[i + 1] != " "]
    grams += [(pair(i) * 668265263 + point[i + 2] * 374761393) & mask for i in range(len(low) - 2) if low[i + 1] != " "]
    for g in grams:
        g ^= g >> 15
        out[(g * 2246822519 & mask) >> 20] += 1
    return out


def test_language_equals_a_plain_version(documents, awkward):
    """Profiles, weights, cosines to all centroids and floors, text by text."""
    model = language_id.fit(documents)
    rows = [r for df in (documents, awkward) for r in language_id.identify(df.where("doc_id is not null").dropDuplicates(["doc_id"]), model, keep=("doc_id", "text")).collect()]
    assert len(rows) > 250
    for r in rows:
        counts = plain_profile(r["text"] or "")
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
            continue
        weight = {g: np.log1p(n) * float(model.idf[g]) for g, n in counts.items()}
        norm = sum(x * x for x in weight.values()) ** 0.5
        cosine = [sum(x * float(c[g]) for g, x in weight.items()) / norm for c in model.centroids]
        best = max(cosine)
        assert abs(r["score"] - best) < 1e-4
        near = {model.languages[model.owner[i]] for i, c in enumerate(cosine) if c > best - 1e-5}
        assert r["lang_pred"] in near
        floor = model.floor[model.languages.index(r["lang_pred"]), min(31, int(np.log2(sum(counts.values()))))]
        assert abs(best - floor) < 1e-4 or r["rejected"] == (best < floor)


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"l{i:03}") for i in range(300)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    langs, _, _ = language_id.predict([t for _, t, _ in rows], model)
    assert langs == [x for _, _, x in rows]


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words here", "b" if i % 2 else "a") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_id.predict(["same words here"], model)[0] == ["a"]


# 2 token counts


def token_reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_token_counts_equal_the_library(documents, awkward, nothing):
    library = token_reference()
    for df in (documents, awkward):
        rows = texts_of(df)
        expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
        same([tuple(r) for r in token_counts.token_counts(df, BYTE_BPE).collect()], expected)
    assert token_counts.token_counts(nothing, BYTE_BPE).count() == 0


def test_token_counts_of_random_texts():
    library, rng = token_reference(), random.Random(3)
    texts = ["".join(rng.choice("stmdrvle'' \n\t.aé1<|　日") for _ in range(rng.randint(0, 1400))) for _ in range(200)]
    texts += ["'s's've'vex", "<|endoftext|>a <|endoftext|>", "x  ", "  a  \n b\t\t", "a" * 1500, "\x1c\x1dq"]
    assert token_counts.count_tokens(texts, BYTE_BPE).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_the_merger_starts_anew_when_full(monkeypatch):
    library, machine, rng = token_reference(), token_counts.merger(BYTE_BPE), random.Random(8)
    words = ["tokenization", "mississippi", "zzxqj", *["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(60)]]
    monkeypatch.setattr(token_counts, "MAX_STATES", 40)
    monkeypatch.setattr(token_counts, "LANES", 16)
    machine.reset()
    most = []
    monkeypatch.setattr(token_counts.Merger, "number_of", lambda self, state, f=token_counts.Merger.number_of: (f(self, state), most.append(len(self.states)))[0])
    assert token_counts.count_tokens([" ".join(words)], BYTE_BPE)[0] == len(library.encode(" ".join(words)).ids)
    assert len(most) > 200 and max(most) <= 40 + 2 * 16  # in the middle of a batch, too
    machine.reset()


def test_long_pretokens_by_chunk_maps(monkeypatch):
    """Words that are cut into chunks, from chunks longer to ones shorter than tokens."""
    library, rng = token_reference(), random.Random(2)
    texts = ["a" * 5000, "=-" * 3000, "".join(rng.choice("abcdefghij") for _ in range(9000)), "the" * 2000 + " x", "é" * 2500, "日本" * 1500]
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(texts, BYTE_BPE).tolist() == expected
    monkeypatch.setattr(token_counts, "STRIDE", 7)
    monkeypatch.setattr(token_counts, "RUN_UP", 3)
    monkeypatch.setattr(token_counts, "GUESSES", 2)
    assert token_counts.count_tokens(texts, BYTE_BPE).tolist() == expected


# 3 fingerprints


def split_lines(text):
    return {x for x in text.split("\n") if x}


def next_texts(rows):
    """Of each id, the next id's text: of several, the one with the least Spark hash."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[-(1 << 63) if i is None else i].append(t or "")
    order = sorted(by)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - ((h >> 63) << 64)
    first = {i: min(by[i], key=signed) for i in order}
    return {i: first[order[(k + 1) % len(order)]] for k, i in enumerate(order)}


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_fingerprints(name, request):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    after, expected = next_texts(rows), []
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in rows:
        t, follow = t or "", after[-(1 << 63) if i is None else i]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        own = split_lines(t)
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(own, split_lines(edited)), 12), round(jaccard(own, split_lines(follow)), 12)))
    found = iblt.fingerprints(df).collect()
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in found], expected)
    by_text, text = collections.defaultdict(set), dict(rows)
    for r in found:
        if sum(i == r["doc_id"] for i, _ in rows) == 1:
            by_text[text[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_no_rows(nothing):
    assert iblt.fingerprints(nothing).count() == 0


def spark_hash(k):
    """Murmur3 of a 64-bit number, as Spark's hash() gives it."""
    mask, h = (1 << 32) - 1, 42
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for part in (k & mask, k >> 32 & mask):
        part = turn(part * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h ^ part, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def opened(fingerprint):
    """Number of paragraphs and digests of a written fingerprint, by plain peeling of its leaves."""
    n, _, rest = fingerprint.split(":", 2)
    out = set()
    for leaf in rest.split("|"):
        shift, cells = leaf.split("/")
        cells = [[int(c[:-24], 16), int(c[-24:-8], 16), int(c[-8:], 16)] if c else [0, 0, 0] for c in cells.split(".")]
        place = lambda k: [8 * j + (k >> 12 * j + int(shift) & 7) for j in range(3)]
        while pure := [k for i, (m, k, c) in enumerate(cells) if m == 1 and c == spark_hash(k) and i in place(k)]:
            out.add(pure[0])
            for i in place(pure[0]):
                cells[i] = [cells[i][0] - 1, cells[i][1] ^ pure[0], cells[i][2] ^ spark_hash(pure[0])]
        assert not any(m or k for m, k, _ in cells)
    assert len(out) == int(n)
    return out


def test_likeness_follows_from_the_fingerprints(documents):
    unsigned = lambda ks: {k & (1 << 64) - 1 for k in ks}
    found = {r["doc_id"]: r for r in iblt.fingerprints(documents).collect()}
    order = sorted(found)
    digest = lambda t: {xxhash.xxh64_intdigest(x.encode(), 42) for x in split_lines(t)}
    text = dict(texts_of(documents))
    for i, follow in zip(order, [*order[1:], order[0]]):
        r = found[i]
        a, b, c = opened(r["fingerprint"]), opened(r["edited_fingerprint"]), opened(found[follow]["fingerprint"])
        assert a == digest(text[i])
        assert (unsigned(r["removed"]), unsigned(r["added"])) == (a - b, b - a)
        for near, other in ((r["near_edited"], b), (r["near_next"], c)):
            assert abs(near - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-12


def test_sketches_peel_and_retry(spark):
    rng, rows = random.Random(4), []
    for a, b, both in [(0, 0, 0), (0, 0, 5), (1, 0, 0), (3, 4, 50), (30, 40, 10), (300, 100, 200), (0, 900, 0), (1, 3000, 2), (2000, 2000, 0), (1, 1, 4000)]:
        x, y, z = ([rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (a, b, both))
        rows.append((x + z, y + z, sorted(x), sorted(y)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, x array<long>, y array<long>")
    df = df.withColumns({"fa": F.expr(iblt.fingerprint("a")), "fb": F.expr(iblt.fingerprint("b"))}).withColumn("d", F.expr(iblt.differing("fa", "fb")))
    for r in df.collect():
        assert sorted(q["k"] for q in r["d"] if q["n"] == 1) == r["x"] and sorted(q["k"] for q in r["d"] if q["n"] == -1) == r["y"]
        assert r["fa"]["n"] == len(r["a"]) and len(r["fa"]["leaves"]) == 1 << r["fa"]["d"]


def test_twenty_thousand_paragraphs(spark):
    text = lambda tag: "\n".join(f"{tag} line {i}" for i in range(20_000))
    df = spark.createDataFrame([("b", text("x")), ("a", "short\ntext"), ("c", text("y"))], "doc_id string, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in iblt.fingerprints(df).collect()}
    assert time.time() - began < 30
    assert [found[i]["near_next"] for i in "abc"] == [0.0, 0.0, 0.0] and 0.3 < found["b"]["near_edited"] < 0.4
    assert len(found["b"]["removed"]) > 9_000


# 4 SimHash


def plain_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    votes = collections.Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    found = simhash.components(df).select("doc_id", simhash.hex_of(), "component_id").collect()
    same([tuple(r) for r in found], [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)])


def test_simhash_pieces(monkeypatch):
    text = "Some words and\tmore words, then others. " * 40
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_crowds_keep_every_link(spark):
    """A dense group, chains and strangers: the same components as all pairs give."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        x = rng.choice(sorted(prints)) if rng.random() < 0.7 else base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(300)} | {0, 3}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = simhash.links(df).collect()
    root = list(range(len(prints)))
    at = {simhash._signed(p): i for i, p in enumerate(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(at[r["u"]])] = find(at[r["v"]])
    groups = lambda roots: {frozenset(i for i in range(len(prints)) if roots[i] == r) for r in set(roots)}
    assert groups([find(i) for i in range(len(prints))]) == groups(plain_components(prints))


def test_simhash_of_no_rows(nothing):
    assert simhash.components(nothing).count() == 0


# 5 toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(found[i], x) for i, x in labels.items() if found[i]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert np.mean([r["predicted"] for r, x in held if x]) >= 0.6 and np.mean([r["predicted"] for r, x in held if not x]) <= 0.08


def plain_marginals(e, m, first):
    """P(toxic) of every token by forward-backward over all of them; emissions are toxic over clean."""
    ahead, back = [np.array([1, first * e[0]])], [np.ones(2)]
    for x in e[1:]:
        ahead.append((ahead[-1] / ahead[-1].sum()) @ m * [1, x])
    for x in e[:0:-1]:
        back.append(m @ ([1, x] * back[-1] / back[-1].sum()))
    p = np.array(ahead) * np.array(back[::-1])
    return p[:, 1] / p.sum(1)


def test_messages_equal_forward_backward(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 7, 8, 50, 1, 14, 0, 200])
    e, m = np.exp(rng.normal(size=lengths.sum()) * 2), np.exp(rng.normal(size=(2, 2)))
    expected = np.concatenate([plain_marginals(e[k : k + n], m, 0.7) for k, n in zip(np.cumsum(lengths) - lengths, lengths) if n])
    for stride, cells in ((1, 4), (7, 30), (512, 1 << 18), (512, 1)):
        monkeypatch.setattr(toxicity, "STRIDE", stride)
        monkeypatch.setattr(toxicity, "CELLS", cells)
        r, b = toxicity.Parts(lengths).ratios(e, m, 0.7)
        np.testing.assert_allclose(r * b / (1 + r * b), expected, rtol=1e-9)


def plain_score(model, text):
    """Emissions word by word, the whole chain, the score, and the spans' texts."""
    low = (text or "").lower()
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)] if model.learned else []
    e = []
    for i, (w, _, _) in enumerate(words):
        total = sum(model.own[k] for k in toxicity.hashed(w))
        total += model.before[toxicity.neighbour(words[i - 1][0])] if i else 0
        total += model.after[toxicity.neighbour(words[i + 1][0])] if i + 1 < len(words) else 0
        e.append(np.exp(np.clip(total, -30, 30)))
    p = plain_marginals(np.array(e), np.exp(model.move), np.exp(model.first)) if e else np.zeros(0)
    x = [1, p.max(), np.log1p(p.sum()), 3 * p.mean() ** 0.5] if len(p) else [1, 0, 0, 0]
    return 1 / (1 + np.exp(-np.dot(model.line, x))), [i for i, y in enumerate(p) if y >= 0.5], words


def toxic_texts(n=200):
    """Lines of the same words for both labels, but for the planted ones."""
    rng, docs = random.Random(12), []
    for i in range(n):
        for label in (0, 1):
            words = rng.choices(["kind", "word", "number", "for", "you", "away", "line", "thing", "go", "such", "an", "indeed"], k=rng.randint(5, 25))
            if label:
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "loser"]))
            docs.append((" ".join(words) + f" {i}\nnext line", label))
    return docs


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = toxic_texts()
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(docs)], "doc_id long, text string, toxic int")
    return toxicity.fit(df, df)


def test_scores_equal_a_plain_version(toxic_model, documents, awkward):
    for df in (documents.limit(120), awkward):
        for r in toxicity.score(df, toxic_model, keep=("doc_id", "text")).collect():
            expected, toxic, words = plain_score(toxic_model, r["text"])
            assert abs(r["score"] - expected) < 1e-6 and r["predicted"] == (r["score"] >= 0.5)
            assert [i for i, (_, a, b) in enumerate(words) if any(x["start"] <= a and b <= x["end"] for x in r["spans"])] == toxic


def test_spans_against_labelled_spans(toxic_model):
    """Planted words, at places that are known, and no others."""
    rng, right, found, planted = random.Random(3), 0, 0, 0
    for _ in range(200):
        words = [rng.choice(["kind", "word", "number", "for", "you", "away", "line", "thing", "go"]) for _ in range(rng.randint(3, 40))]
        at = {rng.randrange(len(words)) for _ in range(rng.randint(0, 2))}
        words = [rng.choice(["idiot", "loser"]) if i in at else w for i, w in enumerate(words)]
        spans = toxicity.spans_of(" ".join(words), toxicity.Chain(toxic_model).marginals([" ".join(words)])[0])
        covered = {" ".join(words)[: x["start"]].count(" ") + k for x in spans for k in range(" ".join(words)[x["start"] : x["end"]].count(" ") + 1)}
        right, found, planted = right + len(covered & at), found + len(covered), planted + len(at)
    assert right >= 0.95 * planted and right >= 0.95 * found


def test_spans_and_awkward_texts(spark, toxic_model, awkward, nothing):
    text = "Such an IDIOT indeed"
    _, (spans,) = toxicity.Chain(toxic_model).read([text])
    assert [text[s["start"] : s["end"]] for s in spans] == ["IDIOT"]
    found = toxicity.score(awkward, toxic_model).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(not r["predicted"] for r in found if r["doc_id"] in (0, 1, 2, 4))
    assert toxicity.score(nothing, toxic_model).count() == 0
    assert toxicity.score(awkward, toxicity.fit(nothing, nothing)).where("predicted = 1").count() == 0


def test_most_texts_have_a_score_of_their_own(spark):
    scores = collections.Counter(r["score"] for r in queries.op5_toxicity(spark, "/root/testdata/sf0.01").collect())
    assert scores.most_common(1)[0][1] < 0.05 * sum(scores.values())


def test_the_field_learns_from_all_lines(monkeypatch):
    """More marked lines than 1200, and marked words late in long lines reach the training."""
    word = lambda i: "".join("bcdfghjklm"[int(c)] + "a" for c in str(i))
    docs = [(f"{'so ' * (i % 40)}idiot {'and ' * (i // 40)}{word(i)}", 1) for i in range(1400)] + [(f"{'nice ' * 300}idiot end", 1), ("fine " * 3900 + "idiot", 1)] + [(f"kind {word(i)} words", 0) for i in range(1400)]
    taken = []
    monkeypatch.setattr(toxicity, "train_field", lambda lines, words, train=toxicity.train_field: taken.extend(lines) or train(lines, words, rounds=2))
    toxicity.learn(docs)
    assert sum(y.any() for _, y in taken) > 1000 and any(len(x) == 302 and y[300] for x, y in taken) and any(len(x) == 3901 and y[-1] for x, y in taken)


def test_very_long_texts_are_not_learned_from(spark):
    """Of a key with several texts one is, and a key without a text none."""
    docs = toxic_texts()
    rows = [(i, t, x) for i, (t, x) in enumerate(docs)] + [(0, "another text", docs[0][1]), (9000, "x" * 30_000, 1), (9001, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    again = toxicity.fit(df, df)
    assert again.learned and toxicity.Chain(again).read(["you idiot go"])[0][0, 0] > 0.5
    assert not toxicity.fit(df.where("doc_id > 8999"), df).learned


# 6 SentencePiece


def test_pieces_equal_the_library(documents, awkward, nothing):
    library = pieces.segmenter(PIECES).library
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (documents, awkward):
        expected = []
        for i, t in texts_of(df):
            ids = library.encode(t or "")
            expected.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
        same([tuple(r) for r in pieces.encode_decode(df, PIECES).collect()], expected)
    full = pieces.encode_decode(awkward, PIECES, with_ids=True).collect()
    text = dict(texts_of(awkward))
    assert all(r["ids"] == library.encode(text[r["doc_id"]] or "") for r in full if r["doc_id"] is not None)
    assert pieces.encode_decode(nothing, PIECES).count() == 0


def test_each_distinct_chunk_is_segmented_once(documents, tmp_path):
    """Every call of the library is noted: no chunk is passed to it twice, and none is left for the second pass."""
    source = documents.select(F.coalesce("text", F.lit("")).alias("__text")).repartition(7)
    blocks = materialise(pieces.asked(source, 0), "asked")
    asked, folder, model = pieces.meeting(blocks), str(tmp_path), PIECES

    def count(batches):
        import json as j
        import os as o
        import uuid

        from lexiloom.llm import pieces as p

        real = p.Segmenter.ids
        p.Segmenter.ids = lambda self, some: (open(f"{folder}/{o.getpid()}-{uuid.uuid4().hex}", "w").write(j.dumps(some)), real(self, some))[1]
        try:
            yield from p.segment_batches(batches, model)
        finally:
            p.Segmenter.ids = real

    found = asked.mapInArrow(count, pieces.ANSWERS).agg(F.sum(F.col("n")[0])).first()[0]
    seen = [c for f in tmp_path.iterdir() for c in json.loads(f.read_text())]
    every = {c for _, t in texts_of(documents) for c in pieces.CHUNK.findall(pieces.MARK + t.replace(" ", pieces.MARK) if t else "")}
    assert len(seen) == len(set(seen)) and set(seen) == every and found == blocks.count() > len(seen)


def test_answers_that_do_not_fit_are_segmented_again(spark, monkeypatch):
    library, known = pieces.segmenter(PIECES), pieces.Positions()
    known.of("some words some more \n\n é日 <s> \x00 ①")
    chunks = list(known)
    ids = library.ids(chunks)
    rows = [(0, at, "other" if at == 1 else c) for at, c in enumerate(chunks)] + [(2, at, c) for at, c in enumerate(chunks[:3])]
    table = materialise(pieces.segmented(spark.createDataFrame(rows, "block long, at int, chunk string"), PIECES), "answers", "block")
    asked = []
    monkeypatch.setattr(pieces.Segmenter, "ids", lambda self, some, f=pieces.Segmenter.ids: (asked.extend(some), f(self, some))[1])
    for block, wrong in ((0, [chunks[1]]), (1, chunks), (2, chunks[3:])):
        entries = pieces.Entries(table._lexiloom_path, block, PIECES)
        entries.learn(known)
        assert entries.ids == [",".join(map(str, x)) for x in ids] and entries.decoded == library.decoded(ids) and entries.count.tolist() == list(map(len, ids))
        assert asked == wrong
        asked.clear()


def test_blocks_end_and_go_on(documents, monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(pieces.TaskContext, "get", staticmethod(lambda: Task))
    monkeypatch.setattr(pieces, "BLOCK", 5)
    blocks = pieces.Blocks()
    blocks.known.of("a b c d e f")
    assert blocks.full() and blocks.block == 3 << 32
    blocks.next()
    assert blocks.block == (3 << 32) + 1 and not blocks.full()


def test_pieces_of_long_texts_in_parts(spark, monkeypatch):
    known, text = pieces.Positions(), "  Some words\n\nand ▁ more, é 日本 " * 30
    whole = known.of(text)
    found = pieces.segmenter(PIECES).ids(list(known))
    ids, decoded = [",".join(map(str, x)) for x in found], pieces.segmenter(PIECES).decoded(found)
    made = pieces.digests(whole, ids, decoded)
    monkeypatch.setattr(pieces, "PART", 7)
    assert (pieces.Positions().of(text) == whole).all() and pieces.digests(whole, ids, decoded) == made


def test_blocks_of_many_chunks(spark):
    """More distinct chunks in a block than 16 bits count."""
    text = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, text), (2, "w1 w69999")], "doc_id long, text string").coalesce(1)
    library = pieces.segmenter(PIECES).library
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.encode_decode(df, PIECES).collect()} == {1: len(library.encode(text)), 2: len(library.encode("w1 w69999"))}


# 7 packing


def check_packing(rows, found, window=4096):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    used = collections.defaultdict(list)
    for r in found:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in found) == sum(len(x) for v in ids.values() for x in v)
    ends = {}
    for s, parts in used.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        ends[s] = at
    assert sorted(used) == list(range(len(used)))
    assert all(n == window for s, n in ends.items() if s != max(ends, default=0)) and all(n <= window for n in ends.values())
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for r in found:
        assert any(r["doc_tokens"] == len(x) and r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for x in ids[r["doc_id"]])
    for i, several in ids.items():
        if len(several) == 1:
            mine = sorted((r["start"], r["length"]) for r in found if r["doc_id"] == i)
            assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1].tolist()] and sum(n for _, n in mine) == len(several[0])


def test_packing(documents, awkward, nothing):
    for df in (documents, awkward):
        check_packing(texts_of(df), packing.pack(df, WORD_BPE).collect())
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_windows_keep_the_mixture(spark):
    """Each round's credit covers what its source has sent, and no source lags by more than a document."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(1, 60)) for i in range(4000)]
    found = packing.schedule(spark.createDataFrame(rows, "key long, source string, n_ids long"), window=512).orderBy("start").collect()
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_ids"] for r in found])[:-1].tolist()]
    total = sum(n for _, _, n in rows)
    share = {s: sum(n for _, t, n in rows if t == s) / total for s in "abc"}
    sent = collections.Counter()
    for r in found:
        sent[r["source"]] += r["n_ids"]
        assert sent[r["source"]] <= r["round"] * 512 * share[r["source"]] + 1e-6
        if r["start"] % 512 < r["n_ids"] and r["start"] > 5000:
            for s in "abc":
                assert abs(sent[s] / (r["start"] + r["n_ids"]) - share[s]) < 0.08


def test_long_documents_keep_the_mixture_in_every_window(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice("aaabcdefgh"), rng.randint(1, 6000)) for i in range(400)]
    found = packing.schedule(spark.createDataFrame(rows, "key long, source string, n_ids long"), window=512).orderBy("start").collect()
    total, size, share = sum(n for _, _, n in rows), {i: n for i, _, n in rows}, collections.Counter()
    cells, done = collections.defaultdict(collections.Counter), collections.Counter()
    for _, s, n in rows:
        share[s] += n / total
    for r in found:
        assert r["at"] == done[r["key"]]
        done[r["key"]] += r["n_ids"]
        for t in range(r["start"], r["start"] + r["n_ids"]):
            cells[t // 512][r["source"]] += 1
    assert done == size
    assert all(sum(abs(c[s] / 512 - share[s]) for s in share) / 2 < 0.05 for w, c in cells.items() if w < total // 512)


def test_sources_of_less_than_a_token_a_round(spark):
    rows = [(i, "a", 50) for i in range(1000)] + [(5000, "b", 30), (5001, "b", 1)]
    found = packing.schedule(spark.createDataFrame(rows, "key long, source string, n_ids long"), window=512).orderBy("start").collect()
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_ids"] for r in found])[:-1].tolist()]
    assert found[-1]["start"] + found[-1]["n_ids"] == 50031
    rare = [r["start"] // 512 for r in found if r["source"] == "b"]
    assert len(rare) == 31 and max(collections.Counter(rare).values()) <= 1


def test_given_shares(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(2000)]
    found = packing.schedule(spark.createDataFrame(rows, "key long, source string, n_ids long"), window=200, shares={"a": 0.75, "b": 0.25}).orderBy("start").collect()
    early = collections.Counter(r["source"] for r in found[:1000])
    assert abs(early["a"] / 1000 - 0.75) < 0.03


def test_sources_without_a_share_follow(spark):
    """In their own proportions, and not as one lump."""
    rng = random.Random(3)
    rows = [(i, "abcd"[i % 4], rng.randint(1, 40)) for i in range(2000)]
    found = packing.schedule(spark.createDataFrame(rows, "key long, source string, n_ids long"), window=100, shares={"a": 0.5, "b": 0.5, "z": 1.0}).orderBy("start").collect()
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_ids"] for r in found])[:-1].tolist()]
    last = max(i for i, r in enumerate(found) if r["source"] in "ab")
    first = min(i for i, r in enumerate(found) if r["source"] in "cd")
    assert last < first and sum(r["n_ids"] for r in found) == sum(n for _, _, n in rows)
    cells = collections.defaultdict(collections.Counter)
    for r in found[first:]:
        for t in range(r["start"] - found[first]["start"], r["start"] - found[first]["start"] + r["n_ids"]):
            cells[t // 100][r["source"]] += 1
    assert all(abs(c["c"] - c["d"]) <= 12 for w, c in cells.items() if w < max(cells))


def test_another_split_is_refused(monkeypatch):
    import regex

    monkeypatch.setattr(packing, "SPLIT", regex.compile(r"\S+"))
    with pytest.raises(ValueError):
        packing.WordTable(WORD_BPE)


# 8 WARC


def test_warc_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(1000, None, None), (1001, "http://a\r\nb", ""), (1002, "u", "x" * 99), (1003, "u", "x" * 99), (1004, "u", "é" * 50), (1006, "u", "é" * 50), (1005, "u", "é" * 50), (1005, "u", "é" * 50), (None, "u", "é" * 50), (1007, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)], "page_id long, url string, html string").withColumn("first", F.lit("x")).withColumn("digest", F.lit("y"))
    both = pages.unionByName(extra, allowMissingColumns=True).repartition(3)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in both.collect()]
    first = {}
    for i, body in rows:
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    expected = [(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if b in first and first[b] != i else "response", first[b] if b in first and first[b] != i else None) for i, b in rows]
    same([tuple(r) for r in warc.round_trip(both).collect()], expected)
    assert warc.round_trip(both.limit(0)).count() == 0


def test_transactions_are_nested_rows(spark):
    page = spark.createDataFrame([(7, "http://x/", "<p>hello</p>" * 20)], "page_id long, url string, html string")
    folder = warc.fresh_path(spark, "test-warc")
    files = warc.write_archives(warc.dedupe(page), folder)
    row = warc.assemble(warc.scan_records(files, folder)).first()
    assert row["request"]["type"] == "request" and row["main"]["type"] == "response" and row["metadata"]["fields"].startswith("page-id: 7")
    assert row["main"]["length"] == 240 and row["main"]["uri"] == "http://x/"


def test_archives_of_long_pages_and_clashing_columns(spark):
    rows = [(1, "http://a/", "<p>" + "long é " * 400_000), (2, "http://b/", "<p>" + "long é " * 400_000), (3, None, "z" * 3_000_000), (4, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("digest", "first", "refers_to", "refers_uri", "path", "captures", "type", "n"):
        pages = pages.withColumn(name, F.lit("clash"))
    found = {r["page_id"]: r for r in warc.round_trip(pages.repartition(2)).collect()}
    assert {i: (r["payload_bytes"], r["record_type"], r["refers_to"]) for i, r in found.items()} == {1: (3_200_003, "response", None), 2: (3_200_003, "revisit", 1), 3: (3_000_000, "response", None), 4: (200, "response", None)}
    assert all(found[i]["payload_digest"] == hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows)


def test_archives_open_with_information(spark):
    pages = warc.dedupe(spark.createDataFrame([(i, f"http://{i}/", "same" * 50) for i in (5, 4, 6)], "page_id long, url string, html string"))
    rows = {r["page_id"]: r for r in pages.collect()}
    assert (rows[4]["refers_to"], rows[5]["refers_to"], rows[5]["refers_uri"]) == (None, 4, "http://4/")
    records = b"".join([warc.member(warc.information("x.warc.gz")), *map(warc.member, warc.capture_records("c", 5, "http://5/", None, "d", 200, 4, "http://4/"))])
    kinds = [(h["WARC-Type"], h.get("WARC-Refers-To-Target-URI")) for h, _ in warc.read_records(iter([records[:50], records[50:]]))]
    assert kinds == [("warcinfo", None), ("request", None), ("revisit", "http://4/"), ("metadata", None)]


# 9 media


def test_media_round_trip(documents, awkward, nothing):
    for df in (documents, awkward):
        expected = []
        for i, t in texts_of(df):
            data = (t or "").encode()
            full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
            stored = media.to_image(full)
            expected.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
        same([tuple(r)[:7] for r in media.text_media(df).collect()], expected)
    assert media.text_media(nothing).count() == 0


def test_tiles_and_features_equal_a_plain_version(documents, awkward):
    """Means of cells by whole pixels and fractions of pixels, one cell after another."""
    def share(size, n, i):
        low, high = i * size / n, (i + 1) * size / n
        return [(k, min(k + 1, high) - max(k, low)) for k in range(size) if min(k + 1, high) > max(k, low)]

    for df in (documents.limit(25), awkward.limit(25)):
        for r in media.text_media(df.where("length(text) < 3000")).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            data = r["text"].encode()
            pixels = np.frombuffer(data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data)), np.uint8).reshape(-1, 24, 3)
            tile, h = np.load(io.BytesIO(r["tile"])), len(pixels)
            assert tile.shape == (8, 9, 3) and tile.dtype == "<u2" and (r["height"], r["width"], r["channels"]) == pixels.shape
            mean = [[[sum(fy * fx * float(pixels[y, x, c]) for y, fy in share(h, 8, i) for x, fx in share(24, 9, j)) / (h * 24 / 72) for c in range(3)] for j in range(9)] for i in range(8)]
            assert abs(tile - 64 * np.array(mean)).max() < 0.5001
            total = tile.astype(int).sum(2)
            assert int(r["feature"], 16) == int("".join(str(int(total[i, j + 1] > total[i, j])) for i in range(8) for j in range(8)), 2)


def test_formats():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (5, 7), (16, 24)):
        colour, grey = rng.integers(0, 256, (h, w, 3), np.uint8), rng.integers(0, 256, (h, w, 1), np.uint8)
        assert (media.decode(media.encode_bmp(colour)) == colour).all()
        assert (media.decode(media.encode_netpbm(colour)) == colour).all() and (media.decode(media.encode_netpbm(grey)) == grey).all()
        plain = b"P3 # a comment\n%d %d\n255\n" % (w, h) + " ".join(map(str, colour.ravel())).encode()
        assert (media.decode(plain) == colour).all()
        bits = rng.integers(0, 2, (h, w), np.uint8)
        packed = b"P4\n%d %d\n" % (w, h) + np.packbits(bits, axis=1).tobytes()
        assert (media.decode(packed)[..., 0] == (1 - bits) * 255).all()
        assert (media.decode(b"P1\n%d %d\n" % (w, h) + b" ".join(b"%d" % b for b in bits.ravel()))[..., 0] == (1 - bits) * 255).all()


def test_bad_images_have_nulls(spark):
    good = media.encode_netpbm(np.zeros((4, 4, 3), np.uint8))
    df = spark.createDataFrame([(1, 0, good), (2, 0, good[:-1]), (3, 0, b"BMxx"), (4, 0, b""), (5, 0, None)], "doc_id long, n_bytes long, media binary")
    found = {r["doc_id"]: r for r in media.describe(df).collect()}
    assert found[1]["payload_bytes"] == 48 and np.load(__import__("io").BytesIO(found[1]["tile"])).shape == (8, 9, 3)
    assert all(found[i]["payload_bytes"] is None and found[i]["feature"] is None for i in (2, 3, 4, 5))


def test_area_resize_is_exact():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (12, 18, 3), np.uint8)
    np.testing.assert_allclose(media.area_resize(pixels, 4, 6), pixels.reshape(4, 3, 6, 3, 3).mean((1, 3)))
    big = np.kron(pixels, np.ones((5, 7, 1)))  # every pixel as 5 x 7 equal ones
    small = big.reshape(5, 12, 7, 18, 3).mean((1, 3))
    np.testing.assert_allclose(media.area_resize(pixels, 5, 7), small)


# 10 sharding


def plain_fill(shards, slots):
    orders = [[(o + j * s) % slots for j in range(slots)] for o, s in (sharding.preference(x, slots) for x in shards)]
    owner, at, n = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while owner[orders[i][at[i]]] >= 0:
                at[i] += 1
            owner[orders[i][at[i]]] = i
            n += 1
            if n == slots:
                return owner


def test_table_is_even_and_steady():
    names = [f"s{i}" for i in range(7)]
    full = sharding.fill(names, 251)
    assert full == plain_fill(names, 251)
    sizes = collections.Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill(names[:-1], 251)
    moved = sum(a != b for a, b in zip(full, less) if a != 6)
    assert moved < 0.25 * 251
    for bad in (([], 251), (names, 250), (["a", "a"], 251)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark, documents, awkward, nothing):
    owner = sharding.fill([f"shard-{i}" for i in range(64)])
    for df in (documents, awkward):
        rows = [r["doc_id"] for r in df.select("doc_id").collect()]
        slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 65537
        same([tuple(r) for r in sharding.place(df).collect()], [(i, slot(i), owner[slot(i)]) for i in rows])
    assert sharding.place(nothing).count() == 0
    assert sharding.place(documents, "source", shards=["a", "b"], keep=("doc_id", "source")).columns == ["doc_id", "source", "slot", "shard"]


def test_folds(spark):
    df = spark.createDataFrame([(1,), (None,), (-5,)], "doc_id long")
    assert [r[0] for r in df.select(fold_of()).collect()] == [zlib.crc32(x) % 5 for x in (b"1", b"", b"-5")]
