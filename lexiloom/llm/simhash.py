"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints link if they differ in at most ``RADIUS`` bits. Each distinct
fingerprint gets its Hamming distances to many reference fingerprints. The
references lie in bands of bits: distances to the references of one band, less
the distance to the zero reference, depend on the fingerprint's bits in that
band only and tell nearly all of them apart. Two fingerprints that link differ in
two bands at most, so their distances to the references of the other bands are
the same: candidates meet where all distances of ``BANDS - RADIUS`` bands agree.

Where more than ``GROUP`` meet, as in large groups of near copies, finer references
deal them out again, in the same way: each band that may still differ falls into
``PARTS`` parts, and candidates meet where the distances of all parts but
``RADIUS`` agree as well. What meets then differs in ten bits at most, so no
meeting has more than 1024 fingerprints, whatever the number of near copies.

A candidate pair is discarded when any of its distances differ by more than
``RADIUS``; what survives is verified bit by bit.

``components`` is the operator; ``deduplicate`` is the filter of a pipeline,
which keeps one text of each group by the similarity of word shingles.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches, beside
from lexiloom.plans.components import connected_components
from lexiloom.plans.materialise import materialise, release

RADIUS = 2
BANDS = 5
PER_BAND = 14
PARTS = 3  # of a band
GROUP = 16
PAIRS = 1 << 16  # that are compared at once
CROWD = 12
SEED = 42
PIECE = 1 << 20
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    start = 0
    while start < len(data):
        cut = BREAK.search(data, start + PIECE) if start + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, repeats included, by parts of a long text; of fewer words, that of the whole sequence."""
    if not text:
        return
    rest, found, digest = [], False, xxhash.xxh64_intdigest
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        words = rest + piece.split()
        rest = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        found = True
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    if not found and rest:
        yield np.array([digest(b" ".join(rest), SEED)], np.uint64)


def vote(parts: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes: a bit is set if it is in over half of them."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text; zero if it has no word."""
    return vote(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` and the fingerprint (fp, a signed long) of every row; a null text counts as empty."""
    arrow_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).alias(beside(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, "fp"])

    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["fp long"]))


def references(seed: int = 7) -> list[list[int]]:
    """Reference fingerprints of each band: random patterns inside it, and single runs of its bits."""
    rng = random.Random(seed)
    edges = [round(i * 64 / BANDS) for i in range(BANDS + 1)]
    return [[rng.getrandbits(b - a) << a for _ in range(PER_BAND - 1)] + [((1 << (b - a)) - 1) << a] for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference)).cast("long")))


def fine_references() -> list[list[int]]:
    """References of each part of the bands: the single bits that it holds."""
    edges = [round(i * 64 / BANDS) for i in range(BANDS + 1)]
    cuts = [[a + round(k * (b - a) / PARTS) for k in range(PARTS + 1)] for a, b in zip(edges, edges[1:])]
    return [[1 << bit for bit in range(a, b)] for band in cuts for a, b in zip(band, band[1:])]


def _agreement(fp: Column, bands: list[list[int]]) -> list[Column]:
    """Of each band, a hash of the distances to its references less that to the zero reference."""
    return [F.xxhash64(*[_distance(fp, r) - F.bit_count(fp) for r in band]) for band in bands]


HELD = list(combinations(range(BANDS), BANDS - RADIUS))


def pivot_keys(classes: DataFrame) -> DataFrame:
    """(fp, held, key): the keys under which candidates meet, one for each choice of bands that agree."""
    out = classes.select("fp", *[c.alias(f"__b{i}") for i, c in enumerate(_agreement(F.col("fp"), references()))])
    keys = [F.struct(F.lit(i).alias("held"), F.xxhash64(F.lit(i), *[F.col(f"__b{b}") for b in held]).alias("key")) for i, held in enumerate(HELD)]
    return out.select("fp", F.inline(F.array(*keys)))


def finer_keys(met: DataFrame) -> DataFrame:
    """(fp, key): those of (fp, held, key) dealt out by the parts of the bands that may differ."""
    choices = []
    for held in HELD:
        parts = [b * PARTS + k for b in range(BANDS) if b not in held for k in range(PARTS)]
        choices.append([list(c) for c in combinations(parts, len(parts) - RADIUS)])
    text = ", ".join("array(" + ", ".join("array(" + ", ".join(map(str, c)) + ")" for c in one) + ")" for one in choices)
    out = met.select("fp", "held", "key", F.array(*_agreement(F.col("fp"), fine_references())).alias("__p"))
    size = len(choices[0][0])
    keys = f"transform(array({text})[held], (c, i) -> xxhash64(key, i, {', '.join(f'__p[c[{k}]]' for k in range(size))}))"
    return out.select("fp", F.explode(F.expr(keys)).alias("key"))


def _near(fps: np.ndarray, coords: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs link: by the largest difference of their distances first, then by their bits."""
    out = np.zeros(len(left), bool)
    for k in range(0, len(left), PAIRS):
        a, b = left[k : k + PAIRS], right[k : k + PAIRS]
        kept = np.flatnonzero(np.abs(coords[a] - coords[b]).max(1) <= RADIUS)
        out[k + kept[np.bitwise_count(fps[a[kept]] ^ fps[b[kept]]) <= RADIUS]] = True
    return out


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links between n members, as many as connect them."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(left.tolist(), right.tolist()):
        near[a].append(b)
        near[b].append(a)
    seen = [False] * n
    for start in range(n):
        queue = [] if seen[start] else [start]
        seen[start] = True
        for x in queue:
            for y in near[x]:
                if not seen[y]:
                    seen[y] = True
                    queue.append(y)
                    yield x, y


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) that link, and that connect all fingerprints of ``classes`` (distinct fp) that all links do."""
    table = pivot_keys(classes)
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = table.join(sizes, "key")
    small = met.where(F.col("n") <= GROUP).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    fine = finer_keys(met.where(F.col("n") > GROUP)).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pivots = np.array([r for band in references() for r in band], np.uint64)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            sizes = np.diff(np.asarray(members.offsets))
            fps = np.asarray(members.flatten()).view(np.uint64)
            coords = np.bitwise_count(fps[:, None] ^ pivots).astype(np.int8)
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in np.unique(sizes).tolist():
                base = first[sizes == n]
                a, b = np.triu_indices(n, 1)
                if n <= GROUP:
                    left, right = (base[:, None] + a).ravel(), (base[:, None] + b).ravel()
                    near = _near(fps, coords, left, right)
                    us.append(left[near])
                    vs.append(right[near])
                    continue
                for start in base.tolist():
                    near = _near(fps, coords, start + a, start + b)
                    kept = np.array(list(_forest(n, a[near], b[near])), np.int64).reshape(-1, 2) + start
                    us.append(kept[:, 0])
                    vs.append(kept[:, 1])
            u, v = (fps[np.concatenate(x)].view(np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return small.select("fps").unionByName(fine.select("fps")).mapInArrow(survivors, "u long, v long")


def components(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``key``, fp and component_id, the least ``key`` that links reach, of every row.

    Null texts count as empty; texts without a word have fingerprint zero and
    link like any other. Repeated rows and repeated ids stay as rows. A null id
    is never the least one unless its whole component has none. An empty table
    gives an empty result, and other columns of the table are not read.
    """
    rows = materialise(fingerprints(df, text, (key,), shingle), "simhash")
    classes = rows.groupBy("fp").agg(F.min(key).alias("least"))
    reached = connected_components(links(classes.select("fp")))
    named = classes.join(reached, classes["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(key, "fp", "component_id")


SAMPLES = 8
SAMPLE_SIZE = 2
HEAVY = 4096
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 18, 512


def sampled(hashes: np.ndarray) -> list[int]:
    """Fingerprints of samples: of each, the shingles whose hash, mixed by the sample's own number, is least."""
    out, hashes = [], np.unique(hashes)
    for i in range(SAMPLES):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.argpartition(mixed, min(SAMPLE_SIZE, len(mixed)) - 1)[:SAMPLE_SIZE]
        out.append(vote(iter([hashes[least]])))
    return out


def _similar(a: str, b: str, shingle: int, similarity: float) -> bool:
    x, y = (np.unique(np.concatenate([*shingle_hashes(t, shingle), np.zeros(0, np.uint64)])) for t in (a, b))
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def _with_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows``, ``total`` or fewer, with the columns of their group of (slot, sample, n), n being its rows; rows of no group are left out.

    Groups of more than one HEAVYth of all rows are fewer than HEAVY, so these
    are broadcast and their rows stay where they are; the rows of the others are
    dealt by group.
    """
    keys, least = ["slot", "sample"], total // HEAVY
    heavy = groups.where(F.col("n") > least)
    there = rows.join(F.broadcast(heavy), keys)
    return there.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.where(F.col("n") <= least), keys))


def _pairs(members: DataFrame, *keys: str) -> DataFrame:
    """All pairs (u, v) of rep within the small groups of ``keys``."""
    few = members.groupBy(*keys).agg(F.array_sort(F.collect_list("rep")).alias("m"))
    return few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as u, y as v))))")).alias("p")).select("p.*")


def block_links(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that join the parts of sets as all similar pairs of a ``left`` and a ``right`` position would.

    ``sets`` hold distinct hashes. Common hashes are counted for all pairs:
    those of many sets by products of a dense matrix, the others by lists.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    many = often > max(2, len(sets) // 16)  # so the matrix has at most 16 cells for each hash of the sets
    column = np.cumsum(many) - 1
    dense = np.zeros((len(sets), int(many.sum())), np.float32)
    dense[owner[many[token]], column[token[many[token]]]] = 1
    few = ~many[token] & (often[token] > 1)
    place = np.full(len(sets), -1)
    place[right] = np.arange(len(right))
    listed = few & (place[owner] >= 0)
    order = np.argsort(token[listed], kind="stable")
    holders, length = place[owner[listed]][order], np.bincount(token[listed], minlength=len(often))
    start = np.cumsum(length) - length
    edge = np.concatenate([[0], np.cumsum(size)])
    _, part = np.unique(part, return_inverse=True)
    root, us, vs = np.arange(part.max(initial=-1) + 1), [], []
    opposite = dense[right].T

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(0, len(left), 256):
        if (part == part[0]).all():
            break
        rows = left[k : k + 256]
        common = dense[rows] @ opposite
        for i, x in enumerate(rows.tolist()):
            own = token[edge[x] : edge[x + 1]][few[edge[x] : edge[x + 1]]]
            n = length[own]
            if n.sum():
                at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common[i] += np.bincount(holders[at], minlength=len(right))
        common = common.astype(np.float64)
        near = common >= similarity * (size[rows][:, None] + size[right] - common)
        a, b = np.nonzero(near & (part[rows][:, None] != part[right]))
        _, first = np.unique(part[rows[a]] * len(root) + part[right[b]], return_index=True)
        for x, y in zip(rows[a[first]].tolist(), right[b[first]].tolist()):
            p, q = find(part[x]), find(part[y])
            if p != q:
                root[p] = q
                us.append(x)
                vs.append(y)
        part = np.array([find(x) for x in range(len(root))])[part]
    return us, vs


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, all their columns, one of each group of near-duplicates: that of the least ``key``.

    Texts are near-duplicates if their sets of word shingles have a Jaccard
    similarity of ``similarity`` or more, directly or through others. One
    fingerprint finds few such pairs within a small radius, so every text has
    several more, each of a sample of its shingles; texts meet where one of
    these is the same, or where their whole fingerprints link. Meetings of a few
    are compared pair by pair; in larger ones each member is compared with the
    least and the greatest, and where this leaves several parts, all members of
    different parts with one another, in pairs of blocks of bounded size. What
    meets is verified on the whole texts.

    Equal texts are one text, and so are all without a word, null ones included. Of repeated rows one stays, and a null key is less
    than any other. An empty table gives an empty result.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    ids = F.col(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, samples = [], []
            for t in batch.column(2).to_pylist():
                hashes = np.concatenate([*shingle_hashes(t, shingle), np.zeros(0, np.uint64)])
                prints.append(vote(iter([hashes])))
                samples.append(np.array(sampled(hashes), np.uint64).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(samples, pa.list_(pa.int64()))], names=["k", "digest", "fp", "samples"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(ids.alias("k"), digest.alias("digest"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, digest string, fp long, samples array<long>")
    order = F.struct(F.col("k").isNotNull(), "k")
    reps = materialise(rows.groupBy("digest").agg(F.min(order).alias("o"), F.first("fp").alias("fp"), F.first("samples").alias("samples")).select("digest", F.col("o.k").alias("k"), "fp", "samples").withColumn("rep", F.monotonically_increasing_id()), "reps")

    # Whole fingerprints that link, and the texts of each fingerprint with the least of them.
    classes = reps.groupBy("fp").agg(F.min("rep").alias("least"))
    own = reps.join(classes, "fp").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    linked = links(classes.select("fp"))
    name = lambda c, out: classes.select(F.col("fp").alias(c), F.col("least").alias(out))
    across = linked.join(name("u", "a"), "u").join(name("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Samples that are the same.
    each = reps.select("rep", F.posexplode("samples").alias("slot", "sample"))
    total = SAMPLES * reps.count()
    met = each.groupBy("slot", "sample").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("n > 1")
    joined = materialise(_with_groups(each, met.where("n > 2"), total), "met")
    two = met.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    crowds = joined.where(F.col("n") > CROWD)
    stars = crowds.select(F.col("rep").alias("u"), F.explode(F.array("lo", "hi")).alias("v"))
    tidy = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(tidy(own.unionByName(across).unionByName(two).unionByName(_pairs(joined.where(F.col("n") <= CROWD), "slot", "sample")).unionByName(stars)), "candidates")

    involved = edges.select(F.explode(F.array("u", "v")).alias("rep")).distinct().join(reps.select("rep", "digest", F.col("k").alias("__k")), "rep")
    source = df.select(ids.alias("k"), digest.alias("digest"), F.col(text).alias("t"))
    texts = materialise(source.join(involved, (source["digest"] == involved["digest"]) & source["k"].eqNullSafe(involved["__k"])).select("rep", "t").dropDuplicates(["rep"]), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            good = [_similar(x, y, shingle, similarity) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(u, good) if g], pa.int64()), pa.array([x for x, g in zip(v, good) if g], pa.int64())], names=["u", "v"])

    def verified(e: DataFrame) -> DataFrame:
        beside = lambda c, out: texts.select(F.col("rep").alias(c), F.col("t").alias(out))
        return e.join(beside("u", "a"), "u").join(beside("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")

    sure = materialise(verified(edges), "verified")
    reached = connected_components(sure)
    # In crowds that this leaves in several parts, members of different parts are compared, block by block.
    parts = reached.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    members = crowds.select("slot", "sample", "rep").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    seen = members.groupBy("slot", "sample").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("all"))
    apart = seen.where("p <> q").dropDuplicates(["n", "lo", "hi", "all"]).select("slot", "sample", "n")  # the same members need one comparison
    open_ = materialise(_with_groups(members, apart, total).select("slot", "sample", "rep", "part"), "open")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([*shingle_hashes(t, shingle), np.zeros(0, np.uint64)])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["rep", "size", "grams"])

    grams = materialise(texts.join(open_.select("rep").distinct(), "rep", "left_semi").select("rep", "t").mapInArrow(sets, "rep long, size long, grams binary"), "grams")
    sizes = open_.join(grams.select("rep", "size"), "rep").groupBy("slot", "sample").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS))).cast("int").alias("blocks"))
    dealt = _with_groups(open_, sizes, total).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    compared = dealt.join(grams, "rep").select("slot", "sample", "i", "j", "rep", "part", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"), "grams")

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        found = [np.frombuffer(x, np.uint64) for x in block["grams"].to_pylist()]
        left, right = (np.flatnonzero(np.array(block[c].to_pylist(), bool)) for c in ("left", "right"))
        rep = block["rep"].to_numpy()
        u, v = block_links(found, block["part"].to_numpy(), left, right, similarity)
        return pa.table({"u": pa.array(rep[u], pa.int64()), "v": pa.array(rep[v], pa.int64())})

    more = materialise(compared.groupBy("slot", "sample", "i", "j").applyInArrow(compare, "u long, v long"), "verified")
    if not more.isEmpty():
        reached = connected_components(sure.unionByName(more))
    for done in (joined, edges, texts, sure, open_, grams, more):
        release(done)
    named = reps.join(reached, reps["rep"] == reached["node"], "left").select("digest", "k", F.coalesce("component", "rep").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("k").isNotNull(), "k", "digest")).alias("o")).select(F.col("o.k").alias("__k"), F.col("o.digest").alias("__digest"))
    marked = df.withColumn("__own", digest)
    return marked.join(kept, (marked["__own"] == kept["__digest"]) & marked[key].eqNullSafe(kept["__k"]), "left_semi").dropDuplicates([key, "__own"]).drop("__own")


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
