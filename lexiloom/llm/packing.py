"""Mixture-controlled packing by deficit round-robin.

Every source has a queue of its documents, in the order of a hash. A round gives
each source credit for its share of a window of tokens; a source sends the whole
tokens that its credit covers, cutting a document where the credit ends, and
carries what is left of a token, its deficit, to the next round. So a token is
sent in the round in which the credit given so far covers it, and a document's
piece of a round is where the document's interval of the queue meets the round's
interval of credit: both follow from the queue's running total alone, rounds
need not be played one after another, and deficits carry across windows and
partitions by construction. Pieces in the order of rounds, cut where a window is
full, fill every window but the last.

Running totals are taken in two levels: rows fall into blocks (of the hash, then
of rounds), blocks' sums are added up, and each block counts on from there.
Blocks grow in number with the rows, a block's rows are about as many whatever
the sources' sizes, and only ids and counts take part; token ids are written once
and meet their places by one join.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches
from lexiloom.llm.token_counts import byte_letters
from lexiloom.plans.materialise import materialise

WINDOW = 4096
END_ID = 2
# The pattern of the vocabulary file's splitter.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[^\0-ɏ]")
NO_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, signs to the pattern
MAX_WORDS, LONGEST = 400_000, 48
SIGNS = ".,;:!?"
LITTLE = [struct.Struct(f"<{n}H").pack for n in range(32)]
PART = 1 << 20
PER_BLOCK, LEAST_BLOCKS = 50_000, 256  # rows of a block of the hash; blocks of small tables


def simple(text: str) -> bool:
    """Whether all characters lie below U+0250, which is known at once for texts in Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not PLAIN.search(text)


class Recent(dict):
    """A bounded table: when it holds MAX_WORDS entries these become the elder ones, of which those in use come back."""

    def __init__(self):
        super().__init__()
        self.elder: dict[str, bytes] = {}

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        if (ids := self.elder.get(key)) is None:
            ids = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MAX_WORDS:
                self.elder = dict(self)
                self.clear()
            self[key] = ids
        return ids


class RunTable(Recent):
    """Text between white space -> the ids of its words, which never reach across white space."""

    def __init__(self, words: WordTable):
        super().__init__()
        self.words = words

    def make(self, run: str) -> bytes:
        # Letters alone are one word, and one sign after them is another.
        if run.isalpha():
            return self.words.make(run)
        if run[-1] in SIGNS and run[:-1].isalpha():
            return self[run[:-1]] + self[run[-1]] if len(run) > 1 else self.words.make(run)
        return b"".join([self.words[w] for w in SPLIT.findall(run)])


class WordTable(Recent):
    """word -> its ids as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.runs = RunTable(self)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.merges = self.library.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.check()

    def check(self) -> None:
        """This file splits as SPLIT says; another one would be counted wrongly."""
        probe = "It's WE'LL o're 12,345.6 a_b x\u00a0y ñandú's日本 --!? \t\n (ab)cd' 'd"
        if self.library.encode(probe, add_special_tokens=False).ids != np.frombuffer(self.plain(probe), "<u2").tolist():
            raise ValueError("this tokenizer splits texts by another pattern")

    def make(self, word: str) -> bytes:
        """A word of normal text needs the library's merges alone, on its bytes' letters."""
        # Letters of ASCII stand for their own bytes.
        letters = word if word.isascii() and word.isalpha() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.merges.tokenize(letters)]
        return LITTLE[len(ids)](*ids) if len(ids) < len(LITTLE) else np.array(ids, "<u2").tobytes()

    def raw(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings. Its normal form is the library's; where that only lower-cases, str does it."""
        low = text.lower() if simple(text) else self.library.normalizer.normalize_str(text)
        if len(low) <= PART and not any(c in low for c in NO_SPACE):
            runs = low.split()
            return b"".join(itemgetter(*runs)(self.runs)) if len(runs) > 1 else b"".join(map(self.runs.__getitem__, runs))
        return b"".join(self[m[0]] for m in SPLIT.finditer(low))

    def ids(self, text: str) -> bytes:
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.plain(text)
        return b"".join(self.raw(p) if i % 2 else self.plain(p) for i, p in enumerate(self.special.split(text)) if p)


@lru_cache(2)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def tokenise(df: DataFrame, tokenizer: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n_ids and ids (binary, 16 bits each) of every row, the end id included."""
    arrow_batches(df.sparkSession)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for batch in batches:
            blobs = [table.ids(t) + end for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(b) // 2 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], names=[*keep, "n_ids", "ids"])

    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["n_ids long", "ids binary"]))


def running_total(rows: DataFrame, group: list[str], block: str, order: list[Column], amount: str, out: str) -> DataFrame:
    """Exclusive running total of ``amount`` within ``group``, by block first and then by ``order`` in the block."""
    sums = rows.groupBy(*group, block).agg(F.sum(amount).alias("__sum"))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*group, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(starts, [*group, block]).withColumn(out, F.col("__start") + F.col("__inside")).drop("__start", "__inside")


def schedule(rows: DataFrame, window: int = WINDOW, shares: dict[str, float] | None = None) -> DataFrame:
    """Place the pieces of each row of (key, source, n_ids) in the packed order.

    Gives key, source, at (of the piece in its row), n_ids (of the piece), round
    and start, the tokens before it.

    ``key`` must be unique. ``shares`` are the target proportions by source; by
    default the sources' own token proportions, so that all queues end together.
    Sources without a share follow when the others' rounds are over, in their own
    token proportions.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    rows = rows.withColumn("source", source)
    totals = rows.groupBy("source").agg(F.sum("n_ids").alias("__tokens"), F.count("*").alias("__rows"))
    given = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("source")] if shares else F.lit(None).cast("double")
    totals = totals.withColumn("__given", F.when(given > 0, given * F.lit(float(window))))
    free = F.col("__given").isNull()
    n, rest, after = totals.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.sum(F.when(free, F.col("__tokens"))), F.lit(0)), F.coalesce(F.max(F.ceil(F.col("__tokens") / F.col("__given"))), F.lit(0))).first()
    rounds = int(after) + -(-int(rest) // window)
    # Credit covers whole tokens: by rounds, or token by token where a round has less than one.
    timed = totals.select("source", F.coalesce("__given", F.col("__tokens") * F.lit(float(window)) / F.lit(float(max(1, rest)))).alias("__credit"), F.when(free, F.lit(int(after))).otherwise(F.lit(0)).cast("long").alias("__after"))
    blocks = max(LEAST_BLOCKS, int(n) // PER_BLOCK)
    queued = running_total(rows.withColumn("__block", F.pmod(F.xxhash64("key"), F.lit(blocks))), ["source"], "__block", [F.xxhash64("key", F.lit(1)), F.col("key")], "n_ids", "__queue")
    timed = queued.join(timed, "source").withColumn("__end", F.col("__queue") + F.col("n_ids"))
    pieces = """case when __credit >= 1 then filter(transform(sequence(greatest(1L, cast(floor(__queue / __credit) as long)), cast(ceil(__end / __credit) as long) + 1),
            r -> struct(greatest(cast(floor((r - 1) * __credit + 1e-9) as long), __queue) - __queue as at,
                least(cast(floor(r * __credit + 1e-9) as long), __end) - greatest(cast(floor((r - 1) * __credit + 1e-9) as long), __queue) as n, r as round)), p -> p.n > 0)
        else transform(sequence(0L, n_ids - 1), k -> struct(k as at, 1L as n, cast(ceil((__queue + k + 1) / __credit - 1e-9) as long) as round)) end"""
    timed = timed.withColumn("p", F.explode(F.expr(pieces))).select("key", "source", (F.col("__queue") + F.col("p.at")).alias("__queue"), "p.at", F.col("p.n").alias("n_ids"), (F.col("__after") + F.col("p.round")).alias("round"))
    # As many blocks of rounds as rounds in a block, so that neither grows faster than the root of their number.
    timed = timed.withColumn("__block", F.floor((F.col("round") - 1) / F.lit(max(1, math.isqrt(rounds)))).cast("long"))
    placed = running_total(timed.withColumn("__all", F.lit(0)), ["__all"], "__block", [F.col("round"), F.col("source"), F.col("__queue"), F.col("key")], "n_ids", "start")
    return placed.select("key", "source", "at", "n_ids", "round", "start")


def pack(df: DataFrame, tokenizer: str, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, shares: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also the ids.

    A null or empty text is the end id alone; a null source is a queue of its
    own name, the empty one. Repeated rows and repeated ids are packed each, an
    empty table gives an empty result, and other columns of the table are not
    read. Only the last sequence is shorter than ``window``; it needs padding
    unless its length is a power of two.
    """
    inner = [f"__keep{i}" for i in range(len(keep))]
    named = df.select(*[F.col(k).alias(n) for k, n in zip(keep, inner)], F.col(source).cast("string").alias("source"), F.col(text).alias("__t"))
    # The row number is unique and, once written, lasting.
    ids = materialise(tokenise(named, tokenizer, "__t", (*inner, "source")).withColumn("key", F.monotonically_increasing_id()), "ids")
    placed = schedule(ids.select("key", "source", "n_ids"), window, shares).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "n_ids", "start"))).alias("__places"))
    joined = ids.select("key", *inner, "n_ids", "ids").join(placed, "key").drop("key")
    k = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = np.asarray(batch.column(k)), batch.column(k + 2)
            doc, flat = np.repeat(np.arange(len(n)), np.diff(np.asarray(places.offsets))), places.flatten()
            base, size, start = (np.asarray(flat.field(f)) for f in ("at", "n_ids", "start"))
            # Pieces that follow one another are one.
            heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])])[: len(doc)])
            size = np.add.reduceat(size, heads) if len(heads) else size
            doc, base, start = doc[heads], base[heads], start[heads]
            first, last = start // window, (start + size - 1) // window
            pieces = last - first + 1
            part = np.repeat(np.arange(len(doc)), pieces)
            sequence = np.arange(len(part)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[part]
            begin = np.maximum(sequence * window, start[part])
            stop = np.minimum((sequence + 1) * window, (start + size)[part])
            row, at, length = doc[part], begin - start[part] + base[part], stop - begin
            blobs = [batch.column(k + 1)[i].as_py() for i in range(len(n))]
            wide = [np.frombuffer(blobs[i], "<u2")[a : a + m].astype("<u4") for i, a, m in zip(row.tolist(), at.tolist(), length.tolist())]
            columns = [c.take(pa.array(row)) for c in batch.columns[:k]]
            columns += [pa.array(x) for x in (at, length, np.array([zlib.crc32(w) for w in wide], np.int64), n[row], sequence, begin - sequence * window)]
            names = [*inner, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([w.astype(np.int32) for w in wide], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = [f"`{n}` {ids.schema[n].dataType.simpleString()}" for n in inner] + [f"`{n}` long" for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    out = joined.select(*inner, "n_ids", "ids", "__places").mapInArrow(cut, ", ".join(schema + ["ids array<int>"] * with_ids))
    return out.withColumnsRenamed(dict(zip(inner, keep)))
