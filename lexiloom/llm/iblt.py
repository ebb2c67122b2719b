"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (its lines that are not empty, each counted once) have 64-bit
digests. A cell keeps the number of its digests, their XOR and the XOR of their
checks; a leaf is three rows of cells, in each of which a digest falls into one.
The digests' first bits deal them to leaves, as many (a power of two) as the
number of paragraphs asks for, and the places in a leaf are read off other bits,
shifted by the leaf's own number: the first with which the leaf opens by peeling
(a cell with one digest, which check and place confirm, gives that digest, and
taking it out of its other cells leaves more such cells). Where a leaf opens with
none, the text gets four times as many leaves. So a fingerprint follows from its
text alone, and opens.

Likeness follows from two fingerprints alone. Leaves of the larger one fold (cells
add up) to the number of the smaller one, sketches subtract cell by cell, common
paragraphs cancel, and peeling recovers the digests of the others, with the side
they are on. Where that gets stuck, both sides' leaves are opened, dealt to as
many leaves as both ask for together, subtracted and peeled again, then to four
times as many, and so on.

All of it is SQL expressions over columns; dealing halves a list once for each
bit, so the work grows with n log n of a text's paragraphs. The order of documents
is found over ids and lengths alone. Texts are shuffled once, and of each next
document only as many characters as its predecessor takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.plans.materialise import materialise

CELLS = 8  # in each of three rows
SHARE = 3.0  # paragraphs of a leaf
SHIFTS = 10
GROWTHS = 6  # each of four times as many leaves
ROUNDS = 24
DEEPEST = 28  # the bits that deal to leaves are others than those of the places

_CELL = "struct<n:int,k:bigint,c:int>"
_LEAF = f"struct<r:int,cells:array<{_CELL}>>"
_ZERO = "named_struct('n', 0, 'k', 0L, 'c', 0)"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def first_of(tries: int, name: str, kind: str, body: str) -> str:
    """The first that is not null of ``body`` with ``name`` = 0, 1, .."""
    return f"aggregate(sequence(0, {tries - 1}), cast(null as {kind}), (done, {name}) -> if(done is not null, done, {body}))"


def units(text: str) -> str:
    """Digests of the paragraphs of a text."""
    return rf"array_distinct(transform(filter(split({text}, '\n'), p -> p <> ''), p -> xxhash64(p)))"


def depth_of(n: str) -> str:
    """The bits that deal ``n`` digests to leaves."""
    return f"least({DEEPEST}, cast(ceil(log2(greatest(1.0D, {n} / {SHARE}D))) as int))"


def dealt(digests: str, start: str, depth: str) -> str:
    """The digests by leaf, in the order of the ``depth`` bits after the first ``start``."""
    bit = f"(shiftrightunsigned(u, 64 - {start} - l) & 1L)"
    return f"aggregate(slice(sequence(0, {depth}), 2, 64), array({digests}), (ps, l) -> flatten(transform(ps, p -> array(filter(p, u -> {bit} = 0L), filter(p, u -> {bit} = 1L)))))"


def _place(digest: str, row: str, shift: str) -> str:
    return f"(shiftrightunsigned({digest}, 12 * {row} + {shift}) & {CELLS - 1}L)"


def sketch(digests: str, shift: str) -> str:
    """Cells of three rows, one row after another."""
    return f"""flatten(transform(array(0, 1, 2), j -> transform(sequence(0, {CELLS - 1}), i -> aggregate(
        filter({digests}, u -> {_place('u', 'j', shift)} = i), {_ZERO}, (s, u) -> named_struct('n', s.n + 1, 'k', s.k ^ u, 'c', s.c ^ hash(u))))))"""


def difference(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def folded(leaves: str) -> str:
    """The sum of leaves, cell by cell."""
    return f"aggregate({leaves}, array_repeat({_ZERO}, {3 * CELLS}), (acc, leaf) -> zip_with(acc, leaf.cells, (x, y) -> named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c)))"


def peel(cells: str, shift: str) -> str:
    """The digests on one side only, as structs of digest k and side n; null if peeling gets stuck."""
    pure = f"array_distinct(transform(filter(s.cells, (x, i) -> abs(x.n) = 1 and hash(x.k) = x.c and {_place('x.k', f'cast(i div {CELLS} as int)', shift)} = i % {CELLS}), x -> named_struct('k', x.k, 'n', x.n)))"
    without = f"""transform(s.cells, (x, i) -> aggregate(filter(p, q -> {_place('q.k', f'cast(i div {CELLS} as int)', shift)} = i % {CELLS}), x,
        (t, q) -> named_struct('n', t.n - q.n, 'k', t.k ^ q.k, 'c', t.c ^ hash(q.k))))"""
    step = let(pure, "p", f"if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'open', false), named_struct('cells', {without}, 'found', concat(s.found, p), 'open', true))")
    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<struct<k:bigint,n:int>>), 'open', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, round) -> if(s.open, {step}, s), s -> if(exists(s.cells, x -> x.n <> 0 or x.k <> 0), null, s.found))"


def fingerprint(digests: str) -> str:
    """Struct of the number of digests n, bits d and leaves (shift r and cells)."""
    leaf = first_of(SHIFTS, "r", _LEAF, let(sketch("own", "r"), "c", f"if({peel('c', 'r')} is null, null, named_struct('r', r, 'cells', c))"))
    leaves = f"transform({dealt('all', '0', 'd')}, own -> {leaf})"
    kind = f"struct<n:int,d:int,leaves:array<{_LEAF}>>"
    attempt = let(f"least({DEEPEST}, {depth_of('size(all)')} + 2 * growth)", "d", let(leaves, "found", f"if(exists(found, x -> x is null) and growth < {GROWTHS - 1}, null, named_struct('n', size(all), 'd', d, 'leaves', found))"))
    return let(digests, "all", first_of(GROWTHS, "growth", kind, attempt))


def differing(left: str, right: str) -> str:
    """Digests that are in one of two fingerprints only (k), and in which: n is 1 or -1."""
    kind = "array<struct<k:bigint,n:int>>"
    width = "cast(power(2, x.d - g) as int)"
    own = lambda leaves: f"flatten(transform({leaves}, leaf -> transform({peel('leaf.cells', 'leaf.r')}, q -> q.k)))"
    one = first_of(SHIFTS, "r", kind, peel(difference(sketch("p", "r"), sketch("q", "r")), "r"))
    again = let(f"least({DEEPEST} - g, {depth_of('(size(a) + size(b))')} + 2 * growth)", "d", let(f"zip_with({dealt('a', 'g', 'd')}, {dealt('b', 'g', 'd')}, (p, q) -> {one})", "found", "if(exists(found, f -> f is null), null, flatten(found))"))
    larger = let(own("la"), "a", let(own("lb"), "b", first_of(GROWTHS, "growth", kind, again)))
    plain = "not exists(la, leaf -> leaf.r <> 0) and not exists(lb, leaf -> leaf.r <> 0)"
    part = lambda x: f"slice({x}.leaves, at * {width.replace('x.', x + '.')} + 1, {width.replace('x.', x + '.')})"
    each = let(part("x"), "la", let(part("y"), "lb", let(f"if({plain}, {peel(difference(folded('la'), folded('lb')), '0')}, null)", "quick", f"if(quick is not null, quick, {larger})")))
    return let(left, "x", let(right, "y", let("least(x.d, y.d)", "g", f"flatten(transform(sequence(0, cast(power(2, g) as int) - 1), at -> {each}))")))


def likeness(left: str, right: str, differ: str) -> str:
    """Paragraphs in common over all paragraphs; two texts without any are alike. What does not open counts as different."""
    both = f"({left}.n + {right}.n)"
    return f"if({both} = 0, 1.0D, coalesce(({both} - size({differ})) / cast({both} + size({differ}) as double), 0.0D))"


def written(print_: str) -> str:
    """A fingerprint as text: number of paragraphs, bits, and the leaves; of each its shift and cells (count, digest and check in hexadecimal)."""
    cell = "if(x.n = 0, '', concat(lower(hex(x.n)), lpad(lower(hex(x.k)), 16, '0'), lpad(lower(right(hex(x.c), 8)), 8, '0')))"
    return f"concat({print_}.n, ':', {print_}.d, ':', concat_ws('|', transform({print_}.leaves, leaf -> concat(leaf.r, '/', concat_ws('.', transform(leaf.cells, x -> {cell}))))))"


def neighbours(df: DataFrame) -> DataFrame:
    """Of each distinct __key: the next one (after the last, the first) and the one before, with what that one takes and the least __hash.

    Keys are dealt to ranges; within a range a window gives neighbours, and the
    ranges' ends, one row a range, give those across.
    """
    key = "__key"
    each = df.groupBy(key).agg(F.max("__n").alias("n"), F.min("__hash").alias("least"))
    ranged = materialise(each.repartitionByRange(F.col(key)).withColumn("block", F.spark_partition_id()), "order")
    w = W.partitionBy("block").orderBy(key)
    inside = ranged.withColumn("before", F.lag(F.struct(key, "n")).over(w))
    over = W.orderBy("block")
    ends = ranged.groupBy("block").agg(F.max_by(F.struct(key, "n"), key).alias("last"))
    everything = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    across = ends.select("block", F.coalesce(F.lag("last").over(over), F.last("last").over(everything)).alias("from"))
    found = inside.join(across, "block").select(key, "least", F.coalesce("before", "from").alias("b"))
    return found.select(key, F.col("least").alias("__least"), F.col(f"b.{key}").alias("__before"), F.floor(F.col("b.n") / 2).cast("int").alias("__take"))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited version, and how alike they and the next text's are.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many of the next document by ascending ``key``. ``removed`` and ``added``
    are the digests that peeling recovers on either side of the edit. Null texts
    count as empty. A null key comes before all others; keys may be of any type
    that has an order. Rows that share a key share the next document, the one of
    the next key; of several rows with that key, that with the least hash of its
    text. Texts without a paragraph have a leaf of empty cells and are alike. A
    table of one row follows itself; an empty table gives an empty result, and
    other columns are not read.
    """
    id_ = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("id"))
    rows = df.select(id_.alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    order = materialise(neighbours(rows.select("__key", F.length("__text").alias("__n"), F.xxhash64("__text").alias("__hash"))), "neighbours")
    # What a document sends to the one before; equal rows are combined before they are shuffled. The hash is no
    # condition of the join, so that both joins of the texts share one shuffle.
    message = F.struct(F.expr("substring(__text, 1, __take)").alias("__head"), F.expr(units("__text")).alias("__c"))
    linked = rows.join(order, "__key").select(F.col("__before").alias("__key"), F.when(F.xxhash64("__text") == F.col("__least"), message).alias("__sent"))
    sent = linked.groupBy("__key").agg(F.first("__sent", ignorenulls=True).alias("__next")).select("__key", "__next.*")
    both = rows.join(sent, "__key").withColumn("__n", F.length("__text"))
    both = both.withColumn("__edited", F.expr("concat(substring(__text, 1, __n - __n div 2), substring(__head, 1, cast(__n div 2 as int)))"))
    both = both.select("__key", "__n", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), F.expr(units("__text")).alias("__a"), F.expr(units("__edited")).alias("__b"), "__c")
    both = both.withColumns({f"__f{x}": F.expr(fingerprint(f"__{x}")) for x in "abc"}).drop("__a", "__b", "__c")
    both = both.withColumns({f"__d{x}": F.expr(differing("__fa", f"__f{x}")) for x in "bc"})
    return both.select(
        F.col("__key.id").alias(key),
        F.col("__n").cast("long").alias("n_chars"),
        "edited_sha256",
        F.expr(written("__fa")).alias("fingerprint"),
        F.expr(written("__fb")).alias("edited_fingerprint"),
        F.expr(likeness("__fa", "__fb", "__db")).alias("near_edited"),
        F.expr(likeness("__fa", "__fc", "__dc")).alias("near_next"),
        F.expr("transform(filter(__db, q -> q.n = 1), q -> q.k)").alias("removed"),
        F.expr("transform(filter(__db, q -> q.n = -1), q -> q.k)").alias("added"),
    )
