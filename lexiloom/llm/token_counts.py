"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE vocabulary
without producing a token:

* The splitter reads code point classes and marks where pretokens start. It has
  twelve states, so the text of a batch, whatever documents it holds, is cut
  into equal chunks, each chunk becomes a map from entry state to end state, and
  a parallel prefix scan over these maps gives every chunk its entry state.
* The merger reads the UTF-8 bytes of a pretoken. A state is the longest suffix
  that still begins some token, with the last token and the relative token count
  at every position of it at which a later token may start. This is finite and
  all that byte-pair merging can depend on: the last token of a prefix is the
  only candidate that forms a stable pair with the last token before it. Every
  transition carries the change of the token count. States are compiled when
  first reached and kept by the Python worker; beyond MAX_STATES all but those
  in use are forgotten, also in the middle of a batch.

Pretokens pass the merger side by side, one numpy step per byte position. Long
ones are cut into equal chunks that pass it side by side as well: a chunk's map
takes an entry state to its end state and the tokens counted on the way, for the
entry states that may occur (what a short run-up gives, then the end states of
the chunk before, until the true ones are among them). The maps compose by a
prefix scan, counts adding up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches, beside

# White space of the pattern's \s, and the contractions' letters.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SINGLE, DOUBLE = "stmd", {"r": "e", "v": "e", "l": "l"}

LETTER, ONE, R, V, LL, E, NUMBER, SPACE, OTHER_WHITE, QUOTE, SIGN, END = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_SIGNS, AT_QUOTE, AFTER_R, AFTER_V, AFTER_L, SPACE1, WHITE1, SPACES, WHITES = range(12)
HERE, BEFORE = 1, 2  # what a transition marks: a pretoken starts at this code point, or at the one before

CHUNK, PROBE = 512, 24
MAX_STATES, MAX_LIVE = 200_000, 250_000
LANES = 1 << 16  # pretokens or chunks that pass the merger side by side
STRIDE, RUN_UP, GUESSES = 512, 128, 4  # bytes of a long pretoken's chunk and of the run-up to it; rounds in which all chunks' end states are followed


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, indexed by state * 12 + class."""
    letters = {LETTER, ONE, R, V, LL, E}
    begin = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, QUOTE: AT_QUOTE, SPACE: SPACE1, OTHER_WHITE: WHITE1, END: START}
    joins = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, QUOTE: IN_SIGNS}
    go, mark = np.zeros((12, 12), np.int64), np.zeros((12, 12), np.int8)
    completes = {AFTER_R: E, AFTER_V: E, AFTER_L: LL}
    for c in range(12):
        def put(state, to, what, c=c):
            go[state, c], mark[state, c] = to, what

        white = c in (SPACE, OTHER_WHITE)
        for state in range(12):
            put(state, begin[c], HERE)
        for state, same in ((IN_LETTERS, letters), (IN_NUMBERS, {NUMBER}), (IN_SIGNS, {SIGN, QUOTE})):
            if c in same:
                put(state, state, 0)
        if c == ONE:
            put(AT_QUOTE, START, 0)
        elif c in (R, V, LL):
            put(AT_QUOTE, {R: AFTER_R, V: AFTER_V, LL: AFTER_L}[c], 0)
        elif c in (SIGN, QUOTE):
            put(AT_QUOTE, IN_SIGNS, 0)
        for state, last in completes.items():
            if c == last:
                put(state, START, 0)
            elif c in letters:
                put(state, IN_LETTERS, BEFORE)
            else:
                put(state, begin[c], BEFORE | HERE)
        for state in (SPACE1, WHITE1, SPACES, WHITES):
            if white:
                put(state, SPACES if c == SPACE else WHITES, 0)
        if c in joins:
            put(SPACE1, joins[c], 0)
            put(SPACES, joins[c], BEFORE)
            put(WHITES, begin[c], BEFORE | HERE)
    return go.ravel(), mark.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, SIGN, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = OTHER_WHITE
    out[32], out[39] = SPACE, QUOTE
    for ch in SINGLE:
        out[ord(ch)] = ONE
    for ch, c in (("r", R), ("v", V), ("l", LL), ("e", E)):
        out[ord(ch)] = c
    return out


GO, MARK = _splitter()


def chunk_maps(lanes: np.ndarray) -> np.ndarray:
    """Of each chunk (a column of classes), the end state for every entry state."""
    steps, n = lanes.shape
    state = np.repeat(np.arange(12)[:, None], n, 1)
    for k in range(min(PROBE, steps)):
        state = GO[state * 12 + lanes[k]]
    if steps <= PROBE:
        return state.T
    open_ = (state != state[0]).any(0)
    one = state[0]
    for k in range(PROBE, steps):
        one = GO[one * 12 + lanes[k]]
    out = np.repeat(one[:, None], 12, 1)
    if open_.any():
        state, rest = state[:, open_], lanes[:, open_]
        for k in range(PROBE, steps):
            state = GO[state * 12 + rest[k]]
        out[open_] = state.T
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Entry state of each chunk: prefix compositions of all maps before it, by doubling."""
    total, gap = maps.copy(), 1
    while gap < len(total):
        after = total.copy()
        after[gap:] = np.take_along_axis(total[gap:], total[:-gap], 1)
        total, gap = after, gap * 2
    return np.concatenate([[START], total[:-1, START]])


def split_marks(classes: np.ndarray) -> np.ndarray:
    """Whether a pretoken starts at each place. END places hold none."""
    n = len(classes)
    k = -(-n // CHUNK)
    lanes = np.full(k * CHUNK, END, np.int64)
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(k, CHUNK).T)
    state = scan_maps(chunk_maps(lanes))
    marks = np.empty(lanes.shape, np.int8)
    for i in range(CHUNK):
        at = state * 12 + lanes[i]
        marks[i] = MARK[at]
        state = GO[at]
    marks = marks.T.ravel()[:n]
    out = (marks & HERE).astype(bool)
    out[:-1] |= (marks[1:] & BEFORE).astype(bool)
    out[classes == END] = False
    return out


def byte_letters() -> dict[str, int]:
    """The vocabulary's printable letter of each byte, by the rule of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The transducer over the bytes of one pretoken, compiled as it is used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Numbers follow the order of merging: bytes first, then each merge's result.
        self.id = {bytes([b]): b for b in range(256)}
        self.halves, self.joined = [(b, b) for b in range(256)], {}
        for a, b in ((as_bytes(a), as_bytes(b)) for a, b in merges):
            pair = self.id[a], self.id[b]
            self.joined[pair] = self.id.setdefault(a + b, len(self.halves))
            if self.joined[pair] == len(self.halves):
                self.halves.append(pair)
        self.id = {t: i for t, i in self.id.items() if i < 256 or self.stable(*self.halves[i], own=True)}
        self.longer: dict[bytes, list[int]] = {}
        for t, i in self.id.items():
            for n in range(len(t)):
                self.longer.setdefault(t[:n], []).append(i)
        self.live: dict[tuple[int, bytes], bool] = {}
        self.reset()

    def stable(self, a: int, b: int, own: bool = False) -> bool:
        """Whether merging a's and b's bytes gives these two tokens (own: but for the merge of both at last).

        Undoes the merges of the two sides, the latest first, and looks each
        time whether a merge across their border would have come before.
        """
        limit = self.joined[a, b] if own else 1 << 30
        if not own and (a, b) in self.joined:
            return False
        while a >= 256 or b >= 256:
            if a > b:
                limit, a = min(limit, a), self.halves[a][1]
                if self.joined.get((a, b), 1 << 30) < limit:
                    return False
            else:
                limit, b = min(limit, b + 1), self.halves[b][0]
                if self.joined.get((a, b), 1 << 30) < limit:
                    return False
        return True

    def alive(self, last: int | None, prefix: bytes) -> bool:
        """Whether a token that goes on from ``prefix`` may follow ``last``."""
        if (more := self.longer.get(prefix)) is None:
            return False
        if last is None:
            return True
        if (found := self.live.get((last, prefix))) is None:
            if len(self.live) > MAX_LIVE:
                self.live.clear()
            found = self.live[last, prefix] = any(self.stable(last, t) for t in more)
        return found

    def reset(self) -> None:
        # A state: its window, and of each place in it where a token may start: offset, last token, count relative to the end.
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.width = 64
        self.keep([])

    def keep(self, states: list[tuple]) -> None:
        """Forget all states but the first and these, which get the numbers that follow."""
        first = (b"", ((0, None, 0),))
        self.states = list(dict.fromkeys([first, *states]))
        self.number = {state: i for i, state in enumerate(self.states)}
        size = max(1024, len(self.states))
        self.to, self.change = np.full((size, self.width), -1, np.int32), np.zeros((size, self.width), np.int8)

    def renew(self, live: np.ndarray) -> np.ndarray:
        """Forget all states but the ``live`` ones; their new numbers."""
        used, back = np.unique(live, return_inverse=True)
        kept = [self.states[i] for i in used.tolist()]
        self.keep(kept)
        return np.array([self.number[state] for state in kept], np.int64)[back]

    def number_of(self, state: tuple) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.to):
                more = max(1024, n // 4)
                self.to = np.concatenate([self.to, np.full((more, self.width), -1, np.int32)])
                self.change = np.concatenate([self.change, np.zeros((more, self.width), np.int8)])
        return n

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """Column numbers of the bytes; bytes not met before get the next ones."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = self.columns
            self.columns += 1
            if self.columns > self.width:
                self.width += 32
                self.to = np.concatenate([self.to, np.full_like(self.to[:, :32], -1)], 1)
                self.change = np.concatenate([self.change, np.zeros_like(self.change[:, :32])], 1)
        self.byte = np.argsort(np.where(self.column < 0, 1 << 30, self.column), kind="stable").tolist()
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        window, places = self.states[state]
        text = window + bytes([self.byte[column]])
        for at, last, count in places:
            token = self.id.get(text[at:])
            if token is not None and (last is None or self.stable(last, token)):
                break
        else:
            raise AssertionError("a byte sequence has no stable segmentation")
        change = count + 1
        kept = [(a, t, c - change) for a, t, c in (*places, (len(text), token, change)) if self.alive(t, text[a:])]
        cut = kept[0][0]
        after = (text[cut:], tuple((a - cut, t, c) for a, t, c in kept))
        n = self.number_of(after)
        self.to[state, column], self.change[state, column] = n, change

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and token count of each range of columns, from its entry state."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], entry[order]
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
        total = np.zeros(len(lengths), np.int64)
        for k, n in enumerate(alive):
            if len(self.states) > MAX_STATES:
                state = self.renew(state)
            byte = data[starts[:n] + k]
            here = state[:n]
            after = self.to[here, byte]
            missing = np.flatnonzero(after < 0)
            if len(missing):
                for pair in np.unique(here[missing] * 256 + byte[missing]).tolist():
                    self.compile(*divmod(pair, 256))
                after = self.to[here, byte]
            total[:n] += self.change[here, byte]
            state[:n] = after
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def maps(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: list[tuple]) -> list[tuple[tuple, int]]:
        """End state, as it is and not as a number, and token count of each chunk from its entry state."""
        out: list[tuple[tuple, int]] = []
        for k in range(0, len(starts), LANES):
            entry = np.array([self.number_of(e) for e in entries[k : k + LANES]], np.int64)
            state, total = self.run(data, starts[k : k + LANES], lengths[k : k + LANES], entry)
            out += zip([self.states[i] for i in state.tolist()], total.tolist())
        return out

    def scan(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of long ranges of columns, by their chunks' maps."""
        chunks = -(-lengths // STRIDE)
        heads = np.cumsum(chunks) - chunks
        owner = np.repeat(np.arange(len(starts)), chunks)
        inside = (np.arange(len(owner)) - heads[owner]) * STRIDE
        begin, size = starts[owner] + inside, np.minimum(STRIDE, lengths[owner] - inside)
        last = np.zeros(len(owner), bool)
        last[heads + chunks - 1] = True
        run_up = np.minimum(RUN_UP, inside)
        fresh = [self.states[0]] * len(owner)
        guess = [state for state, _ in self.maps(data, begin - run_up, run_up, fresh)]
        # An item is a chunk with an entry state; what it leads to is the next chunk with the end state.
        item: dict[tuple[int, tuple], int] = {}
        leads: list[tuple[int, tuple] | None] = []
        count: list[int] = []
        wanted, rounds = list(enumerate(guess)), 0
        truth = [(h, self.states[0]) for h in heads.tolist()]  # how far the true states are known
        while wanted:
            at = np.array([c for c, _ in wanted])
            for (c, entry), (end, n) in zip(wanted, self.maps(data, begin[at], size[at], [e for _, e in wanted])):
                item[c, entry] = len(leads)
                leads.append(None if last[c] else (c + 1, end))
                count.append(n)
            for i, now in enumerate(truth):
                while now is not None and now in item:
                    now = leads[item[now]]
                truth[i] = now
            rounds += 1
            if not (open_ := [now for now in truth if now is not None]):
                break
            wanted = list(dict.fromkeys(x for x in leads if x is not None and x not in item)) if rounds < GUESSES else open_
        # Prefix scan: each item's count up to the end of its pretoken, in steps that double.
        there = np.array([len(leads) if x is None else item.get(x, len(leads)) for x in leads] + [len(leads)])
        total = np.array([*count, 0], np.int64)
        while (there < len(leads)).any():
            total, there = total + total[there], there[there]
        return total[[item[h, self.states[0]] for h in heads.tolist()]]

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of the byte ranges."""
        data = self.columns_of(data)
        out = np.zeros(len(starts), np.int64)
        long = np.flatnonzero(lengths > 2 * STRIDE)
        if len(long):
            out[long] = self.scan(data, starts[long], lengths[long])
        short = np.flatnonzero(lengths <= 2 * STRIDE)
        short = short[np.argsort(-lengths[short], kind="stable")]
        for k in range(0, len(short), LANES):
            some = short[k : k + LANES]
            out[some] = self.run(data, starts[some], lengths[some], np.zeros(len(some), np.int64))[1]
        return out


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, special strings counting as one token each."""
    machine = merger(path)
    parts: list[str] = []
    owner: list[int] = []
    extra = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        for special in machine.special:
            pieces = [p for piece in pieces for p in piece.split(special)]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    if not parts:
        return extra
    joined = "\0".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes()[points]
    ends = np.cumsum([len(p) + 1 for p in parts])
    classes[ends[:-1] - 1] = END
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(points):
        return extra
    marks = np.flatnonzero(split_marks(classes))
    if not len(marks):
        return extra
    stops = np.concatenate([marks[1:], [len(points)]])
    part = np.searchsorted(ends, marks, side="right")
    stops = np.minimum(stops, np.concatenate([ends[:-1] - 1, [len(points)]])[part])
    counts = machine.count(data, at[marks], at[stops] - at[marks])
    return extra + np.bincount(np.asarray(owner)[part], counts, len(texts)).astype(np.int64)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty, an empty one has 0 tokens, repeated rows are
    each counted, and an empty table gives an empty result. Other columns of
    the table are not read. ``tokenizer`` is the path of a byte-level BPE file.
    """
    arrow_batches(df.sparkSession)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(beside(keep)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(batch.column(len(keep)).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.compute.binary_length(batch.column(len(keep))).cast(pa.int64()), pa.array(counts)], names=[*keep, "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["n_bytes long", "n_tokens long"])
    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
