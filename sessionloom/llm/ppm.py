"""Language-model scoring by prediction by partial matching (PPM, escape method C).

The byte-context trie is pretrained: Spark counts every six-byte string of the
training texts, and the counts of shorter contexts follow from them.  A
symbol's probability starts at the longest known context (five bytes at
most); an unseen symbol escapes to the next shorter one with probability
q / (T + q) for q different followers in T, and there the symbols already seen
above are excluded from both counts; below order zero the rest is uniform.
Every context counts, so the trie grows with the training part.  It is dealt
to slices by a hash of the last three bytes of context; only the counts of two
bytes of context (2^24 strings at most) go to all tasks.  Documents are taken
in batches: the different strings of a batch meet the counts in their slices,
and their code lengths come back to the batch.

Beside it stands the smoothed unigram word score.  Word counts are joined, not
broadcast: only words above a count that bounds their number go to the tasks,
all others meet their counts in a shuffle join.

Defined cases: a null text counts as empty (one end token, one end byte); a
null doc_id hashes as the empty text; repeated rows are scored each; an empty
training part leaves a uniform model; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import LOWER, crc_mod, stored, table, tune

#: Marks a document's start (ORDER times) and end; no UTF-8 text holds this byte.
EDGE = 0xFF
ORDER = 5
#: The end token of the word model: no word holds this byte.
END = b"\n"
#: Entries that a task holds before it passes them on.
FLUSH = 400_000
COUNTS = "word binary, gram long, n long"
#: Different strings of the training part in a slice, about; strings and bytes of text after which a batch of documents ends.
SLICE, BATCH, BATCH_BYTES = 1 << 15, 1 << 20, 12 << 20
#: Bytes of text whose strings are made at once, and strings that a slice answers at once.
CHUNK, ASKED = 1 << 20, 1 << 20
#: The slice of a document's own row: after all slices.
TEXT = (1 << 31) - 1
PACKS = "batch long, slice int, row long, doc_id long, held_out boolean, text binary, grams binary"


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with their edges in one array; which bytes are symbols (text and end); each text's number of them."""
    edge = bytes([EDGE])
    b = np.frombuffer(b"".join(edge * ORDER + t + edge for t in texts), dtype=np.uint8)
    n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    symbol = np.ones(len(b), dtype=bool)
    first = np.cumsum(n + ORDER) - (n + ORDER)
    for k in range(ORDER):
        symbol[first + k] = False
    return b, symbol, n


def grams(texts: list[bytes]) -> np.ndarray:
    """Strings of ORDER bytes of context and one symbol, as integers."""
    b, symbol, _ = joined(texts)
    w = b.astype(np.int64)
    g = w[ORDER:].copy()
    for k in range(1, ORDER + 1):
        g |= w[ORDER - k : len(w) - k] << (8 * k)
    return g[symbol[ORDER:]]


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, gram, n): words and byte strings, summed within the task."""
    words: Counter[bytes] = Counter()
    kept, counted = np.empty(0, np.int64), np.empty(0, np.int64)

    def word_rows() -> Iterator[pa.RecordBatch]:
        keys, n = list(words), list(words.values())
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array(n[k : k + 50_000], pa.int64())], ["word", "gram", "n"])
        words.clear()

    def gram_rows() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(kept), 100_000):
            part = kept[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counted[k : k + 100_000])], ["word", "gram", "n"])

    for b in batches:
        texts = [_lower(x) for x in b.column(0).to_pylist()]
        for t in texts:
            words.update(t.split())
            if len(words) > FLUSH:
                yield from word_rows()
        words[END] += len(texts)
        for k in range(0, len(texts), 1000):
            u, c = np.unique(grams(texts[k : k + 1000]), return_counts=True)
            kept, place = np.unique(np.concatenate([kept, u]), return_inverse=True)
            counted = np.bincount(place, np.concatenate([counted, c])).astype(np.int64)
        if len(kept) > 5 * FLUSH:
            yield from gram_rows()
            kept, counted = kept[:0], counted[:0]
    yield from word_rows()
    yield from gram_rows()


def bound_for(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` rows have that count n or more."""
    by_size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).agg(F.count("*")).collect()}
    total = 0
    for j in range(max(by_size, default=0), -1, -1):
        total += by_size.get(j, 0)
        if total > most:
            return 2 ** (j + 1)
    return 1


class Trie:
    """A whole model in one place, for small ones: contexts as rows of follower counts; log10 probabilities by row and symbol.

    Rows stand order after order, from one byte to ORDER bytes.  ``index`` has the
    row of the longest known context of up to three bytes; ``child`` leads from a
    context of k bytes and the next byte to that of k + 1.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """Strings and counts for contexts of two bytes (all), three, four, ... (those kept)."""
        (g, n), *longer = tables
        c2, row = np.unique(g >> 8, return_inverse=True)
        m2 = np.zeros((len(c2), 256), np.float32)
        m2[row, g & 255] = n
        m1 = np.zeros((256, 256), np.float32)
        np.add.at(m1, c2 & 255, m2)
        m0 = m1.sum(axis=0)
        index = np.tile(np.arange(256, dtype=np.int32), 256)
        index[c2] = 256 + np.arange(len(c2), dtype=np.int32)
        self.index = np.tile(index, 256)
        rows = [self._blend([m1, m0[None].repeat(256, 0)]), self._blend([m2, m1[c2 & 255], m0[None].repeat(len(c2), 0)])]
        self.first, self.child = [256 + len(c2)], []
        contexts, orders, parent = [c2], [m2, m1], [c2 & 255]
        for k, (g, n) in enumerate(longer, 3):
            c, row = np.unique(g >> 8, return_inverse=True)
            m = np.zeros((len(c), 256), np.float32)
            m[row, g & 255] = n
            up = np.searchsorted(contexts[0], c & ((1 << 8 * (k - 1)) - 1))
            for at in range(0, len(c), 2048):
                chain, i = [m[at : at + 2048]], up[at : at + 2048]
                for shorter, above in zip(orders, parent + [None]):
                    chain.append(shorter[i])
                    i = above[i] if above is not None else i
                rows.append(self._blend([*chain, m0[None].repeat(len(chain[0]), 0)]))
            if k == 3:
                self.index[c] = self.first[0] + np.arange(len(c), dtype=np.int32)
            else:
                lead = np.full((max(1, len(contexts[0])), 256), -1, np.int32)
                lead[np.searchsorted(contexts[0], c >> 8), c & 255] = np.arange(len(c), dtype=np.int32)
                self.child.append(lead)
            self.first.append(self.first[-1] + len(c))
            contexts.insert(0, c)
            orders.insert(0, m)
            parent.insert(0, up)
        self.log = np.concatenate(rows)

    @staticmethod
    def _blend(orders: list[np.ndarray]) -> np.ndarray:
        """Counts by order, longest first -> log10 P with escapes and exclusion."""
        p = np.zeros(orders[0].shape)
        left, seen = np.ones((len(p), 1)), np.zeros(p.shape, dtype=bool)
        for counts in orders:
            own = np.where(seen, 0, counts).astype(np.float64)
            t, q = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            full = np.maximum(t + q, 1)
            p += left * own / full
            left = left * np.where(t > 0, q / full, 1.0)
            seen = seen | (counts > 0)
        rest = (~seen).sum(axis=1, keepdims=True)
        p += np.where(seen, 0, left / np.maximum(rest, 1))
        return np.log10(np.where(rest > 0, p, p / (1 - left))).astype(np.float32)  # nothing to escape to: the escape goes back

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        if not texts:
            return np.zeros(0)
        b, symbol, n = joined(texts)
        w = b.astype(np.int32)
        row = np.zeros(len(b), np.int32)
        row[3:] = self.index[(w[:-3] << 16) | (w[1:-2] << 8) | w[2:-1]]
        known = row - self.first[0]  # of the context of k bytes before each place, below 0 if not kept
        for k, lead in enumerate(self.child, 1):
            longer = np.full(len(b), -1, np.int32)
            at = np.flatnonzero(known[:-1] >= 0)
            longer[at + 1] = lead[known[at], b[at]]
            found = longer >= 0
            row[found] = longer[found] + self.first[k]
            known = longer
        cost = self.log[row, b].astype(np.float64)
        cost[~symbol] = 0
        return np.add.reduceat(cost, np.cumsum(n + ORDER) - (n + ORDER))


def _low(order: int) -> int:
    """Mask of a string of ``order`` bytes of context and a symbol."""
    return (1 << 8 * (order + 1)) - 1


class Level:
    """The strings of one order and their contexts, sorted; what is left of the next shorter context beside each."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int, shorter: Level | None):
        self.grams, self.n, self.order = grams, n.astype(np.float64), order
        c = grams >> 8
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
        self.contexts = c[first]
        self.kinds = np.diff(np.concatenate([first, [len(c)]])).astype(np.float64)
        self.total = np.add.reduceat(self.n, first) if len(c) else np.empty(0)
        if shorter is not None and len(c):
            up = np.searchsorted(shorter.contexts, self.contexts & (_low(order - 1) >> 8))
            there = shorter.n[np.searchsorted(shorter.grams, grams & _low(order - 1))]
            self.left_total = shorter.total[up] - np.add.reduceat(there, first)
            self.left_kinds = shorter.kinds[up] - self.kinds

    @staticmethod
    def under(longer: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings of that order that longer ones end with, and their counts."""
        u, at = np.unique(longer & _low(order), return_inverse=True)
        return u, np.bincount(at, n, len(u))


def short_levels(pairs: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels 0, 1 and 2 from the strings of two bytes of context."""
    levels = []
    for order in range(3):
        levels.append(Level(*Level.under(pairs, n, order), order, levels[-1] if levels else None))
    return levels


def code_lengths(asked: np.ndarray, short: list[Level], grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P of the last byte of each string after the others.

    ``grams`` holds every string of the training part that shares its last three
    bytes of context with one of ``asked``.  A context's followers are followers
    of every shorter one, so those seen above are the ones of the context before.
    """
    levels = list(short)
    for order in range(3, ORDER + 1):
        levels.append(Level(*Level.under(grams, n, order), order, levels[-1]))
    out = np.zeros(len(asked))
    open_, left, above, before = np.arange(len(asked)), np.ones(len(asked)), np.full(len(asked), -1), None
    for level in reversed(levels):
        if not len(level.grams):
            before, above = level, np.full(len(open_), -1)
            continue
        g = asked[open_] & _low(level.order)
        row = np.minimum(np.searchsorted(level.contexts, g >> 8), len(level.contexts) - 1)
        row = np.where(level.contexts[row] == g >> 8, row, -1)
        at = np.minimum(np.searchsorted(level.grams, g), len(level.grams) - 1)
        found = level.grams[at] == g
        t, q = np.where(row >= 0, level.total[row], 0.0), np.where(row >= 0, level.kinds[row], 0.0)
        if before is not None and len(before.grams):
            t, q = np.where(above >= 0, before.left_total[above], t), np.where(above >= 0, before.left_kinds[above], q)
        full = np.maximum(t + q, 1)
        out[open_[found]] = left[found] * level.n[at[found]] / full[found]
        left = np.where(t > 0, left * q / full, left)[~found]
        open_, above, before = open_[~found], row[~found], level
    out[open_] = left / (256 - len(short[0].grams))  # some bytes are in no UTF-8 text, so it isn't zero
    return np.log10(out)


def packed(grams: np.ndarray) -> bytes:
    """Sorted strings as their six bytes, place by place."""
    return zlib.compress(np.ascontiguousarray(grams.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data), np.uint8).reshape(ORDER + 1, -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, : ORDER + 1] = places.T
    return out.view("<i8").ravel()


class Costs:
    """Costs by string, in open addressing; only strings that are in it are asked for."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.bits = max(4, len(grams).bit_length() + 1)
        self.keys, self.costs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        place = self._place(grams)
        while len(grams):
            free = self.keys[place] < 0
            self.keys[place[free]] = grams[free]
            there = self.keys[place] == grams
            self.costs[place[there]] = costs[there]
            grams, costs, place = grams[~there], costs[~there], self._next(place[~there])

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, place: np.ndarray) -> np.ndarray:
        return (place + 1) & ((1 << self.bits) - 1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        place = self._place(grams)
        away = np.flatnonzero(self.keys[place] != grams)
        while len(away):
            place[away] = self._next(place[away])
            away = away[self.keys[place[away]] != grams[away]]
        return self.costs[place]


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in order, CHUNK bytes at a time, or one text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def slice_of(grams, n: int):
    """Of strings as integers, or a Column of them: by the last three bytes of context."""
    if isinstance(grams, np.ndarray):
        return (((grams >> 8) & 0xFFFFFF) * 2654435769 >> 20) % n
    return (F.shiftright(F.shiftright(grams, 8).bitwiseAND(0xFFFFFF) * 2654435769, 20) % n).cast("int")


def train(texts: DataFrame, most_words: int = 1 << 18) -> dict:
    """texts(text) -> the model: stored counts of words and strings; totals, frequent words, strings of two bytes of context, all of bounded size."""
    tune(texts.sparkSession)
    raw = texts.select(F.col("text").cast("string")).mapInArrow(count_rows, COUNTS)
    counts = stored(raw.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    word, gram = counts.where(F.col("word").isNotNull()).select("word", "n"), counts.where(F.col("gram").isNotNull()).select("gram", "n")
    total, types = word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = bound_for(word, most_words)
    frequent = word.where(F.col("n") >= least).toArrow()
    pairs = gram.groupBy(F.col("gram").bitwiseAND(_low(2)).alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("longer")).toArrow()
    return {
        "words": word, "total": total, "types": types, "least": least, "grams": gram, "n_grams": sum(pairs.column(2).to_pylist()),
        "pairs": (pairs.column(0).to_numpy().astype(np.int64), pairs.column(1).to_numpy().astype(np.float64)),
        "frequent": (frequent.column(0).to_pylist(), frequent.column(1).to_numpy()),
    }


#: What a Python worker has last made of a broadcast, by a name of the run.
_PREPARED: dict[str, object] = {}


def _prepared(name: str, sent, make):
    if name not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name] = make(*sent.value)
    return _PREPARED[name]


def packs(docs: DataFrame, slices: int) -> DataFrame:
    """docs(doc_id, text, held_out) -> each document with its batch, and the different strings of each batch by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = batch = TaskContext.get().partitionId() << 33
        kept, new, size = np.empty(0, np.int64), [], 0

        def strings() -> np.ndarray:
            out = np.unique(np.concatenate([kept, *new]))
            new.clear()
            return out

        def ended() -> pa.RecordBatch:
            s = slice_of(kept, slices)
            order = np.argsort(s, kind="stable")
            g, s = kept[order], s[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            parts = [packed(x) for x in np.split(g, first[1:])]
            no = pa.nulls(len(parts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(parts), batch)), pa.array(s[first], pa.int32()), no.cast(pa.int64()), no.cast(pa.int64()), no.cast(pa.bool_()),
                    no.cast(pa.binary()), pa.array(parts, pa.binary()),
                ],
                ["batch", "slice", "row", "doc_id", "held_out", "text", "grams"],
            )

        for b in batches:
            at = 0
            for texts in chunks([_lower(x) for x in b.column(1).to_pylist()]):
                m = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, batch)), pa.array(np.full(m, TEXT), pa.int32()), pa.array(np.arange(row, row + m)), b.column(0).slice(at, m).cast(pa.int64()), b.column(2).slice(at, m),
                        pa.array(texts, pa.binary()), pa.nulls(m, pa.binary()),
                    ],
                    ["batch", "slice", "row", "doc_id", "held_out", "text", "grams"],
                )
                at, row, size = at + m, row + m, size + sum(map(len, texts))
                new.append(np.unique(grams(texts)))
                if sum(map(len, new)) > BATCH // 2:
                    kept = strings()
                if len(kept) > BATCH or size > BATCH_BYTES:
                    kept = strings()
                    yield ended()
                    kept, size, batch = kept[:0], 0, batch + 1
        kept = strings()
        if len(kept):
            yield ended()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out").mapInArrow(run, PACKS)


def answers(asked: DataFrame, model: dict, slices: int) -> DataFrame:
    """asked(batch, slice, grams) -> + costs: the strings of each batch and slice with their code lengths."""
    sent, name = asked.sparkSession.sparkContext.broadcast(model["pairs"]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = _prepared(name, sent, short_levels)
        own, known, n, held = None, [], [], []

        def answered() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            known[:], n[:] = [np.concatenate([np.empty(0, np.int64), *known])], [np.concatenate([np.empty(0, np.int64), *n])]
            parts = [unpacked(x) for _, x in held]
            u = np.unique(np.concatenate(parts))
            costs = code_lengths(u, short, known[0], n[0]).astype("<f4")
            back = [costs[np.searchsorted(u, x)].tobytes() for x in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.int64()), pa.array([own] * len(held), pa.int32()), pa.array([x for _, x in held], pa.binary()), pa.array(back, pa.binary())],
                ["batch", "slice", "grams", "costs"],
            )
            held.clear()

        size = 0
        for b in batches:
            s = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1), len(s)] if len(s) else [0]
            for low, high in zip(edges, edges[1:]):
                part = b.slice(low, high - low)
                if s[low] != own:
                    yield from answered()
                    own, known, n, size = s[low], [], [], 0
                counted = int(np.searchsorted(part.column(1).to_numpy(), 0))
                if counted:
                    known.append(part.column(2).slice(0, counted).to_numpy())
                    n.append(part.column(3).slice(0, counted).to_numpy())
                for k, x in zip(part.column(1).slice(counted).to_pylist(), part.column(4).slice(counted).to_pylist()):
                    held.append((k, x))
                    size += len(x) // 2
                    if size > ASKED:
                        yield from answered()
                        size = 0
        yield from answered()

    counted = model["grams"].select(slice_of(F.col("gram"), slices).alias("slice"), F.lit(-1).cast("long").alias("batch"), "gram", "n", F.lit(None).cast("binary").alias("grams"))
    put = asked.select("slice", "batch", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("n"), "grams")
    dealt = counted.unionByName(put).repartition("slice").sortWithinPartitions("slice", "batch")
    return dealt.mapInArrow(run, "batch long, slice int, grams binary, costs binary")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text, held_out) -> + n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    tune(spark)
    total, types = model["total"], model["types"]
    room = total + 0.5 * (types + 1)
    sent, name = spark.sparkContext.broadcast(model["frequent"]), uuid.uuid4().hex
    every_word = model["least"] <= 1
    slices = max(1, -(-model["n_grams"] // SLICE))

    def frequent(keys: list[bytes], n: np.ndarray) -> dict[bytes, float]:
        return dict(zip(keys, np.log10((n + 0.5) / room).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _prepared(name, sent, frequent).get
        unseen = float(np.log10(0.5 / room))
        own, strings, costs, table_ = None, [], [], None
        for b in batches:
            at = 0
            for (batch, told), run_ in groupby(zip(b.column(0).to_pylist(), (x != TEXT for x in b.column(1).to_pylist()))):
                part = b.slice(at, m := sum(1 for _ in run_))
                at += m
                if batch != own:
                    own, strings, costs, table_ = batch, [], [], None
                if told:
                    strings += map(unpacked, part.column(5).to_pylist())
                    costs += (np.frombuffer(x, "<f4") for x in part.column(6).to_pylist())
                    continue
                if table_ is None:
                    table_ = Costs(np.concatenate(strings), np.concatenate(costs))
                    strings, costs = [], []
                texts = part.column(4).to_pylist()
                scores = [np.zeros(0)]
                for some in chunks(texts):
                    n = np.array([len(t) + 1 for t in some])
                    scores.append(np.add.reduceat(table_.of(grams(some)), np.cumsum(n) - n, dtype=np.float64))
                tokens, known, base, rare, times = [], [], [], [], []
                for t in texts:
                    parts = [*t.split(), END]
                    found = list(map(get, parts))
                    odd = Counter(w for w, x in zip(parts, found) if x is None)
                    missing = odd.total()
                    tokens.append(len(parts))
                    known.append(len(parts) - missing)
                    base.append(sum(filter(None, found)) + (missing * unseen if every_word else 0.0))
                    rare.append([] if every_word else [xxhash.xxh64_intdigest(w, 42) - (1 << 63) for w in odd])
                    times.append([] if every_word else list(odd.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(3), part.column(7), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()), pa.array(np.concatenate(scores)), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    each = stored(packs(docs, slices), "packs")
    told = answers(each.where(F.col("slice") != TEXT).select("batch", "slice", "grams"), model, slices)
    both = each.where(F.col("slice") == TEXT).drop("grams").unionByName(told, allowMissingColumns=True)
    dealt = both.select("batch", "slice", "row", "doc_id", "text", "grams", "costs", "held_out").repartition("batch").sortWithinPartitions("batch", "slice", "row")
    out = dealt.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>")
    names = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    if every_word:
        return out.select(*names)
    out = stored(out, "scored")
    each = out.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    by_hash = model["words"].where(F.col("n") < model["least"]).select(_shifted_hash().alias("hash"), "n")
    c = F.coalesce(F.col("n"), F.lit(0))
    more = (
        each.join(by_hash, "hash", "left").groupBy("row")
        .agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(room))).alias("_base"))
    )
    whole = out.drop("rare", "times").join(more, "row", "left")
    return (
        whole.withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
        .withColumn("base_score", F.col("base_score") + F.coalesce("_base", F.lit(0.0)))
        .select(*names)
    )


def _shifted_hash():
    """Spark's xxhash64 of the bytes as the tasks write it: unsigned minus 2^63."""
    return F.xxhash64("word").bitwiseXOR(F.lit(-(1 << 63)))


def held_out(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents"))
    return score(docs, train(docs.where(~F.col("held_out")).select("text")))
