"""Exact substring deduplication with sparse suffix arrays, sorted deep-shallow.

Every byte covered by a string of ``length`` bytes that also starts elsewhere
goes.  Which windows of that length are equal is settled without sorting all
suffixes:

1. Anchors.  In each window the ``GRAM``-byte string of least hash is its
   anchor (the first of equals), so equal windows have equal anchors at equal
   offsets.  An anchor owns a run of window starts; the bytes that these
   windows span are its context.  There is about one anchor in
   half of ``length`` bytes.
2. Counting.  An anchor whose string occurs once is settled (nothing goes); so
   is one whose whole context occurs twice (all its windows go).  A context
   that one text holds many times is one row.  Only hashes are shuffled.
3. Sorting.  What is left meets by anchor string, one row per different
   context, and the suffixes that start at the anchors are sorted: multikey
   quicksort to a shallow depth, blind tries for groups still equal there.
   Neighbours' common prefixes, taken along the trie of the bytes to the left,
   give each context its repeated windows.
4. A group with over ``GROUP`` different contexts (a passage with very many
   surroundings) is not sorted in one task: its windows are dealt out one by
   one and counted.

Equal texts are merged before step 1, so copies cost nothing; a text that
occurs twice goes entirely if it has ``length`` bytes.

Defined cases: a null text counts as empty; texts shorter than ``length`` stay
whole; repeated rows are copies of each other; null doc_ids are kept as they
are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, stored, table, tune

LENGTH = 400
#: Bytes that any passage of over 50 words has, about (51 words of four letters and a space).
PASSAGE = 256
GRAM = 32
#: Different contexts of one anchor string that one task sorts.
GROUP = 4096
#: Depth to which multikey quicksort goes before the blind tries take over.
SHALLOW = 24
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: list[np.ndarray] = []


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of each ``gram``-byte string; it only orders anchors."""
    if not _TABLES or len(_TABLES[0]) < len(b):
        _TABLES[:] = _powers(max(len(b), CHUNK + LENGTH))
    up, down = _TABLES
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(b * up[: len(b)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions with the first and last window start that each owns, in order of starts."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3
    where, first, last = [], [], []
    wide = length - gram + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at).astype(np.uint64)
        h = gram_hashes(b, gram) >> np.uint64(21) << np.uint64(21)
        h |= np.arange(len(h), dtype=np.uint64)  # ties: the first
        pad = -len(h) % wide
        rows = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - wide + 1
        least = np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])
        pos = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        where.append(pos[new] + at)
        first.append(new + at)
        last.append(np.concatenate([new[1:], [n]]) - 1 + at)
    return np.concatenate(where), np.concatenate(first), np.concatenate(last)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Orders strings that share a long prefix, looking at branching bytes only.

    A node is [depth, {byte: child}]; a leaf is a list of indices of one string.
    A new string goes down blindly to some leaf, is compared with it once, and
    is put in where the two part.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.top: list | None = None

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        if self.top is None:
            self.top = [-1, [i]]
            return
        node = self.top
        while node[0] >= 0:
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        same = common_prefix(self.strings[i], self.strings[other])
        if same == len(self.strings[i]) == len(self.strings[other]):
            node[1].append(i)
            return
        above, edge, node = None, None, self.top
        while 0 <= node[0] < same:
            above, edge = node, self._byte(i, node[0])
            node = node[1][edge]
        if node[0] == same:
            node[1][self._byte(i, same)] = [-1, [i]]
            return
        fork = [same, {self._byte(other, same): node, self._byte(i, same): [-1, [i]]}]
        if above is None:
            self.top = fork
        else:
            above[1][edge] = fork

    def order(self) -> list[int]:
        out, todo = [], [self.top]
        while todo:
            node = todo.pop()
            if node[0] < 0:
                out += node[1]
            else:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW, known: int = 0) -> list[int]:
    """Indices of strings in order: multikey quicksort to ``shallow`` bytes, then blind tries.

    The first ``known`` bytes are known to be equal and are passed over.
    """
    out: list[int] = []
    shallow += known
    todo = [(list(range(len(strings))), known)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            out += trie.order()
            continue
        byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
        less = [i for i, c in zip(group, byte) if c < pivot]
        same = [i for i, c in zip(group, byte) if c == pivot]
        more = [i for i, c in zip(group, byte) if c > pivot]
        todo.append((more, depth))
        todo.append((same, shallow if pivot < 0 else depth + 1))
        todo.append((less, depth))
    return out


def repeated(contexts: list[tuple[bytes, bytes, int, int]], length: int, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Contexts (left bytes reversed, right bytes, least and largest offset) -> intervals of repeated offsets.

    A window at offset o begins o bytes before the anchor.  Along the trie of
    left bytes each node holds the contexts that agree on ``depth`` bytes to
    the left; there the nearest neighbours in suffix order have the longest
    common right part, and the windows between the two ends are repeated.
    """
    rights = [c[1] for c in contexts]
    known = gram if len({r[:gram] for r in rights}) == 1 else 0
    order = deep_shallow(rights, known=known)
    shared = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    todo = [(order, shared, 0)]
    while todo:
        members, near, depth = todo.pop()
        lefts = [contexts[i][0] for i in members]
        depth = min(common_prefix(lefts[0], x) for x in lefts[1:])
        for k, i in enumerate(members):
            right = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
            low, high = max(length - right, contexts[i][2]), min(depth, contexts[i][3])
            if low <= high:
                out[i].append((low, high))
        groups: dict[int, tuple[list[int], list[int]]] = {}
        at: dict[int, int] = {}
        for k, i in enumerate(members):
            if len(contexts[i][0]) <= depth:
                continue
            c = contexts[i][0][depth]
            if c in groups:
                groups[c][1].append(min(near[at[c] : k]))
                groups[c][0].append(i)
            else:
                groups[c] = ([i], [])
            at[c] = k
        todo += [(m, n, depth) for m, n in groups.values() if len(m) > 1]
    return out


def merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed intervals as ordered, maximal half-open ones."""
    out: list[list[int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + 1)
        else:
            out.append([a, b + 1])
    return [(a, b) for a, b in out]


def _digest(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def gram_of(gram: int, length: int) -> int:
    """Bytes of an anchor string: as asked, or what suits short windows."""
    return max(8, min(gram, length // 2))


def anchor_rows(texts: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """(doc, text) -> (doc, pos, first, last, n, length, gram, context): hashes only.

    A context that a text holds n times is one row, for its first place.  All
    its windows repeat; they come as rows without gram, whose first and last
    are the ends of a run of window starts.  The lengths do not meet: each is
    the seed of its own hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                doc, cols = [], [[], [], [], [], [], [], []]
                for key, text in zip(b.column(0)[k : k + 200].to_pylist(), b.column(1)[k : k + 200].to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    for length in lengths:
                        g = gram_of(gram, length)
                        p, a, z = (x.tolist() for x in anchors(data, length, g))
                        times: dict[bytes, list[int]] = {}
                        for i, (x, y) in enumerate(zip(a, z)):
                            times.setdefault(xxhash.xxh3_128_digest(data[x : y + length], length), []).append(i)
                        one = [at[0] for at in times.values()]
                        runs = merged([(a[i], z[i]) for at in times.values() if len(at) > 1 for i in at])
                        doc += [key] * (len(one) + len(runs))
                        none = [None] * len(runs)
                        cols[0] += [p[i] for i in one] + none
                        cols[1] += [a[i] for i in one] + [x for x, _ in runs]
                        cols[2] += [z[i] for i in one] + [y - 1 for _, y in runs]
                        cols[3] += [len(at) for at in times.values()] + none
                        cols[4] += [length] * (len(one) + len(runs))
                        cols[5] += [_digest(data[p[i] : p[i] + g], length) for i in one] + none
                        cols[6] += [*times, *none]
                if doc:
                    kinds = (*[pa.int32()] * 5, pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.binary()), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc", "pos", "first", "last", "n", "length", "gram", "context"])

    return texts.mapInArrow(run, "doc binary, pos int, first int, last int, n int, length int, gram long, context binary")


def context_rows(todo: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """todo(gram, kinds, length, doc, pos, first, last) with the bytes of each context, read from one copy of its text."""
    names = ("gram", "kinds", "length", "pos", "first", "last")
    lists = todo.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("at")).join(ids.select("doc", F.col("id").alias("_id")), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, at in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8", "surrogatepass")
                for k in range(0, len(at), 5000):
                    part = at[k : k + 5000]
                    cols = [pa.array([x[n] for x in part], pa.int64() if n in ("gram", "kinds") else pa.int32()) for n in names]
                    held = pa.array([data[x["first"] : x["last"] + x["length"]] for x in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([*cols[:3], pa.array([doc] * len(part), pa.binary()), *cols[3:], held], [*names[:3], "doc", *names[3:], "bytes"])

    # A text that occurs several times is read once: from the row with the least id.
    read = texts.join(lists, "doc").where(F.col("id").eqNullSafe(F.col("_id"))).select("doc", "text", "at")
    return read.mapInArrow(run, "gram long, kinds long, length int, doc binary, pos int, first int, last int, bytes binary")


STARTS = "doc binary, length int, low int, high int"


def start_rows(rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int32()) for c in cols[1:])], ["doc", "length", "low", "high"])


def sorted_groups(rows: DataFrame, gram: int) -> DataFrame:
    """Context rows dealt and sorted by gram -> (doc, length, low, high): runs of repeated window starts."""

    def one(group: list[tuple]) -> list[tuple[bytes, int, int, int]]:
        if len(group) < 2:
            return []
        contexts, length = [], group[0][1]
        for _, _, _, pos, first, last, data in group:
            contexts.append((data[: pos - first][::-1], data[pos - first :], pos - last, pos - first))
        found = repeated(contexts, length, gram_of(gram, length))
        return [(g[2], length, g[3] - b + 1, g[3] - a) for g, spans in zip(group, found) for a, b in merged(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[bytes, int, int, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][:2] != row[:2]:
                    out += one(group)
                    group = []
                group.append(row)
            if len(out) > 20_000:
                yield start_rows(out)
                out.clear()
        out += one(group)
        if out:
            yield start_rows(out)

    return rows.mapInArrow(run, STARTS)


def counted_windows(rows: DataFrame) -> DataFrame:
    """For oversize groups: every window is hashed and counted by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                doc, lengths, start, digest = [], [], [], []
                for _, length, key, _, first, last, data in zip(*(c.to_pylist() for c in b.slice(k, 200).columns)):
                    doc += [key] * (last - first + 1)
                    lengths += [length] * (last - first + 1)
                    start += range(first, last + 1)
                    digest += [xxhash.xxh3_128_digest(data[i : i + length], length) for i in range(last - first + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.binary()), pa.array(lengths, pa.int32()), pa.array(start, pa.int32()), pa.array(digest, pa.binary())], ["doc", "length", "start", "window"])

    windows = rows.mapInArrow(run, "doc binary, length int, start int, window binary")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window", "left_semi").select("doc", "length", F.col("start").alias("low"), F.col("start").alias("high"))


def repeated_starts(texts: DataFrame, ids: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """texts(id, doc, text) -> (doc, length, low, high): runs of window starts that repeat, for each length.

    ``ids`` has one row (doc, n, id, bytes) for each different text.  The windows of
    copies are found to repeat like any other; only one copy is read for its bytes.
    """
    tune(texts.sparkSession)
    old: list[str] = []
    rows = stored(anchor_rows(texts.select("doc", "text"), lengths, gram), "anchors", old)
    same = rows.where("gram is not null").groupBy("gram", "context").agg(F.sum("n").alias("total"))
    by_gram = same.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("total") == 1, 1).otherwise(0)).alias("open"))
    met = stored(same.join(by_gram, "gram").where("total > 1 or kinds > 1 and open > 0"), "met", old)
    # From here on only what repeats, or may: contexts that occur twice, and those that share their anchor's string.
    hits = rows.join(met, ["gram", "context"]).select(*rows.columns, "total", "kinds", "open")
    inside = rows.where("gram is null").select("*", *[F.lit(None).cast("long").alias(n) for n in ("total", "kinds", "open")])
    over: list[str] = []
    hits = stored(hits.unionByName(inside), "hits", over)
    dropped(old)
    places = F.struct("doc", "length", "pos", "first", "last")
    todo = hits.where("kinds > 1 and open > 0").groupBy("gram", "context").agg(F.first("kinds").alias("kinds"), F.min(places).alias("one")).select("gram", "kinds", "one.*")
    contexts = stored(context_rows(todo, texts, ids), "contexts", old)
    few = contexts.where(F.col("kinds") <= group).drop("kinds").repartition("gram").sortWithinPartitions("gram", "length")
    many = contexts.where(F.col("kinds") > group).drop("kinds")
    open_ = stored(sorted_groups(few, gram).union(counted_windows(many)), "open", over)
    dropped(old)
    settled = hits.where("gram is null or total > 1").select("doc", "length", F.col("first").alias("low"), F.col("last").alias("high"))
    starts = stored(settled.union(open_).distinct(), "starts")
    dropped(over)
    return starts


def runs_of(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs + ``_text`` (never null) and ``_runs``: array of covered byte runs (length, low, high), unordered; null if none."""
    names = docs.columns
    d = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn("_doc", F.substring(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)), 1, 16))
    texts = d.where(F.octet_length("_text") >= min(lengths)).select(F.col(doc_id).alias("id"), F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    ids = texts.groupBy("doc").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min(F.octet_length("text")).alias("bytes"))
    each = F.explode(F.array(*map(F.lit, lengths)))
    whole = ids.where("n > 1").select("doc", each.alias("length"), "bytes").where("bytes >= length").select("doc", "length", F.lit(0).alias("low"), (F.col("bytes") - F.col("length")).alias("high"))
    starts = repeated_starts(texts, ids, lengths).join(whole.select("doc", "length"), ["doc", "length"], "left_anti").select("doc", "length", "low", "high").union(whole)
    runs = starts.groupBy("doc").agg(F.collect_list(F.struct("length", "low", (F.col("high") + F.col("length") - 1).alias("high"))).alias("_runs"))
    return d.join(runs, d["_doc"] == runs["doc"], "left").select(*[d[c] for c in names], "_text", "_runs")


def covered(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of one length, half-open."""
    return merged([(x["low"], x["high"]) for x in runs or () if x["length"] == length])


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What stays of the bytes."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def removed(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256; with ``passage`` also
    n_passage, the bytes that strings of that many bytes would remove."""
    lengths = (length,) if passage is None else (length, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[], [], [], [], []]
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                spans = covered(runs, length)
                left = cut(data, spans)
                n = sum(y - x for x, y in covered(runs, lengths[-1]))
                for c, v in zip(rows, (len(data), len(data) - len(left), len(spans), n, hashlib.sha256(left).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage", "kept_sha256"])

    d = runs_of(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lengths).select("doc_id", "_text", "_runs")
    out = d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage long, kept_sha256 string")
    return out if passage is not None else out.drop("n_passage")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, columns unchanged, without repeated bytes; n_chars follows the text.

    Half characters at the edges of a removed run go too.
    """

    @F.udf("string", useArrow=True)
    def kept(text, runs):
        return cut(text.encode("utf-8", "surrogatepass"), covered(runs, length)).decode("utf-8", "ignore")

    d = runs_of(docs, (length,))
    out = d.withColumn("text", F.when(F.col("_runs").isNotNull(), kept("_text", "_runs")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_runs").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), passage=PASSAGE)
