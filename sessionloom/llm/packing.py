"""Best-fit packing of token pieces, improved by swap-based local search.

Documents become ids of a word-end BPE vocabulary and an end id; longer ones
are cut at the length of a sequence.  The pieces are dealt evenly, whatever
their ids, to groups of about ``GROUP``.  A group is packed best fit, largest
first; then the least filled bin gives to other underfull ones: it moves a
piece, or exchanges one for one, two for one or one for two, always the
exchange that raises the sum of squared fills most, until it is empty or none
raises it.  The search ends where the lower bound is met, or a pass over the bins
empties less than a hundredth of those above it.  The bins that a group leaves
least filled (as many as it has above its lower bound, and one) are opened
again and their pieces dealt anew, until one group holds them or dealing no longer helps.

Only lengths and a piece's few numbers travel; ``sequences`` brings the ids.  A task holds one group.

Defined cases: null and empty texts are one piece, the end id; texts of any
length are whole; repeated rows and null ids are pieces of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.bpe import gathered
from sessionloom.llm.common import stored, table, tune

VOCABULARY, END, SEQUENCE = "word_bpe_49k.json", 1, 4096
#: Pieces that one task packs.
GROUP = 16_384
#: Parts of texts, and their characters, that a worker remembers; characters of text that are encoded at once, or one text.
REMEMBERED, REMEMBERED_CHARS, AT_ONCE = 400_000, 8 << 20, 1 << 22
#: Words of letters alone that are encoded as one text.
TOGETHER = 100
PIECE = "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


# -- ids


def vocabulary_path(name: str) -> str:
    """A file of the public vocabularies, found where the task runs; any other path as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts, part by part.

    The vocabulary's pre-tokens hold no white space and never run from a letter
    to a mark, and normalisation doesn't act across either, so the parts between
    are encoded by themselves: different parts of a batch once, and those met
    lately not again.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.tokenizer.encode_special_tokens = True
        pieces = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(pieces.values()) + 1, bool)
        self.closes[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.chars, self.ids, self.ends = {"": 0}, 0, array("I"), array("q", [0, 0])

    def places(self, parts: list[str]) -> np.ndarray:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
            new = [p for p in parts if p]
        at, new = len(self.ends) - 1, self.words_first(new)
        self.known.update(zip(new, range(at, at + len(new))))
        self.chars += sum(map(len, new))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def add(self, ids: list[int], lengths: list[int]) -> None:
        self.ids.extend(ids)
        self.ends.extend(islice(accumulate(lengths, initial=self.ends[-1]), 1, None))

    def words_first(self, parts: list[str]) -> list[str]:
        """Adds the ids of parts and gives them in the order added: words of letters alone are encoded many at once.

        A word is one pre-token, whose last id alone closes a word.  Where a text
        of words has more of those than words, each is encoded by itself.
        """
        words, others, done = [], [], []
        for p in parts:
            (words if p.isalpha() else others).append(p)
        for k in range(0, len(words), 20_000):
            chunks = [words[j : j + TOGETHER] for j in range(k, min(k + 20_000, len(words)), TOGETHER)]
            for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
                ids = e.ids
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(chunk):
                    self.add(ids, np.diff(ends, prepend=0).tolist())
                    done += chunk
                else:
                    others += chunk
        for k in range(0, len(others), 20_000):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(others[k : k + 20_000], add_special_tokens=False)]
            self.add([*chain.from_iterable(encoded)], [*map(len, encoded)])
        return done + others

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            yield from self._batch([x or "" for x in texts[at:end]])
            at = end

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.large_string()), r"(\pL)([.,;:!?])", r"\1 \2"))
        flat = parts.flatten().dictionary_encode()
        place = self.places(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy()]
        ends = np.frombuffer(self.ends, np.int64)
        start, length = ends[:-1], np.diff(ends)
        ids = gathered(np.frombuffer(self.ids, "<u4"), start, length, place)
        edges = np.concatenate([[0], np.cumsum(length[place])])[parts.offsets.to_numpy()]
        del ends, start
        for a, b in zip(edges[:-1], edges[1:]):
            yield ids[a:b]


_ENCODERS: dict[str, WordIds] = {}


def encoder(name: str) -> WordIds:
    """The worker's encoder, made once."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordIds(name)
    return _ENCODERS[name]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row a piece; ``ids`` (little-endian unsigned 32-bit) only if asked for.

    piece_id numbers the rows of a partition, so store the result before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out: list[list] = [[] for _ in range(7)]
                for i, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for j in range(0, len(ids), most):
                        data = ids[j : j + most].tobytes()
                        for column, value in zip(out, (at, i, j // most, j, len(data) // 4, zlib.crc32(data), data)):
                            column.append(value)
                        at += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["piece_id", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)][: 6 + with_ids], names[: 6 + with_ids])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE + ", ids binary" * with_ids)


# -- packing of one group


def lowest_from(mask: int, least: int) -> int:
    """The lowest set bit at ``least`` or above; -1 if there is none."""
    rest = mask >> max(least, 0)
    return max(least, 0) + (rest & -rest).bit_length() - 1 if rest else -1


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Bins of indices: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # set of rooms that some bin has
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = lowest_from(rooms, sizes[i])
        if room < 0:
            room, k = most, len(bins)
            bins.append([])
        else:
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        bins[k].append(i)
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins


class Search:
    """Local search over the underfull bins of a packing.

    Bins are kept by their room; a class of equal room has the set of sizes,
    and of sums of two sizes, that one of its bins holds.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], most: int):
        self.bins, self.sizes, self.most = bins, sizes, most
        self.room = [most - sum(sizes[i] for i in b) for b in bins]
        self.classes: dict[int, set[int]] = {}
        self.masks: dict[int, tuple[int, int]] = {}
        for k, r in enumerate(self.room):
            self._enter(k, r)

    def _enter(self, k: int, room: int) -> None:
        if 0 < room < self.most:
            self.classes.setdefault(room, set()).add(k)
            self.masks.pop(room, None)

    def _leave(self, k: int) -> None:
        room = self.room[k]
        if k in (held := self.classes.get(room, set())):
            held.discard(k)
            self.masks.pop(room, None)
            if not held:
                del self.classes[room]

    def own_masks(self, k: int) -> tuple[int, int]:
        """Sets of the sizes in a bin, and of the sums of two."""
        one = two = 0
        for i in self.bins[k]:
            two |= one << self.sizes[i]
            one |= 1 << self.sizes[i]
        return one, two

    def class_masks(self, room: int) -> tuple[int, int]:
        if room not in self.masks:
            one = two = 0
            for k in self.classes[room]:
                a, b = self.own_masks(k)
                one, two = one | a, two | b
            self.masks[room] = one, two
        return self.masks[room]

    def exchange(self, donor: int) -> tuple[int, int, int, int] | None:
        """(gain, given, room, taken): the best exchange of the donor for a bin with that room; given and taken are sums of sizes."""
        fill = self.most - self.room[donor]
        one, two = self.own_masks(donor)
        best = None
        given_sums = one | two
        while given_sums:
            given = (given_sums & -given_sums).bit_length() - 1
            given_sums &= given_sums - 1
            single = one >> given & 1
            for room in self.classes:
                if room >= given:
                    taken = 0
                else:
                    ones, twos = self.class_masks(room)
                    taken = lowest_from(ones | twos if single else ones, given - room)
                    if not 0 <= taken < given:
                        continue
                more = given - taken
                gain = 2 * more * (self.most - room - fill + more)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, given, room, taken
        return best

    def held(self, k: int, total: int, pair: bool) -> list[int] | None:
        """Indices in a bin, one or (if allowed) two, whose sizes make a sum."""
        if not total:
            return []
        by_size: dict[int, int] = {}
        for i in self.bins[k]:
            by_size.setdefault(self.sizes[i], i)
        if total in by_size:
            return [by_size[total]]
        if pair:
            seen: dict[int, int] = {}
            for i in self.bins[k]:
                if total - self.sizes[i] in seen:
                    return [seen[total - self.sizes[i]], i]
                seen[self.sizes[i]] = i
        return None

    def apply(self, donor: int, given: int, room: int, taken: int) -> None:
        give = self.held(donor, given, True)
        for k in self.classes[room]:
            take = self.held(k, taken, len(give) == 1)
            if take is not None:
                break
        self._leave(k)
        self.bins[k] = [i for i in self.bins[k] if i not in take] + give
        self.bins[donor] = [i for i in self.bins[donor] if i not in give] + take
        self.room[k] -= given - taken
        self.room[donor] += given - taken
        self._enter(k, self.room[k])

    def emptied(self, donor: int) -> bool:
        """Gives from the donor as long as that raises the squared fill."""
        self._leave(donor)
        while self.bins[donor] and (best := self.exchange(donor)):
            self.apply(donor, *best[1:])
        self._enter(donor, self.room[donor])
        return not self.bins[donor]

    def run(self) -> list[list[int]]:
        least = -(-sum(self.sizes) // self.most)
        count = sum(map(bool, self.bins))
        while count > least:
            before = count
            for k in sorted((k for held in self.classes.values() for k in held), key=lambda k: -self.room[k]):
                if self.bins[k] and self.room[k] and self.emptied(k):
                    count -= 1
                    if count == least:
                        break
            if before - count <= (before - least) // 100:
                break
        return [b for b in self.bins if b]


def packed_group(sizes: list[int], most: int) -> list[list[int]]:
    """Bins of indices, fullest first."""
    bins = Search(best_fit(sizes, most), sizes, most).run()
    return sorted(bins, key=lambda b: -sum(sizes[i] for i in b))


# -- packing of all


def packed_round(rows: DataFrame, groups: int, most: int, number: int, last: bool) -> DataFrame:
    """Rows of pieces with sequence_id and offset; both null for pieces of bins that stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (first := next(batches, None)) is None else pa.Table.from_batches([first, *batches])
        sizes = held.column("length").to_pylist()
        bins = packed_group(sizes, most)
        least = -(-sum(sizes) // most)
        closed = len(bins) if last else max(0, len(bins) - (len(bins) - least + 1))
        ids, offsets = np.full(len(sizes), -1, np.int64), np.full(len(sizes), -1, np.int64)
        base = number << 52 | TaskContext.get().partitionId() << 24
        for k, b in enumerate(bins[:closed]):
            at = 0
            for i in b:
                ids[i], offsets[i] = base | k, at
                at += sizes[i]
        open_ = ids < 0
        out = held.append_column("sequence_id", pa.array(ids, pa.int64(), mask=open_)).append_column("offset", pa.array(offsets, pa.int64(), mask=open_))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.repartition(groups).mapInArrow(run, PIECE + ", sequence_id long, offset long")


def packed(rows: DataFrame, most: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Stored pieces -> the same rows with sequence_id and offset.

    A round deals what is open to groups; the next takes the bins they left
    least filled.  The result reads one stored table a round, with under half the pieces
    of the round before, so that their number is the logarithm of the input's.
    """
    rows, parts, number = rows.select(*[c.split()[0] for c in PIECE.split(", ")]), [], 0
    count = rows.count()
    while count:
        groups = math.ceil(count / group)
        out = stored(packed_round(rows, groups, most, number, groups == 1), "packed")
        parts.append(out.where("sequence_id is not null"))
        rows = out.where("sequence_id is null").drop("sequence_id", "offset")
        left = rows.count()
        if 2 * left > count and groups > 1:  # dealing anew doesn't help: close these as they lie
            parts.append(stored(packed_round(rows, math.ceil(left / group), most, number + 1, True), "packed"))
            break
        count, number = left, number + 1
    if not parts:
        return rows.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, most: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text) -> (sequence_id, n_tokens, ids, pieces): whole sequences ready to be written, with where each piece lies."""
    kept = stored(pieces(docs, vocabulary, end, most, with_ids=True), "pieces")
    placed = packed(kept.drop("ids"), most, group).select("piece_id", "sequence_id", "offset")
    rows = kept.join(placed, "piece_id").select("sequence_id", F.struct("offset", "doc_id", "piece", "start", "length", "ids").alias("p"))
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a sequence has 4,096 pieces at most
    return whole.select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"), F.transform("p", lambda p: p.dropFields("ids")).alias("pieces"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(pieces(table(spark, sf_dir, "documents")), "pieces")
    return packed(rows).drop("piece_id")
