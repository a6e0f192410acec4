"""Byte-level BPE by a sentencepiece model serialised from the vocabulary itself.

A rank file becomes a sentencepiece BPE model: every byte is mapped to one
printable character, each token is a piece scored by its negative rank,
normalisation is the identity.  Merging the best-scored pair first is then the
rank order of byte-level BPE.  Texts are split into pre-tokens; different
parts of a batch are encoded once and remembered, in bounded memory.

Defined cases: null and empty texts have no ids; any text is encoded whole;
repeated rows are encoded each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import table, tune

#: Parts that one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Characters of text that are encoded at once, or one text; ids that are decoded at once.
AT_ONCE = 1 << 22
#: Stand before a text's first part, and before a mark that follows a letter: no space belongs to these; nor to a line end.
MARKS = "\x00\x01\n"


def byte_map() -> list[str]:
    """A printable character for each byte, invertible: itself, or U+0100 and on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model (protocol buffer) of a rank table; ids are the ranks' places."""
    chars = byte_map()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, _field(1, "unknown") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, _field(2, trainer), _field(3, normaliser)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def splitter(pattern: str):
    """text -> pre-tokens, as the pattern's own engine would find them.

    Latin-1 texts go through the standard library with the Unicode classes
    written out for that range, which is twice as fast.
    """
    space, letter, number = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    narrow = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
    wide = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def split(text: str) -> list[str]:
        return (narrow if text.isascii() or max(text) < "Ā" else wide).findall(text)

    return split


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and decodes them.

    A text is taken apart where patterns like the default one begin a pre-token
    whatever stands before: at a space that a non-space follows, at a line end,
    and between a letter and a mark.  The parts are made distinct batch by
    batch; only those not met lately are split by the pattern and merged.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.split = splitter(pattern)
        chars = byte_map()
        self.chars, self.line_end = np.array([ord(c) for c in chars], "<u4"), chars[10]
        back = {c: b for b, c in enumerate(chars)}
        self.by_place = sorted(ranks.values())
        self.in_order = self.by_place == [*range(len(ranks))]
        tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.length = np.zeros(max(self.by_place, default=0) + 1, np.int64)
        self.length[self.by_place] = [len(t) for t in tokens]
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.whole = {t.decode(): (r,) for t, r in ranks.items() if _is_text(t)}  # pre-tokens that are tokens aren't merged
        self.forget()

    def forget(self) -> None:
        """Nothing is known but the tokens that are words."""
        words = [(t[1:], i) for t, (i,) in self.whole.items() if t[0] == " " and t[1:].isalpha()]
        self.known = {w: k for k, (w, _) in enumerate(words)}
        self.ids, self.ends = array("I", [i for _, i in words]), array("q", range(len(words) + 1))

    def mapped(self, pieces: list[str]) -> list[str]:
        """The pieces' bytes as printable characters; all at once, but for pieces that hold a line end."""
        whole = "\n".join(pieces)
        if whole.count("\n") >= len(pieces):
            return [self._printed(p) for p in pieces]
        return self._printed(whole).split(self.line_end)

    def _printed(self, text: str) -> str:
        return self.chars[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().decode("utf-32-le")

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each pre-token, none of them a token."""
        if not pieces:
            return []
        out = self.model.encode(self.mapped(pieces), num_threads=1)
        return out if self.in_order else [[self.by_place[i] for i in ids] for ids in out]

    def add(self, keys: list[str], ids: list[list[int]]) -> None:
        self.known.update(zip(keys, range(len(self.ends) - 1, len(self.ends) - 1 + len(keys))))
        self.ids.extend(chain.from_iterable(ids))
        self.ends.extend(islice(accumulate(map(len, ids), initial=self.ends[-1]), 1, None))

    def learn(self, keys: list[str]) -> None:
        """Parts that are not known yet; one that may not be taken by itself gets place -1."""
        words = [k for k in keys if k.isalpha()]
        self.add(words, self.merged([" " + k for k in words]))
        others = {}
        for k in keys:
            if k.isalpha():
                continue
            own = k[1:] if k[:1] in MARKS else k
            if own and (own.isspace() or own[0].isspace() or own[-1].isspace() or len(own.split()) > 1) or not own and k not in ("\n", MARKS[0]):
                self.known[k] = -1
            else:
                others[k] = self.split(own if k[0] in MARKS[:2] else k if k[0] == "\n" else " " + k)
        ids = self.pieces(chain.from_iterable(others.values()))
        self.add([*others], [[*chain.from_iterable(ids[p] for p in x)] for x in others.values()])

    def pieces(self, pieces: Iterable[str]) -> dict[str, Sequence[int]]:
        """The ids of each different pre-token."""
        ids = {p: self.whole.get(p) for p in pieces}
        todo = [p for p, x in ids.items() if x is None]
        return ids | dict(zip(todo, self.merged(todo)))

    def places(self, keys: list[str]) -> np.ndarray:
        out = list(map(self.known.get, keys))
        missing = [j for j, x in enumerate(out) if x is None]
        if len(self.known) + len(missing) > REMEMBERED:
            self.forget()
            missing = range(len(keys))
        self.learn([keys[j] for j in missing])
        for j in missing:
            out[j] = self.known[keys[j]]
        return np.array(out, np.int64)

    def by_pattern(self, text: str) -> np.ndarray:
        """Ids of any text, by the pattern alone."""
        pieces = self.split(text)
        ids = self.pieces(pieces)
        return np.fromiter((i for p in pieces for i in ids[p]), "<u4")

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            yield from self._batch(texts[at:end])
            at = end

    def _batch(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rows, marked = [], []
        for i, x in enumerate(texts):
            if not x:
                out[i] = np.empty(0, "<u4")
            elif "\x00" in x or "\x01" in x or "\n\n\n" in x or "\n\n " in x or x.endswith("\n\n"):
                out[i] = self.by_pattern(x)
            else:
                rows.append(i)
                marked.append("\x00" + x.replace("\n", " \n"))
        try:
            parts = pc.split_pattern(pc.replace_substring_regex(pa.array(marked, pa.large_string()), r"(\pL)([.,;:!?])", "\\1 \x01\\2"), " ")
        except UnicodeEncodeError:  # a lone surrogate
            for i in rows:
                out[i] = self.by_pattern(texts[i])
            return out
        flat = parts.flatten().dictionary_encode()
        place = self.places(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy()]
        edges = parts.offsets.to_numpy()
        odd = np.concatenate([[0], np.cumsum(place < 0)])[edges]
        ends = np.frombuffer(self.ends, np.int64)
        start, length = np.append(ends[:-1], 0), np.append(np.diff(ends), 0)  # place -1: nothing
        ids = gathered(np.frombuffer(self.ids, "<u4"), start, length, place)
        last = np.concatenate([[0], np.cumsum(length[place])])[edges]
        del ends
        for n, i in enumerate(rows):
            out[i] = self.by_pattern(texts[i]) if odd[n + 1] > odd[n] else ids[last[n] : last[n + 1]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(gathered(self.pool, self.start, self.length, ids[k : k + AT_ONCE]).tobytes() for k in range(0, len(ids), AT_ONCE))


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """pool[start[p] : start[p] + length[p]] for each p in place, joined."""
    n = length[place]
    end = np.cumsum(n)
    return pool[np.repeat(start[place] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> one row each: n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, one, two = [], [], []
            for ids in c.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                one.append(hashlib.sha256(np.ascontiguousarray(ids)).hexdigest())
                two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids, decoded_sha256), ids ready to be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = list(c.encode(part.column(1).to_pylist()))
                n = pa.array([len(x) for x in ids], pa.int64())
                back = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([x.tobytes() for x in ids], pa.binary()), back], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
