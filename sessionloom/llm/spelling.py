"""Spelling variants by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point makes one
of the other.  Words meet in blocks of (m, window): m is the length of the
shorter word of a pair, and all words of a block agree before the window and,
counted from their ends, behind it.  A pair belongs to the block whose window
holds its edit, which is where the two first differ, so it is found once.  A
window is cut in half as long as its block holds more than ``BLOCK`` words: a
hot beginning or ending is never one group, and blocks of a window that can't
be cut are bounded by the alphabet.

A block holds a bitset of its words for every position of the window and
letter there.  One run over the letters of a word moves three sets along, all
words of the block at once: those equal so far, those with one replaced letter,
and those with one more letter, which read their bitsets one position on.

Defined cases: null and blank texts have no words; a null id counts as the
empty text; repeated rows count each; runs of any length are whole words; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import LOWER, dropped, stored, table, tune

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, SPOIL = 7, 2, 10, 31
#: Words of a block, beyond which its window is cut.
BLOCK = 4096
#: Different words that a task counts before it hands them on.
HELD = 200_000
BLOCKED = "key long, m int, lo int, hi int, word string, n long"


def run_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, spoil: int = SPOIL) -> DataFrame:
    """docs(doc_id, text) -> (word, n) of whole texts, summed.

    Where ``spoil`` divides h, the crc32 of ``id:run``, the run loses its code
    point h mod length.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                low = text.encode().translate(LOWER).decode()
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(runs.findall(low)).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % spoil == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least_length:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    tune(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(counts, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _key(m: Column, lo: Column, hi: Column) -> Column:
    word = F.col("word")
    end = F.when(hi > 0, F.expr("right(word, hi)")).otherwise("")
    return F.xxhash64(m, lo, hi, F.substring(word, F.lit(1), lo), end)


def _windows(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its window: an edit before the middle leaves the end alone, any other the beginning."""
    middle = F.expr("(lo + m - hi) div 2").cast("int")
    halves = F.array(F.struct(F.col("lo"), (F.col("m") - middle).alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    cut = rows.withColumn("half", F.explode(halves)).select("m", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "word", "n")
    return cut.select(_key(F.col("m"), F.col("lo"), F.col("hi")).alias("key"), "m", "lo", "hi", "word", "n")


def blocks(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, most: int = BLOCK, over: list[str] | None = None) -> DataFrame:
    """vocabulary(word, n) -> rows of blocks, none of more than ``most`` words but where a window is one code point wide.

    ``over`` gets the paths of the tables of hot blocks that the rows read.
    """
    size = F.char_length("word")
    of = F.when(size > least_length, F.array(size, size - 1)).otherwise(F.array(size))  # pairs with words of its length or longer, and with shorter ones
    rows = vocabulary.select("word", "n", F.explode(of).alias("m")).select(F.col("m").cast("int"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "word", "n")
    rows, parts = _windows(rows), []
    while True:
        wide = F.col("m") - F.col("lo") - F.col("hi") > 1
        hot = rows.where(wide).groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > most).select("key")
        hot = stored(hot, "hot-blocks", over)
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, "key", "left_anti").union(rows.join(hot, "key", "left_semi").where(~wide)))
        rows = _windows(rows.join(hot, "key", "left_semi").where(wide))
    for p in parts:
        rows = rows.union(p)
    return rows


def near_in_block(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of near words, the shorter first, whose edit lies in the window [lo, m - hi)."""
    end = m - hi
    at: list[dict[str, int]] = [{} for _ in range(end - lo + 1)]
    longer = 0
    for j, w in enumerate(words):
        bit = 1 << j
        if len(w) > m:
            longer |= bit
        for k, letter in enumerate(w[lo : end + (len(w) > m)]):
            at[k][letter] = at[k].get(letter, 0) | bit
    every = (1 << len(words)) - 1
    same = every ^ longer
    for i, w in enumerate(words):
        if len(w) > m:
            continue
        equal, replaced, inserted = every, 0, 0
        for k, letter in enumerate(w[lo:end]):
            here = at[k].get(letter, 0)
            inserted = (inserted | equal & longer) & at[k + 1].get(letter, 0)
            replaced = replaced & here | equal & same & ~here
            equal &= here
        found = (replaced >> (i + 1) << (i + 1)) | inserted | equal & longer
        while found:
            bit = found & -found
            found ^= bit
            j = bit.bit_length() - 1
            if _in_window(w, words[j], m, lo, hi):
                yield i, j


def _in_window(short: str, other: str, m: int, lo: int, hi: int) -> bool:
    """Both agree outside the window, and first differ inside it."""
    if short[:lo] != other[:lo] or (hi and short[-hi:] != other[-hi:]):
        return False
    edit = lo
    while edit < m and short[edit] == other[edit]:
        edit += 1
    return edit < m - hi or not hi


def near_pairs(rows: DataFrame) -> DataFrame:
    """Blocks -> (word, n, near, near_n), each pair in both directions."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []

        def flushed() -> pa.RecordBatch:
            w, n, o, k = zip(*out) if out else ((), (), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(o, pa.string()), pa.array(k, pa.int64())], ["word", "n", "near", "near_n"])

        for (_, m, lo, hi), words, counts in grouped(batches):
            for i, j in near_in_block(words, m, lo, hi):
                out += [(words[i], counts[i], words[j], counts[j]), (words[j], counts[j], words[i], counts[i])]
                if len(out) > 50_000:
                    yield flushed()
        yield flushed()

    by = ["key", "m", "lo", "hi"]
    return rows.select(*by, "word", "n").repartition(*by).sortWithinPartitions(*by).mapInArrow(found, "word string, n long, near string, near_n long")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int]]]:
    """Blocks of two words or more from rows sorted by block, across batches."""
    last, words, counts = None, [], []
    for b in batches:
        for *block, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if block != last:
                if len(words) > 1:
                    yield last, words, counts
                last, words, counts = block, [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield last, words, counts


def forms(vocabulary: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, ties by code points, if it has ``times`` the word's n."""
    both = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).union(pairs.select("word", "n", "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near"))))
    every = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    return every.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))


def roots(named: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, twice as far in each round.

    A form has ``TIMES`` the count of its word, so the largest count bounds the rounds.
    """
    up = named.where("form is not null").select("word", F.col("form").alias("root"))
    hops = len(str(named.agg(F.max("n")).first()[0] or 1)) - 1
    over: list[str] = []
    for _ in range(math.ceil(math.log2(max(1, hops)))):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, over = over, []
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots", over)
        dropped(before)
    return up


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, spoil: int = SPOIL, most: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> (word, n, n_near, form, form_n, root)."""
    over: list[str] = []
    vocabulary = stored(run_counts(docs, least_length, spoil).where(F.col("n") >= least_count), "vocabulary", over)
    named = stored(forms(vocabulary, near_pairs(blocks(vocabulary, least_length, most, over)), times), "named")
    dropped(over)
    return named.join(roots(named), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH RECURSIVE rem AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)) AS cps
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[{LETTERS}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(cps, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, rem),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {SPOIL} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
holes AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS k FROM holes AS a JOIN holes AS b ON a.i = b.i AND length(a.word) = length(b.word) AND left(a.word, a.i - 1) = left(b.word, b.i - 1) AND substr(a.word, a.i + 1) = substr(b.word, b.i + 1) AND a.word <> b.word
  UNION ALL SELECT DISTINCT a.word, a.n, b.word, b.n FROM holes AS a JOIN words AS b ON left(a.word, a.i - 1) || substr(a.word, a.i + 1) = b.word
  UNION ALL SELECT DISTINCT b.word, b.n, a.word, a.n FROM holes AS a JOIN words AS b ON left(a.word, a.i - 1) || substr(a.word, a.i + 1) = b.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, min({{'k': -k, 'o': other}}) AS b FROM near GROUP BY word),
named AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.k >= {TIMES} * n THEN b.o END AS form, CASE WHEN -b.k >= {TIMES} * n THEN -b.k END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL SELECT c.word, c.next, f.form FROM chain AS c JOIN named AS f ON f.word = c.next)
SELECT word, n.form, c.root, n.n, n.n_near, n.form_n FROM named AS n JOIN (SELECT word, root FROM chain WHERE next IS NULL) AS c USING (word)"""
