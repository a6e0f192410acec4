"""Growing files: no line is lost or repeated, however they grow and wherever the stream is stopped."""

import random
from collections import Counter

import pytest

from sessionloom.sources import tail


def run(spark, path, at, **options):
    q = tail.read_appended(spark, str(path), **options).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return Counter((r["file"].rpartition("/")[2], r["at"], r["value"]) for r in spark.read.parquet(f"{at}/out").collect())


def added(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_appends_between_runs(spark, tmp_path):
    logs, at = tmp_path / "logs", tmp_path / "at"
    logs.mkdir()
    added(logs / "a.jsonl", b'{"a":1}\n{"a":2}\n{"half')
    added(logs / "b.txt", b"not this one\n")
    want = Counter({("a.jsonl", 0, '{"a":1}'): 1, ("a.jsonl", 8, '{"a":2}'): 1})
    assert run(spark, logs, at) == want
    assert run(spark, logs, at) == want, "nothing new"
    added(logs / "a.jsonl", b'":3}\n\n  \n{"a":4}\r\n')
    added(logs / "c.jsonl", "é\n".encode() + b"\xff\n")
    want += Counter({("a.jsonl", 16, '{"half":3}'): 1, ("a.jsonl", 31, '{"a":4}'): 1, ("c.jsonl", 0, "é"): 1, ("c.jsonl", 3, "�"): 1})
    assert run(spark, logs, at) == want


def test_a_file_that_was_cut_begins_anew(spark, tmp_path):
    logs, at = tmp_path / "logs", tmp_path / "at"
    logs.mkdir()
    added(logs / "a.jsonl", b"one\ntwo\nthree\n")
    added(logs / "b.jsonl", b"old line\n")
    first = run(spark, logs, at)
    (logs / "a.jsonl").write_bytes(b"new\n")  # shorter
    (logs / "b.jsonl").write_bytes(b"other, and longer than before\nmore\n")
    second = run(spark, logs, at)
    assert second - first == Counter({("a.jsonl", 0, "new"): 1, ("b.jsonl", 0, "other, and longer than before"): 1, ("b.jsonl", 30, "more"): 1})
    (logs / "a.jsonl").unlink()
    assert run(spark, logs, at) == second
    added(logs / "a.jsonl", b"back\n")
    assert run(spark, logs, at) - second == Counter({("a.jsonl", 0, "back"): 1})


def test_start_at_the_end(spark, tmp_path):
    logs, at = tmp_path / "logs", tmp_path / "at"
    logs.mkdir()
    added(logs / "a.jsonl", b"before\n")
    assert not run(spark, logs, at, start="end")
    added(logs / "a.jsonl", b"after\n")
    assert run(spark, logs, at, start="end") == Counter({("a.jsonl", 7, "after"): 1})


@pytest.mark.parametrize("seed", range(3))
def test_any_growth_gives_each_line_once(tmp_path, seed):
    """The reader alone, cut at random places, with small ranges; a new reader now and then stands for a restart."""
    rng = random.Random(seed)
    text = b"".join(b"x" * rng.choice([0, 1, 5, 40]) + str(i).encode() + rng.choice([b"\n", b"\r\n", b"\n\n"]) for i in range(60))
    cuts = sorted(rng.sample(range(len(text)), 12))
    file, got, start = tmp_path / "a.jsonl", [], {}
    reader = tail.TailReader(str(tmp_path), "*.jsonl", 7, False)
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        added(file, text[a:b])
        end = reader.latestOffset()
        for p in reader.partitions(start, end):
            got += [(r["at"], r["value"]) for batch in reader.read(p) for r in batch.to_pylist()]
        start = end
        if rng.random() < 0.3:
            reader = tail.TailReader(str(tmp_path), "*.jsonl", 7, False)
    want, at = [], 0
    for line in text.split(b"\n"):
        if line.strip():
            want.append((at, line.decode().removesuffix("\r")))
        at += len(line) + 1
    assert got == want


@pytest.mark.parametrize("split", ["1", "5", "1000000"])
def test_batch_reads_by_ranges(spark, tmp_path, split):
    (tmp_path / "s").mkdir()
    data = b"".join(b"y" * (i % 9) + b"\n" for i in range(50)) + b"last, without an end"
    (tmp_path / "s" / "a.jsonl").write_bytes(data)
    (tmp_path / "s" / "none.jsonl").write_bytes(b"")
    got = sorted((r["at"], r["value"]) for r in tail.read_from(spark, str(tmp_path / "s"), split=split).collect())
    want, at = [], 0
    for line in data.split(b"\n"):
        if line:
            want.append((at, line.decode()))
        at += len(line) + 1
    assert got == want
    assert tail.read_from(spark, str(tmp_path / "nothing")).collect() == []


def test_a_long_line_needs_memory_for_itself_alone(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"a" * (3 << 20) + b"\nb\n")
    with tail.opened(str(path))[0].open_input_file(str(path)) as f:
        r = tail.cut(str(path), 0, path.stat().st_size, 1 << 20, False)
        assert [[(p, len(x)) for p, x in tail.lines(f, part)] for part in r] == [[(0, 3 << 20)], [], [], [((3 << 20) + 1, 1)]]
        assert tail.last_line_end(f, (3 << 20) - 1) == 0
