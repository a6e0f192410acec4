"""Live state against rules written out row by row, for streams cut into micro-batches at several places."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.streaming import state

SCHEMA = "session_id long, id long, ts timestamp, role string, tool_name string, content string, is_error boolean"
SAY = ["no, not this", "undo that please", "this is wrong", "great, thanks", "wrong and broken", "go on", "  ", None, "Actually that is an error", "waste, fail"]


@pytest.fixture(scope="module")
def ordered():
    rng = random.Random(5)
    out, at = [], datetime(2024, 1, 1)
    for i in range(300):
        at += timedelta(seconds=rng.choice([0, 1, 20, 200, 700]))
        said = rng.random() < 0.4
        out.append((rng.randrange(4), i, at, "user" if said else "assistant", None if said else rng.choice(["Bash", "Read", "Edit"]), rng.choice(SAY) if said else None, rng.random() < 0.3))
    return out


def streamed(spark, path, rows, cuts, build, sort="id"):
    """The rows in micro-batches, one file each, through ``build``."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1)
        part.write.parquet(f"{path}/in/{n:03}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    before = spark.conf.get(state.STORE[0], None)
    spark.conf.set(*state.STORE)
    try:
        q = build(files).writeStream.format("memory").queryName(f"q{abs(hash(str(path)))}").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(state.STORE[0]) if before is None else spark.conf.set(state.STORE[0], before)
    return [r.asDict() for r in spark.table(f"q{abs(hash(str(path)))}").orderBy(sort).collect()]


def sequential_prompts(rows, scores):
    seen = defaultdict(lambda: {"c": 0, "u": 0, "s": 0, "r": [], "w": False})
    for s, i, _, role, _, content, _ in rows:
        if role != "user" or not (content or "").strip():
            continue
        low, x = content.strip().lower(), seen[s]
        if any(k in low for k in t.UNDOING):
            x["u"] += 1
        elif low.startswith(t.CORRECTING):
            x["c"] += 1
        x["r"] = [*x["r"], scores[content]][-10:]
        x["s"] = x["s"] + 1 if scores[content] < 0 else 0
        now = x["s"] >= 3 and not x["w"]
        x["w"] = x["w"] or now
        yield {"session_id": s, "id": i, "corrections": x["c"], "undos": x["u"], "streak": x["s"], "recent": x["r"], "frustrated": now}


def sequential_signals(rows, seconds, back):
    said, past = {}, defaultdict(list)
    for s, i, at, _, tool, content, _ in rows:
        if tool is None:
            said[s] = content if content is not None else said.get(s)
            continue
        m = said.get(s)
        if past[s]:
            j, when, other, _ = past[s][-1]
            sign = (
                "correction" if (m or "").strip().lower().startswith(t.PREFIXES)
                else "undo" if other == tool and (at - when).total_seconds() <= seconds
                else "re_invocation" if m is not None and any(y == m and x != tool for _, _, x, y in past[s][-back:]) else None
            )
            if sign:
                yield {"session_id": s, "id": j, "passive_signal": sign}
        past[s].append((i, at, tool, m))


def sequential_feedback(rows, seconds, last):
    shell = defaultdict(list)
    for s, i, at, _, tool, _, error in rows:
        if error:
            newest = next(((j, when) for j, when, search in reversed(shell[s][-last:]) if search), None)
            if newest and (at - newest[1]).total_seconds() <= seconds:
                yield {"session_id": s, "id": i, "search_id": newest[0]}
        if tool in ("Bash", "Read"):
            shell[s].append((i, at, tool == "Bash"))


@pytest.mark.parametrize("cuts", [(), (1, 90, 91, 200), (50, 100, 150, 250)])
def test_any_cut_gives_the_sequential_rows(spark, tmp_path, ordered, cuts):
    texts = spark.createDataFrame([(x,) for x in SAY if x], "content string")
    scores = {r["content"]: r["s"] for r in texts.select("content", t.sentiment(F.col("content")).alias("s")).collect()}
    user = lambda d: state.prompt_state(d.where("role = 'user'"))
    want = list(sequential_prompts(ordered, scores))
    assert streamed(spark, tmp_path / "a", ordered, cuts, user) == want
    assert any(r["frustrated"] for r in want) and len({r["session_id"] for r in want if r["frustrated"]}) == sum(r["frustrated"] for r in want)
    if len(cuts) == 4 and cuts[0] == 1:
        calls = lambda d: state.call_signals(d, 60, 4)
        want = sorted(sequential_signals(ordered, 60, 4), key=lambda r: r["id"])
        assert streamed(spark, tmp_path / "b", ordered, cuts, calls) == want
        assert {r["passive_signal"] for r in want} == {"correction", "undo", "re_invocation"}
        tool = F.col("tool_name")
        feedback = lambda d: state.search_feedback(d, tool.isin("Bash", "Read"), tool == "Bash", F.col("is_error"), 400, 3)
        want = list(sequential_feedback(ordered, 400, 3))
        assert want and streamed(spark, tmp_path / "c", ordered, cuts, feedback) == want


def test_state_ends_with_the_session(spark, tmp_path):
    """A session that says nothing for longer than the state is kept begins anew; rows without instant or behind the watermark are left out."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    row = lambda s, i, n: (s, i, None if n is None else day(n), "user", None, "wrong", False)
    rows = [row(1, 0, 0), row(1, 1, None), row(2, 2, 9), row(2, 3, 10), row(2, 4, 10), row(1, 5, 11), row(2, 6, 11), row(1, 7, 1)]
    got = streamed(spark, tmp_path, rows, (2, 3, 4, 5, 6, 7), state.prompt_state)
    assert [(r["id"], r["streak"], r["frustrated"]) for r in got] == [(0, 1, False), (2, 1, False), (3, 2, False), (4, 3, True), (5, 1, False), (6, 4, False)]


@pytest.mark.parametrize("cuts", [[], [150], [1, 2, 3, 90, 91, 200]])
def test_repeated_calls_are_logged_once_across_batches(spark, tmp_path, ordered, cuts):
    last, want = {}, []
    for s, i, ts, _, tool, _, _ in ordered:
        if tool and not ((s, tool) in last and ts - last[s, tool] < timedelta(seconds=700)):
            last[s, tool] = ts
            want.append({"session_id": s, "id": i, "tool": tool})
    got = streamed(spark, tmp_path, ordered, cuts, lambda d: state.logged_calls(d.withColumnRenamed("tool_name", "tool"), 700))
    assert got == want and 20 < len(want) < sum(r[4] is not None for r in ordered)


def test_logged_within_a_second(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, k, at + timedelta(milliseconds=ms), "assistant", tool, None, False) for k, (ms, tool) in enumerate([(0, "Bash"), (700, "Bash"), (999, "Bash"), (1000, "Bash"), (1400, "Read"), (1900, "Bash"), (2399, "Read"), (2400, None)])]
    got = streamed(spark, tmp_path, rows, [2, 5], lambda d: state.logged_calls(d.withColumnRenamed("tool_name", "tool")))
    assert [r["id"] for r in got] == [0, 3, 4]


def test_a_table_of_several_files_is_streamed(spark, tmp_path):
    """a table may be one file or a folder of files."""
    from sessionloom.plans import live

    talk = spark.createDataFrame([(c, n, "user", f"say {n}") for c in range(6) for n in range(4)], "conv_id long, turn int, role string, text string")
    talk.repartition(3, "conv_id").write.parquet(f"{tmp_path}/folder/conversations.parquet")
    talk.toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = [sorted(tuple(r) for r in live.QUERIES["stream_prompt_state"][0](spark, str(d)).collect()) for d in (tmp_path / "folder", tmp_path)]
    assert got[0] == got[1] and len(got[0]) == len({r[:2] for r in got[0]}) > 0


def test_a_new_session_asks_for_no_timers_and_has_one_only_with_a_state():
    """Rows are stepped through as they are, and the state store is asked no more than it needs to be."""
    from pyspark.sql import Row

    class Kept:
        value, asked = None, 0

        def exists(self):
            return bool(self.value)

        def get(self):
            return iter(self.value)

        def put(self, value):
            self.value = value

    class Handle:
        timers, listed = [], 0

        def getListState(self, *_):
            return Kept()

        def listTimers(self):
            self.listed += 1
            return list(self.timers)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    class Values:
        def getCurrentWatermarkInMs(self):
            return 0

    def row(i, us, shell, feedback):
        return Row(session_id=1, id=i, us=us, at=None, shell=shell, search=shell, feedback=feedback)

    handle, p = Handle(), state.Searches(900, 25)
    p.init(handle)
    assert list(p.handleInputRows((1,), iter([row(1, 10**6, False, True)]), Values())) == [] and handle.timers == []
    got = list(p.handleInputRows((1,), iter([row(3, 3 * 10**6, False, True), row(2, 2 * 10**6, True, False)]), Values()))
    assert [tuple(r) for r in got] == [(1, 3, 2)] and handle.timers == [3000 + state.KEEP_MS] and handle.listed == 0
    assert [tuple(r) for r in p.handleInputRows((1,), iter([row(4, 4 * 10**6, False, True)]), Values())] == [(1, 4, 2)]
    assert handle.timers == [4000 + state.KEEP_MS] and handle.listed == 1
