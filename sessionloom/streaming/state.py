"""What live sessions remember: prompts, tool calls and searches, as keyed state.

Each processor steps through a session's rows in the order of (ts, id) within
a micro-batch, and from batch to batch as they come, so any cut of an ordered
stream into micro-batches gives the same rows.  Expressions of texts (kinds,
scores) are computed before, in columns; the state holds numbers, the last few
calls and the last message.

Defined cases: a row that comes after later ones is taken when it comes, as a
hook would; one behind the watermark is left out; rows without an instant or
session are left out.  A session's state is cleared once the watermark is
``KEEP_MS`` past its last row; it begins anew after that.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionloom.functions import text as t
from sessionloom.operators.signals import acting

#: How long the state of a session that says nothing more is kept.
KEEP_MS = 7 * 24 * 3600 * 1000
#: The state store that these processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PerSession(StatefulProcessor):
    """State of a session, its timer, and rows for what happens in it."""

    #: Columns of the rows given out, after session_id.
    out: tuple[str, ...] = ()
    take = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = [handle.getValueState(n, s) if one else handle.getListState(n, s) for n, s, one in self.kept()]

    def kept(self) -> list[tuple[str, str, bool]]:
        """(name, schema, one value or a list) of each state."""
        raise NotImplementedError

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        """Rows of one session in order -> rows given out; reads the states of a known session and writes them once."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        known = self.states[0].exists()
        self.take = self.take or namedtuple("Taken", rows[0].__fields__)._make
        rows = sorted(map(self.take, rows), key=lambda r: (r.us, r.id is None, r.id or 0))
        give = Row("session_id", *self.out)
        for got in list(self.step(iter(rows), known)):
            yield give(key[0], *got)
        # A session has a timer if it has a state, and only then.
        for timer in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(timer)
        if known or self.states[0].exists():
            self.handle.registerTimer(max(rows[-1].us // 1000, timerValues.getCurrentWatermarkInMs()) + KEEP_MS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for s in self.states:
            s.clear()
        return iter([])

    def close(self) -> None:
        pass


def per_session(stream: DataFrame, processor: PerSession, columns: list[str], out: str, late: str, mode: str = "append") -> DataFrame:
    """stream(session_id, id, ts, columns) through a processor; ``out`` is its schema after session_id."""
    d = stream.withColumn("at", F.col("ts").cast("timestamp")).where(F.col("at").isNotNull() & F.col("session_id").isNotNull()).withWatermark("at", late)
    d = d.select("session_id", "id", F.unix_micros("at").alias("us"), "at", *columns)
    return d.groupBy("session_id").transformWithState(processor, f"session_id long, {out}", mode, "EventTime")


class Prompts(PerSession):
    """Corrections, undos, the last ten scores, negative messages in a row, and one warning for the third of them."""

    out = ("id", "corrections", "undos", "streak", "recent", "frustrated")
    RECENT, STREAK = 10, 3

    def kept(self) -> list[tuple[str, str, bool]]:
        return [("counts", "corrections long, undos long, streak long, warned boolean", True), ("scores", "score double", False)]

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        counts, scores = self.states
        corrections, undos, streak, warned = counts.get() if known else (0, 0, 0, False)
        recent = [x[0] for x in scores.get()] if known else []
        for r in rows:
            corrections, undos = corrections + (r.kind == "correction"), undos + (r.kind == "undo")
            recent = [*recent, float(r.score)][-self.RECENT :]
            streak = streak + 1 if r.score < 0 else 0
            now = streak >= self.STREAK and not warned
            warned = warned or now
            yield r.id, corrections, undos, streak, recent, now
        counts.update((corrections, undos, streak, warned))
        scores.put([(x,) for x in recent])


def prompt_state(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """messages(session_id, id, ts, content) of users -> the state after each that isn't blank."""
    said = messages.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    said = said.withColumn("kind", acting(F.col("content"))).withColumn("score", t.sentiment(F.col("content")))
    return per_session(said, Prompts(), ["kind", "score"], "id long, corrections long, undos long, streak long, recent array<double>, frustrated boolean", late)


class Calls(PerSession):
    """What a call says of the call before it."""

    out = ("id", "passive_signal")

    def __init__(self, seconds: int, back: int):
        self.seconds, self.back = seconds, back

    def kept(self) -> list[tuple[str, str, bool]]:
        return [("said", "message string, corrects boolean", True), ("calls", "id long, us long, tool string, message string", False)]

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        said, calls = self.states
        message, corrects = said.get() if known else (None, False)
        past = list(calls.get()) if known and calls.exists() else []
        for r in rows:
            if r.tool_name is None:
                if r.said is not None:
                    message, corrects = r.said, bool(r.corrects)
                continue
            if past:
                signal = self.signal(r, message, corrects, past)
                if signal:
                    yield past[-1][0], signal
            past = [*past, (r.id, r.us, r.tool_name, message)][-self.back :]
        said.update((message, corrects))
        if past:
            calls.put(past)

    def signal(self, r: tuple, message: str | None, corrects: bool, past: list[tuple]) -> str | None:
        _, us, tool, _ = past[-1]
        if corrects:
            return "correction"
        if tool == r.tool_name and r.us - us <= self.seconds * 1_000_000:
            return "undo"
        return "re_invocation" if message is not None and any(m == message and x != r.tool_name for _, _, x, m in past) else None


def call_signals(trace: DataFrame, seconds: int = 30, back: int = 4, late: str = "1 hour") -> DataFrame:
    """trace(session_id, id, ts, role, tool_name, content) -> (session_id, id, passive_signal) of each call that the next one says something of.

    A call's message is the last one the user wrote before it.
    """
    said = F.when((F.col("role") == "user") & F.col("tool_name").isNull(), F.col("content"))
    d = trace.withColumn("said", said).withColumn("corrects", t.starts_with_any(F.lower(F.trim(F.coalesce("said", F.lit("")))), t.PREFIXES))
    return per_session(d, Calls(seconds, back), ["tool_name", "said", "corrects"], "id long, passive_signal string", late)


class Searches(PerSession):
    """The newest search among the last shell calls when feedback comes."""

    out = ("id", "search_id")

    def __init__(self, seconds: int, last: int):
        self.seconds, self.last = seconds, last

    def kept(self) -> list[tuple[str, str, bool]]:
        return [("shell", "id long, us long, search boolean", False)]

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        (shell,) = self.states
        past = list(shell.get()) if known else []
        for r in rows:
            if r.feedback:
                newest = next(((i, us) for i, us, search in reversed(past) if search), None)
                if newest and r.us - newest[1] <= self.seconds * 1_000_000:
                    yield r.id, newest[0]
            if r.shell:
                past = [*past, (r.id, r.us, bool(r.search))][-self.last :]
        if past:
            shell.put(past)


def search_feedback(stream: DataFrame, shell, search, feedback, seconds: int = 900, last: int = 25, late: str = "1 hour") -> DataFrame:
    """Each feedback row with the newest search among the ``last`` shell calls before it, at most ``seconds`` old."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    d = stream.withColumns({"shell": flag(shell), "search": flag(shell & search), "feedback": flag(feedback)})
    return per_session(d, Searches(seconds, last), ["shell", "search", "feedback"], "id long, search_id long", late)


class Logged(PerSession):
    """Calls that are logged: none of the same tool was logged within the time before."""

    out = ("id", "tool")

    def __init__(self, micros: int):
        self.micros = micros

    def kept(self) -> list[tuple[str, str, bool]]:
        return [("logged", "tool string, us long", False)]

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        (logged,) = self.states
        last = dict(logged.get()) if known else {}
        for r in rows:
            if r.tool is None or (r.tool in last and abs(r.us - last[r.tool]) < self.micros):
                continue
            last[r.tool] = max(r.us, last.get(r.tool, r.us))
            yield r.id, r.tool
        if last:
            logged.put(list(last.items()))


def logged_calls(stream: DataFrame, seconds: float = 1.0, late: str = "1 hour") -> DataFrame:
    """stream(session_id, id, ts, tool) without calls that repeat a logged one of their session and tool in under ``seconds``.

    A call that is left out keeps no later one out.  One that comes late is held against the newest logged call alone; rows without a
    tool are left out.  The state has one instant for each tool of a session.
    """
    return per_session(stream, Logged(round(seconds * 1_000_000)), ["tool"], "id long, tool string", late)


class Counts(PerSession):
    """Running counts of a session and its longest row of errors."""

    out = ("events", "errors", "longest")

    def kept(self) -> list[tuple[str, str, bool]]:
        return [("counts", "events long, errors long, streak long, longest long", True)]

    def step(self, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        (counts,) = self.states
        events, errors, streak, longest = counts.get() if known else (0, 0, 0, 0)
        for r in rows:
            streak = streak + 1 if r.is_error else 0
            events, errors, longest = events + 1, errors + bool(r.is_error), max(longest, streak)
        counts.update((events, errors, streak, longest))
        yield events, errors, longest


def session_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each session that a micro-batch touches."""
    return per_session(stream, Counts(), ["is_error"], "events long, errors long, longest long", late, "update")
