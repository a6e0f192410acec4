"""Agent stores and markdown transcripts on small files."""

import json
import sqlite3
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sessionloom.sources import agents, markdown, transcripts


def lines(spark, rows, file="file:/r/w/session_1/agents/main/wire.jsonl"):
    return spark.createDataFrame([(file, i + 1, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(rows)], "file string, line int, value string")


def files(spark, text, file):
    return spark.createDataFrame([(file, text, datetime(2024, 1, 2, tzinfo=timezone.utc))], "file string, value string, mtime timestamp")


def short(d, *names):
    return [tuple(r[n] for n in names) for r in d.orderBy("line", "content").collect()]


def at(d):
    return [r[0] for r in d.select(F.unix_micros("ts")).collect()]


def test_kimi(spark):
    d = agents.scan_kimi(lines(spark, [
        {"type": "turn.prompt", "input": [{"type": "text", "text": "a"}, "b"], "origin": {"kind": "user"}, "time": 1704067200123},
        {"type": "context.append_message", "message": {"role": "assistant", "content": "plain"}, "time": "x"},
        {"type": "usage.record"}, "", "{broken", None, "[1]",
    ]))
    assert short(d, "session_id", "role", "content", "line") == [("session_1", "user", "a b", 1), ("session_1", "assistant", "plain", 2)]
    assert at(d) == [1704067200123000, None]


def test_claude_and_search(spark):
    d = agents.scan_claude(lines(spark, [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "Find [x] " + "y" * 3000}},
        {"message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "q"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message": {"content": "[not json"}},
    ], "/p/abc.jsonl"))
    assert short(d, "session_id", "role", "line") == [("abc", "user", 1), ("abc", "assistant", 2), ("abc", "user", 3)]
    got = {r["line"]: r for r in d.collect()}
    assert got[2]["content"] == "one  two" and len(got[1]["content"]) == 2000 and len(got[1]["match_text"]) == 3009 and got[3]["content"] == "[not json"
    assert [r["line"] for r in agents.search(d, "find").collect()] == [1]
    assert [r["line"] for r in agents.search(d, "[").orderBy("line").collect()] == [1, 3], "a broken pattern is plain text"
    assert agents.search(d, "find", case_sensitive=True).count() == 0
    assert agents.search(d, ".", terms=("TWO", "zz")).count() == 1
    assert agents.search(d, ".", per_agent=2).count() == 2


def test_codex_gemini_aider_markdown(spark):
    assert short(agents.scan_codex_history(lines(spark, [{"text": "t", "session_id": "s", "ts": 1704067200}])), "session_id", "role", "content") == [("s", "user", "t")]
    r = agents.scan_codex_rollouts(files(spark, json.dumps({"session": {"timestamp": "2024-01-01T00:00:00+00:00"}, "items": [1]}), "/s/rollout-7.json")).first()
    assert (r["session_id"], r["role"]) == ("rollout-7", "session") and json.loads(r["content"])["items"] == [1]
    g = agents.scan_gemini(files(spark, json.dumps({"sessionId": "g", "projectHash": "h", "messages": [{"type": "gemini", "content": "hi", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "info", "content": [{"a": 1}]}]}), "/g/session-1.json"))
    assert short(g, "session_id", "role", "content") == [("g", "info", '[{"a":1}]'), ("g", "assistant", "hi")]
    a = agents.scan_aider(files(spark, "---\nstart\n#### do it\nanswer\n#### \n", "/dev/repo/.aider.chat.history.md"))
    assert [(x["session_id"], x["role"], x["content"]) for x in a.orderBy("content").collect()] == [("/dev/repo", "mixed", "---\nstart\n"), ("/dev/repo", "user", "do it\nanswer\n")]
    m = agents.scan_markdown_lines(files(spark, "# a\n\nb", "/dev/r/.specstory/history/x.md"))
    assert short(m, "session_id", "content", "line") == [("x", "# a", 1), ("x", "b", 3)]


def test_promptchain(spark):
    rows = [{"role": "user", "content": "c", "timestamp": "1704067200.5", "metadata": "{'model_name': 'm1'}"}, {"content": None, "timestamp": "never"}]
    names = spark.createDataFrame([("u1", "default")], "id string, name string")
    d = agents.scan_promptchain(lines(spark, rows, "/x/u1/messages.jsonl"), names)
    assert short(d, "session_id", "role", "content") == [("default", "user", "c"), ("default", "unknown", "")]
    assert at(d.orderBy("line")) == [1704067200500000, None] and d.orderBy("line").first()["metadata"]["model_name"] == "m1"


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE messages (session_id TEXT, role TEXT, content_json TEXT, created_timestamp INTEGER, message_id TEXT)")
        c.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?)", [("g1", None, json.dumps([{"type": "text", "text": f"m{i}"}]), 1704067200 + i, f"i{i}") for i in range(250)])
        c.execute("CREATE TABLE message (id TEXT, data TEXT)")
        c.execute("CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, data TEXT, time_created INTEGER)")
        c.execute("INSERT INTO message VALUES ('a', ?)", (json.dumps({"role": "user"}),))
        c.executemany("INSERT INTO part VALUES (?, 'a', 'o1', ?, 1704067200000)", [("p1", json.dumps({"type": "text", "text": "hello"})), ("p2", json.dumps({"type": "tool", "text": "no"})), ("p3", "broken")])
        c.execute("CREATE TABLE empty (id INTEGER)")
    spark.dataSource.register(agents.SqliteSource)
    d = spark.read.format("sqlite_table").option("path", path).option("table", "messages").option("rows", "100").load()
    assert d.rdd.getNumPartitions() == 3 and d.count() == 250
    goose = agents.scan_goose(d)
    assert goose.where("role = 'unknown' and content like 'm%'").count() == 250
    code = agents.scan_opencode(agents.read_sqlite(spark, path, "message"), agents.read_sqlite(spark, path, "part"))
    assert short(code, "session_id", "role", "content") == [("o1", "user", "hello")] and at(code) == [1704067200000000]
    assert agents.read_sqlite(spark, path, "empty").count() == 0
    assert agents.fan_in(goose, code).columns == list(agents.RECORDS) and agents.session_events(agents.fan_in(goose, code), "o1").count() == 1


def turns(spark, text):
    d = markdown.turns(spark.createDataFrame([("f", text)], "file string, value string"))
    return [(r["role"], r["content"], [tuple(c) for c in r["tool_calls"]]) for r in d.orderBy("turn").collect()]


def test_separator_dialect(spark):
    text = '**Human:** do\nit\n---\n**Assistant:** ok\n[Tool call: Read with input {"p": "/x"}]\n[Tool output: fine]\n[Tool call: Bash with input {bad]\n[Tool error: boom]\n---\nno role\n'
    got = turns(spark, text)
    assert [(r, c) for r, c, _ in got][0] == ("human", "do\nit") and [g[0] for g in got] == ["human", "assistant"]
    assert got[1][2] == [("Read", '{"p": "/x"}', "fine", None), ("Bash", None, None, "boom")]
    assert turns(spark, "  \n") == [] and turns(spark, None) == [] and turns(spark, "plain words") == []


def test_exporter_dialect(spark):
    text = "_**User**_\n\nplease\n\n---\n\n_**Agent (m)**_\n_**Agent**_\n\nlook\nTool use: **Bash** list files\n`ls -la`\nResult:\n```\na\nb\n```\nTool use: **Read** hint\n```\nError: none\n```\nTool use: **Edit**\n```text\nfine\n```\n"
    got = turns(spark, text)
    assert got[0] == ("human", "please", []) and got[1][1].startswith("look")
    assert got[1][2] == [("Bash", "ls -la", "a\nb", None), ("Read", "hint", None, "Error: none"), ("Edit", None, "fine", None)]


def test_fenced_dialect(spark):
    text = '**Human:** go\n\n**Assistant:** yes\n\n**Tool call: Read**\n```json\n{"a": 1}\n```\n**Read output:**\n```\nout\n```\n\n**Tool call: Bash**\n```json\n{}\n```\n**Bash output (error):**\n```\nbad\n```\n'
    got = turns(spark, text)
    assert got[0] == ("human", "go", []) and got[1][2] == [("Read", '{"a": 1}', "out", None), ("Bash", "{}", None, "bad")]
    flat = markdown.flattened(markdown.turns(spark.createDataFrame([("f", text)], "file string, value string"))).orderBy("turn", "call").collect()
    assert [(r["role"], r["tool_name"]) for r in flat] == [("human", None), ("assistant", None), ("assistant", "Read"), ("assistant", "Bash")]


def test_file_instants(spark):
    d = files(spark, "", "/x/2024-03-04_05-06-07Z-name.md").union(files(spark, "", "/x/other.md"))
    assert [r[0] for r in d.select(markdown.filename_instant(F.col("file")).cast("string")).collect()] == ["2024-03-04 05:06:07", None]
    assert markdown.since(d, "2024-02-01 00:00:00").count() == 1 and markdown.since(d, "2024-01-02 00:00:00").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "messages.jsonl").write_text('{"role": "user", "content": "x"}\n\n{"role": "user", "content": "y"}\n')
    assert short(agents.scan_promptchain(transcripts.read_lines(spark, str(tmp_path), "messages.jsonl")), "session_id", "line") == [("a", 1), ("a", 3)]
    assert agents.read_files(spark, str(tmp_path), "*.jsonl").count() == 1
