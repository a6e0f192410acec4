"""Stores of other agents to one record shape (S34 to S47) and the search over them (Q1 to Q7).

A scan takes lines(file, line, value), files(file, value, mtime) or tables and
gives RECORDS.  ``ts`` is an instant, not text; ``match_text`` is the whole
text that a search looks at, ``content`` its first 2,000 characters.  Broken
JSON, blank lines and nulls give no rows.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = ("agent", "session_id", "ts", "role", "content", "source_path", "metadata", "line", "match_text")
CAP = 2000


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, value, mtime): one row per file, for formats whose unit is the file."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return d.select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_modification_time").alias("mtime"))


def epoch(n: Column) -> Column:
    """Seconds, or milliseconds where the number is over 1e12, to an instant."""
    n = n.cast("double")
    return F.timestamp_micros(F.round(F.when(n > 1e12, n / 1000).otherwise(n) * 1_000_000).cast("long"))


def instant(text: Column) -> Column:
    """Text with Z, an offset or none (then UTC) to an instant; blank or unreadable: null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(F.when(F.trim(text) != "", zoned))


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]+)?$", 1)


def parent(file: Column, n: int) -> Column:
    """Name of the n-th folder above a file."""
    return F.coalesce(F.element_at(F.split(file, "/"), -1 - n), F.lit(""))


def _at(value: Column, path: str) -> Column:
    return F.get_json_object(value, path)


def _spaced(raw: Column) -> Column:
    """Texts of a block array, joined by spaces; any other value as it is."""
    blocks = F.from_json(raw, "array<string>")
    text = F.array_join(F.transform(blocks, lambda b: F.when(F.startswith(b, F.lit("{")), F.coalesce(_at(b, "$.text"), F.lit(""))).otherwise(b)), " ")
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(text, raw)).otherwise(F.coalesce(raw, F.lit("")))


def _read(lines: DataFrame) -> DataFrame:
    return lines.where(F.coalesce(F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull(), F.lit(False)))


def _records(d: DataFrame, agent: str, session: Column, ts: Column, role: Column, text: Column, meta: dict[str, Column], line: Column | None = None, path: Column | None = None) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return d.select(
        F.lit(agent).alias("agent"), session.cast("string").alias("session_id"), ts.alias("ts"), F.coalesce(role, F.lit("unknown")).alias("role"),
        F.substring(text, 1, CAP).alias("content"), (F.col("file") if path is None else path).cast("string").alias("source_path"),
        F.create_map(*pairs).alias("metadata"), (F.lit(None) if line is None else line).cast("int").alias("line"), text.alias("match_text"),
    )


def scan_claude(lines: DataFrame, kind: str = "projects") -> DataFrame:
    """Role from ``type`` or the message; blocks joined by spaces."""
    v = F.col("value")
    return _records(_read(lines), "claude", stem(F.col("file")), instant(_at(v, "$.timestamp")), F.coalesce(_at(v, "$.type"), _at(v, "$.message.role")), _spaced(F.coalesce(_at(v, "$.message.content"), _at(v, "$.content"))), {"source_kind": F.lit(kind)}, F.col("line"))


def scan_markdown_lines(files: DataFrame, agent: str = "claude") -> DataFrame:
    """One record per line that is not blank; the instant is the file's."""
    d = files.where("file like '%/.specstory/%'").select("file", "mtime", F.posexplode(F.split("value", "\r?\n")).alias("_i", "_l")).where(F.trim("_l") != "")
    return _records(d, agent, stem(F.col("file")), F.col("mtime"), F.lit("specstory"), F.col("_l"), {"source_kind": F.lit("specstory")}, F.col("_i") + 1)


def scan_codex_history(lines: DataFrame) -> DataFrame:
    """S41, history: one row per line."""
    v = F.col("value")
    return _records(_read(lines), "codex", F.coalesce(_at(v, "$.session_id"), F.lit("")), epoch(_at(v, "$.ts")), F.lit("user"), F.coalesce(_at(v, "$.text"), F.lit("")), {"store": F.lit("history")}, F.col("line"))


def scan_codex_rollouts(files: DataFrame) -> DataFrame:
    """S41, rollouts: one row per file, its whole JSON as the text."""
    v = F.col("value")
    return _records(_read(files), "codex", stem(F.col("file")), instant(_at(v, "$.session.timestamp")), F.lit("session"), F.to_json(F.try_parse_json(v)), {"store": F.lit("rollout")})


def scan_goose(messages: DataFrame, path: str = "") -> DataFrame:
    """messages(session_id, role, content_json, created_timestamp, message_id), in epoch seconds."""
    return _records(messages, "goose", F.col("session_id"), epoch(F.col("created_timestamp")), F.nullif("role", F.lit("")), _spaced(F.col("content_json")), {"source_kind": F.lit("sqlite"), "message_id": F.col("message_id")}, path=F.lit(path))


def scan_opencode(message: DataFrame, part: DataFrame, path: str = "") -> DataFrame:
    """Text parts of part(id, message_id, session_id, data, time_created) with their message(id, data)."""
    p = part.where(F.coalesce(_at(F.col("data"), "$.type") == "text", F.lit(False)) & (F.coalesce(_at(F.col("data"), "$.text"), F.lit("")) != ""))
    m = message.select(F.col("id").alias("message_id"), F.nullif(_at(F.col("data"), "$.role"), F.lit("")).alias("_role"))
    return _records(p.join(m, "message_id"), "opencode", F.col("session_id"), epoch(F.col("time_created")), F.col("_role"), _at(F.col("data"), "$.text"), {"source_kind": F.lit("sqlite"), "message_id": F.col("id")}, path=F.lit(path))


def scan_gemini(files: DataFrame) -> DataFrame:
    """``messages`` of each file; content that is no string stays JSON."""
    v = F.col("value")
    d = _read(files).select("file", F.coalesce(_at(v, "$.sessionId"), stem(F.col("file"))).alias("_s"), F.coalesce(_at(v, "$.projectHash"), F.lit("")).alias("_p"), F.explode(F.from_json(_at(v, "$.messages"), "array<struct<type:string,content:string,timestamp:string>>")).alias("m"))
    role = F.when(F.col("m.type") == "gemini", "assistant").otherwise(F.col("m.type"))
    return _records(d, "gemini", F.col("_s"), instant(F.col("m.timestamp")), role, F.coalesce("m.content", F.lit("")), {"project_hash": F.col("_p")})


def scan_aider(files: DataFrame) -> DataFrame:
    """Pieces that begin at level-4 headings; the session is the folder."""
    d = files.where("file not like '%/node_modules/%' and file not like '%/.git/%'").select("file", "mtime", F.explode(F.split("value", "(?m)^#### ")).alias("_b")).where(F.col("_b").rlike(r"\S"))
    head, repo = F.regexp_extract("_b", r"^([^\r\n]*)", 1), F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    role = F.when((head != "") & ~F.startswith(head, F.lit("---")), "user").otherwise("mixed")
    return _records(d, "aider", repo, F.col("mtime"), role, F.col("_b"), {"repo": repo})


def scan_promptchain(lines: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Messages.jsonl under a folder per session; sessions(id, name) gives friendly names."""
    v = F.col("value")
    d = _read(lines).withColumn("_id", parent(F.col("file"), 1))
    d = d.withColumn("name", F.lit(None).cast("string")) if sessions is None else d.join(sessions.select(F.col("id").cast("string").alias("_id"), "name").dropDuplicates(["_id"]), "_id", "left")
    model = F.nullif(F.regexp_extract(_at(v, "$.metadata"), r"model_name['\"]?\s*[:=]\s*['\"]([^'\"]+)", 1), F.lit(""))
    return _records(d, "promptchain", F.coalesce("name", "_id"), epoch(F.expr("try_cast(get_json_object(value, '$.timestamp') as double)")), _at(v, "$.role"), F.coalesce(_at(v, "$.content"), F.lit("")), {"uuid": F.col("_id"), "session_name": F.coalesce("name", F.lit("")), "model_name": model}, F.col("line"))


def scan_kimi(lines: DataFrame) -> DataFrame:
    """Appended messages and turn prompts; the session is the third folder above."""
    v = F.col("value")
    d = _read(lines).withColumn("_t", _at(v, "$.type")).where(F.col("_t").isin("context.append_message", "turn.prompt"))
    said = F.col("_t") == "turn.prompt"
    role = F.when(said, F.coalesce(F.nullif(_at(v, "$.origin.kind"), F.lit("")), F.lit("user"))).otherwise(F.nullif(_at(v, "$.message.role"), F.lit("")))
    text = F.when(said, _spaced(_at(v, "$.input"))).otherwise(_spaced(_at(v, "$.message.content")))
    ms = F.expr("try_cast(get_json_object(value, '$.time') as long)")
    return _records(d, "kimi", parent(F.col("file"), 3), F.timestamp_millis(ms), role, text, {"agent_dir": parent(F.col("file"), 1), "source_kind": F.lit("kimi")}, F.col("line"))


#: Parsers by agent name; what each takes is in its docstring.
SCANS = {
    "claude": scan_claude, "codex": scan_codex_history, "goose": scan_goose, "opencode": scan_opencode, "gemini": scan_gemini,
    "aider": scan_aider, "promptchain": scan_promptchain, "kimi": scan_kimi,
}


def fan_in(*records: DataFrame) -> DataFrame:
    """S34."""
    out = records[0].select(*RECORDS)
    for r in records[1:]:
        out = out.unionByName(r.select(*RECORDS))
    return out


def matching(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Q1: a regular expression over Unicode classes; one that does not compile is taken as plain text."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return F.coalesce(text.rlike(f"(?U){pattern}" if case_sensitive else f"(?iU){pattern}"), F.lit(False))


def search(records: DataFrame, pattern: str, terms: tuple[str, ...] = (), case_sensitive: bool = False, per_agent: int | None = None) -> DataFrame:
    """Q3, Q4: records that match; any of ``terms`` as well, if given; ``per_agent``: the newest of each agent."""
    d = records.where(matching(F.col("match_text"), pattern, case_sensitive))
    if terms:
        d = d.where(F.lower("match_text").rlike("|".join(re.escape(w.lower()) for w in terms)))
    if per_agent is not None:
        w = Window.partitionBy("agent").orderBy(F.col("ts").desc_nulls_last(), "session_id", "line")
        d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_agent).drop("_n")
    return d


def session_events(records: DataFrame, session: str, since: str | None = None) -> DataFrame:
    """What an adapter gives for one session, in order of time."""
    d = records.where(F.col("session_id") == session)
    return (d.where(F.col("ts") > instant(F.lit(since))) if since else d).orderBy("ts", "line")


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Tables of SQLite files (S42, S43, S46): options ``path``, ``table``, ``rows`` (row ids a partition).

    The file is opened read-only, by tasks as well, so it must lie in a folder that they share.
    """

    TYPES = {"INT": "long", "CHAR": "string", "TEXT": "string", "CLOB": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _connected(self.options["path"]) as c:
            cols = c.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` " + next((t for k, t in self.TYPES.items() if k in (kind or "").upper()), "string") for n, kind in cols)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.rows = options["path"], int(options.get("rows", "100000"))
        self.table = '"' + options["table"].replace('"', '""') + '"'
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[_Rows]:
        with _connected(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [_Rows(0, -1)] if low is None else [_Rows(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        cast = {"string": str, "bigint": int, "double": float, "binary": bytes}
        names = ", ".join('"' + n.replace('"', '""') + '"' for n, _ in self.fields)
        with _connected(self.path) as c:
            for row in c.execute(f"SELECT {names} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(None if v is None else cast[t](v) for v, (_, t) in zip(row, self.fields))


class _connected:
    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> sqlite3.Connection:
        self.connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        return self.connection

    def __exit__(self, *_) -> None:
        self.connection.close()


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).load()
