"""Markdown transcripts to messages: three dialects, parsed with expressions over files(file, value).

Each file is cut into turns (an array), each turn into tool calls (an array),
so nothing is shuffled.  A turn without a role, a blank file and a null give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of the dialects.
SEPARATOR = r"(?m)^---\s*$"
ROLE = r"(?mi)^\*\*(Human|Assistant):\*\*\s*"
USER_TOP = r"(?mi)\A_\*\*User\*\*_\s*$"
AGENT_TOP = r"(?mi)\A_\*\*Agent\s*(?:\([^)]*\))?\*\*_\s*$"
TOOL_LINE = r"(?mi)^\s*Tool use:\s*\*\*(\w+)\*\*"
CALL = "struct<tool_name:string,tool_input:string,tool_output:string,error:string>"


def dialect(raw: Column) -> Column:
    """Exporter, separator or fenced; null for blank texts."""
    blank = F.coalesce(F.trim(raw, F.lit(" \t\r\n")), F.lit("")) == ""
    exporter = raw.rlike(r"(?m)^_\*\*(User\*\*_|Agent)")
    return F.when(blank, F.lit(None)).when(exporter, "exporter").when(raw.rlike(SEPARATOR) | F.contains(raw, F.lit("[Tool call:")), "separator").otherwise("fenced")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _call(name: Column, given: Column, output: Column, error: Column) -> Column:
    return F.struct(name.alias("tool_name"), given.alias("tool_input"), output.alias("tool_output"), error.alias("error")).cast(CALL)


def _last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _pieces(text: Column, ahead: str) -> Column:
    """The text from each place where ``ahead`` matches to the next; what comes before the first goes."""
    return F.filter(F.split(text, f"(?=(?m:{ahead}))"), lambda p: p.rlike(rf"\A{ahead}"))


def bracket_calls(text: Column) -> Column:
    """``[Tool call: Name with input JSON]`` with the output and error tokens up to the next call."""

    def one(p: Column) -> Column:
        body = F.regexp_extract(p, r"(?s)\A\[Tool call:\s*(.*?)\]", 1)
        name, given = F.regexp_extract(body, r"(?s)\A(\S+)\s+with\s+input\s+(.+)\z", 1), _strip(F.regexp_extract(body, r"(?s)\A(\S+)\s+with\s+input\s+(.+)\z", 2))
        token = lambda k: _last(F.regexp_extract_all(p, F.lit(rf"(?s)\[Tool {k}:\s*(.*?)\]"), 1))
        return _call(name, F.when(F.try_parse_json(given).isNotNull(), given), token("output"), token("error"))

    return F.filter(F.transform(_pieces(text, r"\[Tool call:"), one), lambda c: c["tool_name"] != "")


def exporter_calls(text: Column) -> Column:
    """``Tool use: **Name** hint``, inline code as input, labelled or plain fences as output and error."""
    fence = r"(?ms)(?:^[ \t]*(Result|Error):[^\n]*\n\s*)?^[ \t]*```[^\n]*\n(.*?)^[ \t]*```[ \t]*$"

    def one(p: Column) -> Column:
        blocks = F.arrays_zip(F.regexp_extract_all(p, F.lit(f"(?i){fence}"), 1).alias("k"), F.regexp_extract_all(p, F.lit(f"(?i){fence}"), 2).alias("b"))
        blocks = F.transform(blocks, lambda x: F.struct(F.lower(x["k"]).alias("k"), F.regexp_replace(x["b"], r"\n\z", "").alias("b")))
        bad = lambda x: (x["k"] == "error") | ((x["k"] == "") & (F.contains(x["b"], F.lit("Exit code 1")) | F.contains(F.substring(x["b"], 1, 50), F.lit("Error"))))
        plain = F.filter(blocks, lambda x: ~bad(x) & (x["k"] == "") & (x["b"] != ""))
        output = F.coalesce(_last(F.filter(blocks, lambda x: x["k"] == "result"))["b"], F.get(plain, 0)["b"])
        bare = F.regexp_replace(p, f"(?i){fence}", "")
        given = F.coalesce(_last(F.regexp_extract_all(bare, F.lit(r"(?m)^[ \t]*`+([^`\n]+)`+[ \t]*$"), 1)), _some(F.trim(F.regexp_extract(bare, TOOL_LINE + r"([^\n]*)", 2))))
        return _call(F.regexp_extract(p, TOOL_LINE, 1), given, output, _last(F.filter(blocks, bad))["b"])

    return F.transform(_pieces(text, r"(?i:[ \t]*Tool use:\s*\*\*\w+\*\*)"), one)


def fenced_calls(text: Column) -> Column:
    """``**Tool call: Name**`` headers with fences; an output header may say ``(error)``."""

    def block(p: Column, header: str) -> Column:
        return F.regexp_replace(F.regexp_extract(p, rf"(?msi){header}\s*\n\s*```[^\n]*\n(.*?)^\s*```", 1), r"\n\z", "")

    def one(p: Column) -> Column:
        name = F.trim(F.regexp_extract(p, r"(?i)\A\s*\*\*Tool call:\s*([^*]+?)\*\*", 1))
        out, err = block(p, r"^\s*\*\*[^*\n]+?\s+output(?!\s*\(error\))[^:*\n]*:\*\*"), block(p, r"^\s*\*\*[^*\n]+?\s+output\s*\(error\)[^:*\n]*:\*\*")
        return _call(name, _some(block(p, r"\A\s*\*\*Tool call:[^*\n]*\*\*")), _some(out), _some(err))

    return F.transform(_pieces(text, r"(?i:[ \t]*\*\*Tool call:\s*[^*\n]+\*\*)"), one)


def turns(files: DataFrame) -> DataFrame:
    """(file, value) -> (file, turn, role, content, tool_calls); roles are ``human`` and ``assistant``."""
    raw = F.col("value")
    d = files.withColumn("_d", dialect(raw)).where("_d is not null")
    cut = F.when(F.col("_d") == "fenced", _pieces(raw, r"(?i:\*\*(?:Human|Assistant):\*\*)")).otherwise(F.split(raw, SEPARATOR))
    d = d.select("file", "_d", F.posexplode(cut).alias("turn", "_t")).withColumn("_t", _strip(F.col("_t"))).where("_t <> ''")
    # Exporter: role lines may repeat at the top; the content begins after the last of them.
    user, agent = F.col("_t").rlike(USER_TOP), F.col("_t").rlike(AGENT_TOP)
    legacy = F.lower(F.regexp_extract("_t", ROLE, 1))
    role = F.when((F.col("_d") == "exporter") & user, "human").when((F.col("_d") == "exporter") & agent, "assistant").when(legacy != "", legacy)
    tops = F.regexp_replace("_t", r"(?i)\A(?:_\*\*(?:User|Agent\s*(?:\([^)]*\))?)\*\*_\s*)+", "")
    after = F.regexp_replace(F.regexp_replace("_t", r"(?s)\A.*?(?=(?m:^\*\*(?i:Human|Assistant):\*\*))", ""), r"(?i)\A\*\*(?:Human|Assistant):\*\*\s*", "")
    body = F.when((F.col("_d") == "exporter") & (user | agent), tops).otherwise(after)
    d = d.withColumn("role", role).where("role is not null").withColumn("content", _strip(body))
    calls = F.when(F.col("_d") == "exporter", exporter_calls(F.col("content"))).when(F.col("_d") == "separator", bracket_calls(F.col("content"))).otherwise(fenced_calls(F.col("content")))
    return d.select("file", "turn", "role", "content", calls.alias("tool_calls"))


def flattened(blocks: DataFrame) -> DataFrame:
    """The turn's own row (call -1), then one row for each tool call."""
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit(-1).alias("call"), _call(none, none, none, none).alias("c")))
    each = F.transform("tool_calls", lambda c, i: F.struct(i.alias("call"), c.alias("c")))
    d = blocks.select("file", "turn", "role", "content", F.explode(F.concat(own, F.coalesce(each, F.array().cast(f"array<struct<call:int,c:{CALL}>>")))).alias("x"))
    return d.select("file", "turn", F.col("x.call").alias("call"), F.when(F.col("x.call") < 0, F.col("role")).otherwise("assistant").alias("role"), F.when(F.col("x.call") < 0, F.col("content")).alias("content"), "x.c.*")


def filename_instant(file: Column) -> Column:
    """The instant in ``YYYY-MM-DD_HH-MM-SSZ-…``; null for other names."""
    p = r"(?:^|/)(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})Z[^/]*$"
    g = [F.regexp_extract(file, p, i) for i in (1, 2, 3, 4)]
    return F.try_to_timestamp(F.when(g[0] != "", F.concat(g[0], F.lit("T"), g[1], F.lit(":"), g[2], F.lit(":"), g[3], F.lit("Z"))))


def since(files: DataFrame, cutoff: str) -> DataFrame:
    """Files at or after ``cutoff`` by the instant in the name, else by mtime."""
    return files.where(F.coalesce(filename_instant(F.col("file")), F.col("mtime")) >= F.to_timestamp(F.lit(cutoff)))
