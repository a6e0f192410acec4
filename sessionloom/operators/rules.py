"""Rules in instruction files: their lines, key terms, and the error records that go against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMPERATIVE = r"(?i)\b(?:never|always|must|do\s+not)\b"
PASSED_OVER = r"^\s*$|^\s*#+\s|^\s*<!--|^\s*-->|^\s*```"
REMINDER = r"(?is)<system-reminder>.*?</system-reminder>"
# Compounds that are looked for, and words that tell nothing: function words first, then words of rules, sessions and failures.
COMPOUNDS = (r"SELECT\s+\*", r"git\s+push\s+--force", r"git\s+reset\s+--hard", r"absolute\s+paths?", r"relative\s+paths?", r"type\s+hints?", r"error\s+handling", r"unused\s+imports?")
FUNCTION_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could must need not never always and or but if then else when where what which who how "
    "that this it its in on at to for of with by from as into through during before after above below up down out off over under again further than too very just about all any each every both few "
    "more most other some such no nor only same so also use using"
).split()
RULE_WORDS = (
    "rule rules blocking mandatory required optional origin note notes warning warnings exception exemption exceptions exemptions trigger triggers triggered triggering "
    "fire fires firing fired block blocks blocked fail fails failed failing failure failures error errors errored call calls called calling run runs running ran stop stops stopping stopped "
    "start starts starting started skip skips skipping skipped drop drops dropping dropped retry retries retrying retried loop loops looping looped violation violations violated violating "
    "you your yours i me my we our us they them their tool tools agent agents user users claude session sessions time times once twice first second third next last previous new old see via per etc"
).split()
STOP_WORDS = (*FUNCTION_WORDS, *RULE_WORDS)
FIELDS = ("error_text", "user_message", "context_before", "context_after", "tool_input", "tool_output")


def parsed(files: DataFrame) -> DataFrame:
    """V1: files(path, text) -> the lines that order something, outside fences: path, line_number, rule."""
    d = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line_number", F.col("pos") + 1)
    fence = F.startswith(F.ltrim("line"), F.lit("```"))
    d = d.withColumn("_fence", fence).withColumn("_open", F.sum(F.col("_fence").cast("int")).over(Window.partitionBy("path").orderBy("pos")) % 2)
    d = d.where((F.col("_open") == 0) & ~F.col("_fence") & ~F.col("line").rlike(PASSED_OVER) & F.col("line").rlike(IMPERATIVE))
    rule = F.trim("line")
    for pattern, by in ((r"^[-*]\s+", ""), (r"^\d+\.\s+", ""), (r"\*{1,2}(.+?)\*{1,2}", "$1")):
        rule = F.regexp_replace(rule, pattern, by)
    return d.select("path", "line_number", F.trim(rule).alias("rule")).where("rule <> ''")


def key_terms(rule: Column) -> Column:
    """V2: quoted terms, known compounds, then words that tell something, each with its other number."""
    quoted = F.filter(F.transform(F.regexp_extract_all(rule, F.lit('["`]([^"`]+)["`]'), 1), F.trim), lambda x: F.length(x) >= 2)
    compounds = F.filter(F.array(*[F.regexp_extract(rule, f"(?i){p}", 0) for p in COMPOUNDS]), lambda x: x != "")
    words = F.filter(F.transform(F.regexp_extract_all(rule, F.lit(r"[A-Za-z_*]+(?:\s*\*)?"), 0), lambda w: F.trim(F.lower(w))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    both = lambda w: F.when(F.endswith(w, F.lit("s")), F.when(F.length(w) >= 4, F.array(w, F.substring(w, 1, F.length(w) - 1))).otherwise(F.array(w))).otherwise(F.array(w, F.concat(w, F.lit("s"))))
    return F.concat(quoted, compounds, F.flatten(F.transform(words, both)))


def with_terms(rules: DataFrame) -> DataFrame:
    """Different rule texts with their plain words, their compounds and how many different words make a hit."""
    d = rules.select("rule").distinct().withColumn("_terms", F.array_distinct(F.transform(key_terms(F.col("rule")), F.lower)))
    content = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("rule", F.lit(r"\b[A-Za-z]{3,}\b"), 0), F.lower), lambda w: ~w.isin(*STOP_WORDS)))
    plain = F.filter("_terms", lambda x: x.rlike(r"^\w+$"))
    return d.select("rule", plain.alias("words"), F.array_except("_terms", plain).alias("compounds"), F.when(F.size(content) <= 3, 1).otherwise(2).alias("least"))


def violations(rules: DataFrame, errors: DataFrame) -> DataFrame:
    """V3: with_terms(rules) against errors(id, fields) -> (rule, id).

    Words meet as equal tokens.  A compound, which may begin anywhere in a word, meets the texts that hold its first
    characters, and only these are searched for it: both are equi-joins, whatever the number of rules.
    """
    texts = F.concat_ws(" ", *[F.nullif(F.regexp_replace(f, REMINDER, ""), F.lit("")) for f in FIELDS])
    e = errors.select("id", F.lower(texts).alias("text"))
    tokens = e.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), 0))).alias("word"))
    words = rules.select("rule", "least", F.explode("words").alias("word"))
    by_word = tokens.join(words, "word").groupBy("rule", "id").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("rule", "id")
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))
    compounds = rules.select("rule", F.explode("compounds").alias("term")).withColumn("head", F.substring("term", 1, 3))
    heads = compounds.agg(F.collect_set("head").alias("_heads"))  # one row: the beginnings of the compounds in force
    begun = e.crossJoin(F.broadcast(heads)).select("id", F.explode(F.array_intersect(F.concat(parts(2), parts(3)), F.col("_heads"))).alias("head"))
    by_compound = begun.join(compounds, "head").select("id", "rule", "term").join(e, "id").where(F.contains("text", F.col("term"))).select("rule", "id")
    return by_word.union(by_compound).distinct()


def report(rules: DataFrame, found: DataFrame, errors: DataFrame) -> DataFrame:
    """V4 over parsed rules: hits, last seen and sessions of each rule; rules without a hit have 0."""
    d = found.join(errors.select("id", "session_id", "ts"), "id").groupBy("rule").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"), F.count_distinct("session_id").alias("sessions"))
    return rules.select("rule").join(d, "rule", "left").select("rule", F.coalesce("hits", F.lit(0)).alias("hits"), "last_seen", F.coalesce("sessions", F.lit(0)).alias("sessions"))
