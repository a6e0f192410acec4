"""Rule texts, gold examples, registries, feedback, costs and review lists."""

from __future__ import annotations

import difflib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sessionloom.operators.similarity import all_duplicate_pairs
from sessionloom.operators.store import stored

# Words and routes of the quality score.
VERBS = ("run", "check", "verify", "add", "remove", "configure", "set", "use", "install", "create", "delete")
ROUTES = {
    "tool_failure": ("claude_md_rule", "skill_update"), "user_correction": ("claude_md_rule", "agent_profile"), "agent_admission": ("claude_md_rule",),
    "repeated_attempt": ("claude_md_rule", "hook_config"), "undo": ("claude_md_rule", "settings_config"),
}
PATHS = r"(/[\w.\-]+)+|[\w.\-]+\.(py|js|ts|json|yaml|yml|md|sh|toml|cfg|ini)"


def rule_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_line, n_lines, block): blocks end at blank lines and before headings."""
    lines = docs.select(doc_id, F.posexplode(F.split(text, "\r?\n")).alias("i", "line"))
    w = Window.partitionBy(doc_id).orderBy("i")
    blank, head = F.trim("line") == "", F.ltrim("line").rlike(r"^#{1,6}\s")
    starts = ~F.col("_blank") & (F.lag("_blank", 1, True).over(w) | F.col("_head"))
    d = lines.withColumn("_blank", blank).withColumn("_head", head).withColumn("_b", F.sum(starts.cast("int")).over(w)).where("not _blank")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return d.groupBy(doc_id, "_b").agg((F.min("i") + 1).alias("start_line"), F.count("*").alias("n_lines"), block.alias("block")).drop("_b")


def line_budget(files: DataFrame, text: str, new_lines: int, cap: int) -> DataFrame:
    """V6: lines that are not blank outside comments; ok if the new ones fit, blocked at the cap, else consolidate."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)<!--.*?-->", "")
    n = F.size(F.filter(F.split(bare, "\r?\n"), lambda x: x.rlike(r"\S"))).cast("long")
    return files.withColumn("n_lines", n).withColumn("status", F.when(n + new_lines <= cap, "ok").when(n >= cap, "blocked").otherwise("consolidate"))


def merged_text(a: Column, b: Column) -> Column:
    """C11: the longer text (the first, if even), then the lines of the other that it lacks."""
    base, other = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    have = F.transform(F.split(base, "\n"), lambda x: F.trim(x))
    extra = F.filter(F.split(other, "\n"), lambda x: (F.trim(x) != "") & ~F.array_contains(have, F.trim(x)))
    return F.when(F.size(extra) > 0, F.concat(base, F.lit("\n"), F.array_join(extra, "\n"))).otherwise(base)


def _bag(text: str, width: int = 256) -> np.ndarray:
    """Counts of a text's words by hash: whole numbers, so that their products are exact in any order."""
    v = np.zeros(width)
    for w in text.lower().split():
        v[zlib.crc32(w.encode()) % width] += 1
    return v


class _Best:
    """For each block that is left the nearest later one; after a merge only rows that it touches are looked at again."""

    def __init__(self, vectors: np.ndarray, rows: int = 512):
        self.v, n = vectors, len(vectors)
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.score, self.at, self.left = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
        for low in range(0, n, rows):
            near = self.near(slice(low, low + rows), slice(low, n))
            near[np.tril_indices(len(near), 0, near.shape[1])] = -1.0
            self.score[low : low + rows], self.at[low : low + rows] = near.max(axis=1), near.argmax(axis=1) + low

    def near(self, rows: slice, others: slice) -> np.ndarray:
        """Cosines; blocks that are gone are at -1, those without words at 0."""
        by = self.length[rows, None] * self.length[others]
        cosines = np.divide(self.v[rows] @ self.v[others].T, by, out=np.zeros_like(by), where=by > 0)
        return np.where(self.left[others], cosines, -1.0)

    def row(self, i: int) -> None:
        later = self.near(slice(i, i + 1), slice(i + 1, len(self.v)))[0]
        self.score[i], self.at[i] = (later.max(), later.argmax() + i + 1) if len(later) else (-1.0, i)

    def merged(self, keep: int, drop: int, vector: np.ndarray) -> None:
        self.v[keep], self.length[keep] = vector, np.sqrt((vector * vector).sum())
        self.left[drop], self.score[drop] = False, -1.0
        for i in np.flatnonzero(self.left & ((self.at == keep) | (self.at == drop))):
            self.row(i)
        self.row(keep)
        now = self.near(slice(keep, keep + 1), slice(0, keep))[0]
        better = (now > self.score[:keep]) | ((now == self.score[:keep]) & (keep < self.at[:keep]))
        better &= self.left[:keep]
        self.score[:keep][better], self.at[:keep][better] = now[better], keep


def consolidated(blocks: DataFrame, file: str, least: float) -> DataFrame:
    """(file, id, text): the most similar pair at ``least`` or more is merged until none is left.

    Sequential by definition, as a merged block may be nearer to others than its parts were, so each file is a group of its own: its texts
    and 256 numbers for each of its blocks lie in one task, never its pairs.  The vectors are hashed word counts.  Ties: the first pair in the
    order of ids.  Null texts are empty and near to none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, texts = list(pdf["id"]), [t or "" for t in pdf["text"]]
        best = _Best(np.stack([_bag(t) for t in texts]))
        while best.score.max() >= least:
            i = int(best.score.argmax())
            j = int(best.at[i])
            keep, drop = (i, j) if len(texts[i]) >= len(texts[j]) else (j, i)
            have = set(texts[keep].split("\n"))
            texts[keep] = "\n".join([texts[keep], *(x for x in texts[drop].split("\n") if x.strip() and x not in have)])
            best.merged(keep, drop, _bag(texts[keep]))
        left = np.flatnonzero(best.left)
        return pd.DataFrame({file: [pdf[file].iloc[0]] * len(left), "id": [ids[k] for k in left], "text": [texts[k] for k in left]})

    kind = dict(blocks.dtypes)
    return blocks.select(file, "id", "text").groupBy(file).applyInPandas(run, f"{file} {kind[file]}, id long, text string")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the matching blocks of two texts; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=True).ratio() for x, y in zip(a, b)], dtype="float64")


def drift(pairs: DataFrame, collide: float = 0.85, approve: float = 0.40) -> DataFrame:
    """pairs(a, b) + ratio, collision (ratio >= ``collide``), needs_approval (1 - ratio >= ``approve``)."""
    d = pairs.withColumn("ratio", sequence_ratio("a", "b"))
    return d.withColumn("collision", F.col("ratio") >= collide).withColumn("needs_approval", 1 - F.col("ratio") >= approve)


def with_next(messages: DataFrame) -> DataFrame:
    """Each message with the content of the next one of its session."""
    w = Window.partitionBy("session_id").orderBy("idx")
    return messages.withColumn("next_content", F.lead("content").over(w)).withColumn("next_role", F.lead("role").over(w))


def gold(invocations: DataFrame) -> DataFrame:
    """Satisfied and with a correct outcome, the first row of each invocation."""
    return invocations.where("user_satisfied = 1 and correct_outcome = 1").groupBy("invocation").agg(F.min_by(F.struct("id", "message"), "id").alias("_f")).select("invocation", "_f.*")


def gold_replay(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """pairs(gold, prompt): share of the gold's terms that the prompt holds; no terms pass."""
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    n, same = F.size(terms(F.col("gold"))), F.size(F.array_intersect(terms(F.col("gold")), terms(F.col("prompt"))))
    return pairs.withColumn("overlap", F.when(n > 0, same / n)).withColumn("passes", F.coalesce(F.col("overlap") >= least, F.lit(True)))


def quality(pairs: DataFrame) -> DataFrame:
    """K1: pairs(error_type, tool, errors, rule): specificity, actionability, surface and their weighted sum."""
    body = F.lower(F.coalesce("rule", F.lit("")))
    details = F.array_distinct(F.filter(F.concat(F.regexp_extract_all(F.lower(F.coalesce("errors", F.lit(""))), F.lit("([a-z_]{3,})"), 1), F.array(F.lower(F.coalesce("tool", F.lit(""))))), lambda x: x != ""))
    found = F.size(F.filter(details, lambda x: F.contains(body, x)))
    specific = F.when(F.size(details) == 0, 0.5).when(body == "", 0.0).otherwise(found / F.size(details))
    verbs = F.size(F.array_intersect(F.regexp_extract_all(body, F.lit("([a-z]+)"), 1), F.array(*[F.lit(v) for v in VERBS])))
    action = 0.5 * F.least(verbs / 3.0, F.lit(1.0)) + F.when(body.rlike(PATHS), 0.25).otherwise(0.0) + F.when(body.rlike("`[^`]+`"), 0.25).otherwise(0.0)
    surface = F.when(body.contains("hook"), "hook_config").when(body.contains("skill") | body.contains("prompt"), "skill_update").when(body.contains("mcp"), "mcp_config").when(body.contains("settings"), "settings_config").when(body.contains("agent") | body.contains("profile"), "agent_profile").otherwise("claude_md_rule")
    tool = F.lower(F.coalesce("tool", F.lit("")))
    right = F.when(tool.contains("mcp"), surface.isin("mcp_config", "settings_config")).when(tool.contains("hook"), surface == "hook_config")
    for kind, routes in ROUTES.items():
        right = right.when(F.col("error_type") == kind, surface.isin(*routes))
    fits = F.when(F.coalesce(right, F.lit(False)), 1.0).when(surface == "claude_md_rule", 0.5).otherwise(0.0)
    d = pairs.withColumn("specificity", specific).withColumn("actionability", action).withColumn("surface", fits)
    return d.withColumn("score", F.least(F.greatest(0.35 * F.col("specificity") + 0.35 * F.col("actionability") + 0.30 * F.col("surface"), F.lit(0.0)), F.lit(1.0)))


def search_feedback(stream: DataFrame, shell: Column, search: Column, feedback: Column, seconds: int = 900, last: int = 25) -> DataFrame:
    """Each feedback row with the newest search among the ``last`` shell calls before it, at most ``seconds`` old."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = stream.withColumn("_n", F.count_if(shell).over(Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_s", F.last(F.when(search, F.struct("id", "ts", "_n")), True).over(w)).withColumn("_before", F.coalesce(F.max("_n").over(w), F.lit(0)))
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_s.ts").cast("timestamp"))) <= seconds * 1_000_000
    return d.where(feedback & age & (F.col("_before") - F.col("_s._n") < last)).select("id", "session_id", F.col("_s.id").alias("search_id"))


def registry(items: DataFrame, content: str, item: str) -> DataFrame:
    """One row per content: its hash, the first id, how many had it, its lines."""
    d = items.withColumn("sha", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).withColumn("rows", F.size(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).cast("long"))
    return d.groupBy("sha").agg(F.min(item).alias("id"), F.count("*").alias("copies"), F.min("rows").alias("rows"))


def lineage(rows: DataFrame, dataset: str, session: str, order: str) -> DataFrame:
    """Sessions of a dataset in the order in which they first appear, each once."""
    first = rows.groupBy(dataset, session).agg(F.min(order).alias("_at"))
    return first.groupBy(dataset).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", session))), lambda x: x[session]).alias("sessions"))


def accumulated(existing: DataFrame, new: DataFrame, patterns: DataFrame, least: int) -> DataFrame:
    """Counts per pattern after new examples of its tool join those it has; a pattern without any needs ``least``.

    existing(pattern_id, id, label), new(id, tool, label), patterns(pattern_id, tool).
    """
    old = existing.select("id", "label", F.lit(0).alias("_new"), F.col("pattern_id").alias("_own"), F.lit(None).cast(new.schema["tool"].dataType).alias("tool"))
    fresh = new.select("id", "label", F.lit(1).alias("_new"), F.lit(None).cast(existing.schema["pattern_id"].dataType).alias("_own"), "tool")
    # Rows are dealt by id before patterns multiply them, so that what a task groups doesn't grow with the file that it reads.
    dealt = old.unionByName(fresh).repartition("id").join(patterns.select("tool", F.col("pattern_id").alias("_other")), "tool", "left")
    every = dealt.where("_new = 0 or _other is not null").select(F.coalesce("_own", "_other").alias("pattern_id"), "id", "label", "_new")
    one = every.groupBy("pattern_id", "id").agg(F.min_by("label", "_new").alias("label"), F.min("_new").alias("_new"))
    d = one.groupBy("pattern_id").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("_new") == 0).alias("kept"), F.count("*").alias("n"))
    return d.where((F.col("kept") > 0) | (F.col("n") >= least)).withColumn("created", F.col("kept") == 0)


def after_cursor(stream: DataFrame, cursors: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows after their handle's cursor(key, cursor); handles without one are read from the start."""
    return stream.join(cursors, key, "left").where(F.col("cursor").isNull() | (F.col("ts") > F.col("cursor"))).drop("cursor")


def active_sessions(stream: DataFrame, root: Column, as_of: str, minutes: int) -> DataFrame:
    """The newest row of each session in the window; more than one session of a root is a collision."""
    at = F.to_timestamp_ntz(F.lit(as_of))
    d = stream.where((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"interval {minutes} minutes")))
    one = d.withColumn("root", root).groupBy("session_id").agg(F.max_by(F.struct("id", "tool", "root"), F.struct("ts", "id")).alias("_l"), F.max("ts").alias("ts")).select("session_id", "_l.*", "ts")
    return one.withColumn("collision", F.count("*").over(Window.partitionBy("root")) > 1)


def tail(stream: DataFrame, n: int) -> DataFrame:
    """The last n rows of each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    return stream.withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def rolled_up(usage: DataFrame) -> DataFrame:
    """usage(model, day, tokens_in, tokens_out, cost) by model, by day and in all, in one pass of grouping sets."""
    d = usage.groupingSets([["model"], ["day"], []], "model", "day")
    return d.agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 4).alias("cost"), F.grouping_id().alias("level"))


def estimated(runs: DataFrame, prices: DataFrame, fallback: tuple[float, float] = (1.0, 5.0)) -> DataFrame:
    """runs(model, calls, in_tokens, out_tokens) x prices per million tokens; low is half of it, high double."""
    p = prices.select("model", F.col("price_in").alias("_i"), F.col("price_out").alias("_o"))
    mid = F.col("calls") * (F.col("in_tokens") / 1e6 * F.coalesce("_i", F.lit(fallback[0])) + F.col("out_tokens") / 1e6 * F.coalesce("_o", F.lit(fallback[1])))
    return runs.join(p, "model", "left").withColumn("mid", mid).withColumn("low", mid * 0.5).withColumn("high", mid * 2).drop("_i", "_o")


def snippets(docs: DataFrame, group: str, n: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """K4: the first n snippets of 200 characters of a group, no two with the same first 80."""
    d = docs.where(F.trim(text) != "").withColumn("snippet", F.substring(text, 1, 200)).withColumn("_p", F.substring(text, 1, 80))
    one = d.groupBy(group, "_p").agg(F.min(order).alias(order), F.min_by("snippet", order).alias("snippet"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long")).where(F.col("rank") <= n).drop("_p")


def type_analysis(rows: DataFrame, kind: str, tool: str, k: int = 3) -> DataFrame:
    """K5: rows of a type, its different tools and its k most frequent ones."""
    each = rows.groupBy(kind, tool).agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(tool).alias("t")))), 1, k)
    return each.groupBy(kind).agg(F.sum("n").alias("n"), F.count("*").alias("tools"), F.array_join(F.transform(best, lambda x: x["t"]), ",").alias("top"))


def validated(texts: DataFrame, text: str, banned: tuple[str, ...], sentences: int = 3) -> DataFrame:
    """K6: whether a text is there, has at most so many sentences, and holds no banned word."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(F.filter(F.split(t, r"[.!?]+"), lambda x: x.rlike(r"\S"))).cast("long")
    d = texts.withColumn("present", t.rlike(r"\S")).withColumn("sentences", n).withColumn("clean", ~F.lower(t).rlike("|".join(banned)))
    return d.withColumn("valid", F.col("present") & (F.col("sentences") <= sentences) & F.col("clean"))


def slug_remap(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """old(slug, member), new(slug, member): the new slug of best Jaccard at ``least`` or more (ties: the last), else null."""
    o, n = old.dropDuplicates(), new.dropDuplicates()
    size = lambda d, name: d.groupBy("slug").agg(F.count("*").alias(name))
    both = o.join(n.select(F.col("slug").alias("to"), "member"), "member").groupBy("slug", "to").agg(F.count("*").alias("both"))
    d = both.join(size(o, "a"), "slug").join(size(n, "b").withColumnRenamed("slug", "to"), "to")
    d = d.withColumn("jaccard", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).where(F.col("jaccard") >= least)
    best = d.groupBy("slug").agg(F.max_by(F.struct("to", F.round("jaccard", 6).alias("jaccard")), F.struct("jaccard", "to")).alias("_m"))
    return o.select("slug").distinct().join(best, "slug", "left").select("slug", F.col("_m.to").alias("to"), F.col("_m.jaccard").alias("jaccard"))


def synced(sources: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Per platform the rows that the canonical table lacks, and the drift (source - canonical) / source."""
    d = sources.join(canonical.select(key, F.lit(1).alias("_c")).dropDuplicates([key]), key, "left")
    d = d.groupBy("platform").agg(F.count("*").alias("source_rows"), F.count("_c").alias("canonical_rows"))
    return d.withColumn("drift", F.round((F.col("source_rows") - F.col("canonical_rows")) / F.col("source_rows"), 6))


def grade_changes(patterns: DataFrame, as_of: str) -> DataFrame:
    """patterns(id, grade, last_error): dead after 30 days, declining after 7, else established; only where it changes."""
    days = F.date_diff(F.to_date(F.lit(as_of)), F.to_date("last_error"))
    d = patterns.withColumn("new_grade", F.when(days > 30, "dead").when(days > 7, "declining").otherwise("established"))
    return d.where(~F.col("grade").eqNullSafe(F.col("new_grade"))).select("id", "grade", "new_grade")


def candidate(d: DataFrame) -> DataFrame:
    """d(n, sessions, rate, flows, tool_share, repo_share) + kind, confidence and priority."""
    kind = F.when(F.col("flows") > 0, "workflow").when(F.col("tool_share") >= 0.8, "tool").when(F.col("repo_share") >= 0.7, "repo").otherwise("general")
    conf = F.round(F.least(F.col("n") / 20, F.lit(0.4)) + F.least(F.col("sessions") / 10, F.lit(0.3)) + F.least(F.col("rate") * 0.3, F.lit(0.3)), 3)
    return d.withColumn("kind", kind).withColumn("confidence", conf).withColumn("priority", F.when(conf > 0.7, "high").when(conf >= 0.4, "medium").otherwise("low"))


def last_sessions(stream: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Errors in the last n sessions of a key, oldest first."""
    each = stream.groupBy(key, "session_id").agg(F.max("ts").alias("_t"), F.count_if("is_error").alias("errors"))
    w = Window.partitionBy(key).orderBy(F.col("_t").desc(), F.col("session_id").desc())
    d = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "errors"))), lambda x: x["errors"].cast("string")), " ").alias("trend"))


def diversity(items: DataFrame, group: str, least: float = 0.95) -> DataFrame:
    """C20: items(id, group, score, vec): from the best score down, one that is near to a kept one of its group goes.

    Near pairs are found block by block over all rows; then in rounds whoever has no undecided better neighbour is kept and its
    neighbours go.  That is the order-dependent rule itself, whatever the size of a group.  Zero vectors are near to nothing.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    own = F.xxhash64(F.col(group).isNull(), F.col(group)).alias("_g")
    rows = items.select("id", group, "score", own, rank.alias("rank"), F.col("vec").cast("array<float>").alias("vec"))
    zero = ~F.exists("vec", lambda x: x != 0)
    # Of equal vectors of a group all but the best go.
    best = rows.where(~zero).groupBy("_g", "vec").agg(F.min_by(F.struct("id", group, "score", "rank"), "rank").alias("b"))
    best = stored(best.select("b.*", "_g", "vec"), "best")
    near = stored(all_duplicate_pairs(best, least), "near")
    others = near.where("equal").select(F.col("a").alias("rep"), F.col("b").alias("id"))
    who = others.union(best.join(others, "id", "left_anti").select(F.col("id").alias("rep"), "id")).join(best.select("id", "_g", "rank"), "id")
    one, two = (who.select(F.col("rep").alias(k), "_g", F.struct("rank", "id").alias(f"w{k}")) for k in ("a", "b"))
    met = near.where("not equal").select("a", "b").join(one, "a").join(two, ["b", "_g"])
    pairs = met.select(F.least("wa", "wb").getField("id").alias("hi"), F.greatest("wa", "wb").getField("id").alias("lo"))
    edges = stored(pairs.where("hi <> lo"), "edges")
    open_ = stored(edges.select(F.col("hi").alias("id")).union(edges.select(F.col("lo").alias("id"))).distinct(), "open")
    gone = stored(open_.limit(0), "gone")
    while not open_.isEmpty():
        live = edges.join(open_.withColumnRenamed("id", "hi"), "hi", "left_semi").join(open_.withColumnRenamed("id", "lo"), "lo", "left_semi")
        kept = stored(open_.join(live.select(F.col("lo").alias("id")).distinct(), "id", "left_anti"), "kept")
        lost = stored(live.join(kept.withColumnRenamed("id", "hi"), "hi", "left_semi").select(F.col("lo").alias("id")).distinct(), "lost")
        gone = stored(gone.union(lost), "gone")
        open_ = stored(open_.join(kept.union(lost), "id", "left_anti"), "open")
    names = ["id", group, "score"]
    return best.join(gone, "id", "left_anti").select(*names).union(rows.where(zero).select(*names))
