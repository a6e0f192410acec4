"""Lexicons and text expressions shared by the signal operators."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists of the session signals, as regular expressions between word ends.
CORRECTION = (
    r"no,?\s+actually", r"that['’]?s\s+wrong", r"that['’]?s\s+not\s+right", r"not\s+what\s+i\s+wanted", r"not\s+that", r"wrong\s+file", r"wrong\s+path",
    r"i\s+meant", r"i\s+said", r"not\s+correct",
)
UNDO = (r"git\s+checkout", r"git\s+revert", r"undo\s+that", r"revert\s+that", r"undo\s+the\s+change", r"roll\s+back", r"rollback")
ADMISSION = (
    r"i\s+made\s+a\s+mistake", r"i\s+made\s+an\s+error", r"that\s+was\s+(?:my\s+)?(?:a\s+)?mistake", r"i\s+was\s+wrong", r"i\s+should\s+have", r"i\s+should\s+not\s+have",
    r"i\s+shouldn['’]t\s+have", r"i\s+accidentally", r"i\s+mistakenly", r"i\s+incorrectly", r"i\s+missed", r"i\s+overlooked", r"i\s+forgot\s+to", r"i\s+failed\s+to",
    r"i\s+neglected\s+to", r"my\s+apologies", r"sorry\s+about\s+that", r"sorry\s+for\s+the\s+(?:error|mistake|confusion|oversight)", r"apologize\s+for",
    r"let\s+me\s+(?:fix|correct|redo)\s+that", r"that['’]?s\s+not\s+(?:right|correct)\b.*\blet\s+me", r"i\s+need\s+to\s+(?:fix|correct|redo)",
    r"i\s+didn['’]t\s+(?:account|consider|notice|check|read|realize)",
)
POSITIVE = ("thanks", "perfect", "great", "good", "nice", "awesome", "correct", "exactly", "works", "yes")
NEGATIVE = ("wrong", "no", "fix", "error", "broken", "fail", "undo", "revert", "frustrated", "annoying", "waste")
ESCALATION = (r"frustrated", r"annoying", r"waste\s+of\s+time", r"just\s+do\s+\w+", r"stop\s+(?:doing|it|this|that|trying)")
CONFIRMATION = (
    r"yes\s+exactly", r"that['’]?s\s+right", r"that['’]?s\s+correct", r"yes\s+that\s+works", r"exactly\s+what\s+i\s+wanted", r"that['’]?s\s+what\s+i\s+(?:want|need)(?:ed)?",
    r"yes,?\s+that['’]?s\s+it", r"spot\s+on", r"nailed\s+it",
)
GRATITUDE = (
    r"thank\s+you", r"thanks\s+(?:a\s+lot|so\s+much|for)", r"great\s+(?:work|job)", r"nice\s+(?:work|job|one)", r"well\s+done", r"awesome\s+(?:work|job)",
    r"appreciate\s+(?:it|that|the)", r"beautifully\s+done",
)
REJECTION = (
    r"that['’]?s\s+wrong", r"that['’]?s\s+not\s+(?:right|correct|what)", r"not\s+what\s+i\s+(?:wanted|asked|meant)", r"wrong", r"undo", r"revert", r"rollback", r"roll\s+back",
    r"i\s+(?:said|meant|asked)", r"not\s+correct", r"no,?\s+actually", r"fix\s+(?:this|that|it)", r"try\s+again",
)
# Phrases of an agent's states, by label.
STATES = (
    ("agent_admission", ADMISSION),
    ("agent_uncertainty", (
        r"i\s+think", r"(?:it\s+)?might\s+be", r"(?:it\s+)?could\s+be", r"maybe", r"perhaps", r"probably", r"possibly", r"i['’]?m\s+not\s+(?:sure|certain)", r"i\s+suppose",
        r"i\s+guess", r"i\s+believe", r"if\s+i\s+recall",
    )),
    ("agent_overconfidence", (
        r"definitely", r"certainly", r"undoubtedly", r"without\s+a\s+doubt", r"i['’]?m\s+(?:certain|sure)", r"i\s+am\s+(?:certain|sure)", r"100%\s+(?:sure|confident|certain)",
        r"it\s+must\s+be", r"guaranteed", r"(?:obviously|evidently)",
    )),
    ("agent_self_reflection", (
        r"on\s+reflection", r"looking\s+back", r"my\s+previous\s+attempt", r"failed\s+because", r"in\s+the\s+next\s+(?:trial|attempt|time)", r"i\s+(?:now\s+)?realize\s+that",
        r"i\s+misunderstood", r"i\s+did\s+not\s+take\s+into\s+account", r"i\s+need\s+to\s+reconsider",
    )),
    ("agent_self_critique", (
        r"let\s+me\s+verify", r"let\s+me\s+double[-\s]?check", r"checking\s+my\s+work", r"the\s+answer\s+is\s+not\s+reasonable", r"this\s+could\s+be\s+improved",
        r"a\s+better\s+(?:approach|solution)", r"let\s+me\s+reconsider",
    )),
    ("agent_assumption", (
        r"i['’]?ll\s+assume", r"i\s+(?:would\s+)?assume", r"assuming\s+that", r"i['’]?m\s+guessing", r"presumably", r"to\s+the\s+best\s+of\s+my\s+knowledge",
        r"as\s+far\s+as\s+i['’]?m?\s+aware",
    )),
    ("agent_stuck", (
        r"i['’]?m\s+(?:not\s+able|unable)\s+to", r"i\s+can['’]?t\s+figure\s+(?:this\s+)?out", r"i\s+keep\s+failing", r"i['’]?m\s+stuck", r"i\s+cannot\s+(?:solve|determine)",
        r"i['’]?ve\s+tried\s+(?:multiple|several)",
    )),
)
# Messages of guards that did their work, and headers of rules that were shown; neither is a failure.
GUARDS = (
    r"\bPreToolUse:[A-Za-z]+\s+(?:hook\s+)?(?:denied|blocked)\b", r"\bHook\s+PreToolUse:[A-Za-z]+\s+denied\b", r"\bhhdev-preflight\b", r"\bAP-010\s+(?:block|preflight)\b",
    r"\bretry-guard\b.*\bblock(?:ed|ing)?\b", r"\[retry-guard\]\s+BLOCK", r"\bdocker-down-gate\b", r"\bbatch-guard\b.*\bblock(?:ed|ing)?\b", r"\bcascade-shield\b.*\bblock(?:ed|ing)?\b",
    r"\[claudemd-cap\]\s+BLOCK", r"\[done-before-gate\]", r"\bPreToolUse:[A-Za-z]+\s+hook\s+error\b",
)
HEADERS = (r"ZENO\s+RETRY-LOOP\s+RULE", r"HOOK-BYPASS\s+RULE", r"DBT/CUBE\s+SOURCE\s+BINDING", r"CONFIG\.TOML\s+BINDING\s+\+\s+HH_WORKTREE_MODE")
# Idioms that pass by a check; words that begin a correction; words of a failed output, of an undo and of praise.
BYPASSES = r"(\|\|\s*true|\|\|\s*exit\s+0|--no-verify|--force\b|--no-deps|skip-checks|ignore-scripts|\.skip\(|@pytest\.mark\.skip|\bxfail\b|--strict=false)"
PREFIXES = ("no,", "actually,", "instead,", "wait,", "stop,")
# What a prompt takes back, anywhere in it; how a prompt begins that corrects.
UNDOING = ("undo", "revert", "rollback", "roll back", "go back", "restore", "put it back", "change it back")
CORRECTING = (
    "no,", "no ", "actually,", "actually ", "instead,", "instead ", "wait,", "wait ", "stop,", "stop ", "that's wrong", "that is wrong", "not what i", "don't do", "do not do", "undo ", "revert ",
)
FAILED = r"\b(Error|Exception|FAILED|Permission denied|not found|No such file)\b"
TAKEN_BACK = r"\b(undo|revert|rollback|go back|restore|put it back|that.s wrong)\b"
PRAISE = r"\b(thanks|perfect|awesome|great|nice|good|done|yes|ok|lgtm|ship it)\b"
# Fixed values: "stop" as a complaint, and alone on a line.
STOPS = (r"\bstop\s+(?:doing|it|this|that|changing|trying)\b|(?:^|\s)stop[,!.]", r"^stop[!.]?\s*$")
# What a content filter objects to, and stack traces.
FILTERS = (
    r'IMPORTANT:[^"]{10,}?\.', r"(?s)<system-reminder>.*?</system-reminder>", r"(?s)<system>.*?</system>", r"(?s)<user-prompt-submit-hook>.*?</user-prompt-submit-hook>",
    r"(?s)<tool_use_error>.*?</tool_use_error>", r"(?s)<[a-z_-]+>.*?</[a-z_-]+>", r"[A-Za-z0-9+/]{50,}={0,2}", r"(?:0x)?[0-9a-fA-F]{32,}", r'"role"\s*:\s*"(?:system|user|assistant)"',
)
TRACES = (
    r'File ".*?", line \d+, in .*?(?:\\n|$)', r"(?s)Traceback \(most recent call last\):.*?(?=\\n[A-Z])", r"(?s)During handling of the above exception.*?(?=\\n[A-Z]|$)",
    r"/home/[a-z]+/[^\s\"']{20,}", r"at (?:Object\.|Module\.|Function\.)[^\n]{10,}", r"litellm\.[a-zA-Z.]+Error:.*?(?=\\n|$)",
)
# Secrets, and how an error text loses its ids.
SECRETS = (
    r"sk-[a-zA-Z0-9_\-]{20,}", r"AKIA[A-Z0-9]{16}", r"Bearer [a-zA-Z0-9._\-]+", r"""(?i)(password|passwd|pwd)\s*[=:]\s*["']?[^\s"']{4,}""",
    r"""(?i)(api[_-]?key)\s*[=:]\s*["']?[^\s"']{8,}""", r"""(?i)(secret|token)\s*[=:]\s*["']?[^\s"']{8,}""", r"ghp_[a-zA-Z0-9]{20,}", r"gho_[a-zA-Z0-9]{20,}",
    r"sk-ant-[a-zA-Z0-9_\-]{20,}", r"-----BEGIN [A-Z ]+ KEY-----", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
)
NORMALISE = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "U"), (r"0x[0-9a-fA-F]+", "H"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[\.\d:Z+-]*", "TS"), (r"/[^\s\)\]\"',]+", "P"), (r":\d{2,5}\b", "PT"), (r"line \d+", "line N"), (r"\d{5,}", "N5"),
    (r"\d+", "n"), (r"\s+", " "),
)

LETTERS = "A-Za-z0-9_À-ɏ"


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Does one of the phrases stand in the text between word ends?  Null texts: no."""
    return F.coalesce(text.rlike(f"(?i)(?<![{LETTERS}])(?:{'|'.join(phrases)})(?![{LETTERS}])"), F.lit(False))


def any_of_sql(text: str, phrases: tuple[str, ...]) -> str:
    """The same test in SQL engines without look-around."""
    pattern = f"(?i)(?:^|[^{LETTERS}])(?:{'|'.join(phrases)})(?:[^{LETTERS}]|$)".replace("'", "''")
    return f"coalesce(regexp_matches({text}, '{pattern}'), false)"


def starts_with_any(text: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in starts:
        out = out | F.startswith(text, F.lit(p))
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([{LETTERS}]+)"), 1)


def _by_first_letter(words: tuple[str, ...]) -> str:
    """An alternation of words, tried by their first letter."""
    letters = sorted({w[0] for w in words})
    return "|".join(f"{x}(?:{'|'.join(w[1:] for w in words if w[0] == x)})" for x in letters)


def listed_words(text: Column, words: tuple[str, ...]) -> Column:
    """The words of the text that are in the list, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![{LETTERS}])(?:{_by_first_letter(words)})(?![{LETTERS}])"), 0)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """Number of words of the text that are in the list."""
    return F.size(listed_words(text, words))


def hits_sql(text: str, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[{LETTERS}]+'), lambda w: w IN ({listed})))"


def sentiment(text: Column) -> Column:
    """(positive - negative) / max(positive + negative, 1)."""
    count = lambda found: F.aggregate(found, F.struct(F.lit(0).alias("p"), F.lit(0).alias("n")), lambda s, w: F.struct((s["p"] + w.isin(*POSITIVE).cast("int")).alias("p"), (s["n"] + w.isin(*NEGATIVE).cast("int")).alias("n")))
    score = lambda s, stops: (s["p"] - s["n"] - stops) / F.greatest(s["p"] + s["n"] + stops, F.lit(1))
    return once(count(listed_words(text, POSITIVE + NEGATIVE)), lambda s: score(s, _stops(text)))


def _stops(text: Column) -> Column:
    """How often "stop" is a complaint."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(F.lower(text), F.lit("stop")), F.regexp_count(text, F.lit(f"(?im){STOPS[0]}"))).otherwise(0)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def negatives(text: Column) -> Column:
    """Negative words, and "stop" as a complaint."""
    return hits(text, NEGATIVE) + _stops(text)


def negatives_sql(text: str) -> str:
    return f"({hits_sql(text, NEGATIVE)} + len(regexp_extract_all(coalesce({text}, ''), '(?im){STOPS[0]}')))"


def escalated(text: Column) -> Column:
    """A phrase of acute frustration, or "stop" alone on a line."""
    return any_of(text, ESCALATION) | F.coalesce(text.rlike(f"(?im){STOPS[1]}"), F.lit(False))


def escalated_sql(text: str) -> str:
    return f"({any_of_sql(text, ESCALATION)} OR coalesce(regexp_matches({text}, '(?im){STOPS[1]}'), false))"


def normalised(text: Column) -> Column:
    """An error text without its ids, times, paths and numbers; first 500 characters."""
    out = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    for pattern, by in NORMALISE:
        out = F.regexp_replace(out, pattern, by)
    return F.lower(F.trim(out))


def normalised_sql(text: str) -> str:
    out = f"substr(coalesce({text}, ''), 1, 500)"
    for pattern, by in NORMALISE:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"lower(trim({out}))"


def scrubbed(text: Column, traces: bool = False) -> Column:
    """Secrets as [REDACTED], what a filter objects to as [FILTERED]; with ``traces`` stack traces too.

    The patterns are tried in order, each on what the one before has left, and only where the text holds what the pattern can't do without.
    """
    for patterns, by in _scrubs(traces):
        for needed, some in groupby(patterns, _needed):
            text = once(text, _replaced(needed, tuple(some), by))
    return text


def _replaced(needed: tuple[str, ...], patterns: tuple[str, ...], by: str) -> Callable[[Column], Column]:
    def use(x: Column) -> Column:
        out = x
        for p in patterns:
            out = F.regexp_replace(out, p, by)
        return F.when(_holds(x, needed), out).otherwise(x)

    return use


#: What a text must hold for a pattern to be found in it, by how the pattern begins.
_NEEDS = (
    ("sk-", "sk-"), ("AKIA", "AKIA"), ("Bearer", "Bearer "), ("ghp_", "ghp_"), ("gho_", "gho_"), ("-----BEGIN", "-----BEGIN "), ("eyJ", "eyJ"), ("IMPORTANT:", "IMPORTANT:"), ("(?s)<", "</"),
    ('"role"', '"role"'), ("File ", 'File "'), ("(?s)Traceback", "Traceback (most"), ("(?s)During", "During handling"), ("/home/", "/home/"), ("at (?:", "at "), ("litellm", "litellm."),
)
#: The letters of long runs: what is 32 of the narrower kind is so of this one.
_RUN = "[A-Za-z0-9+/]"


def _needed(pattern: str) -> tuple[str, ...]:
    """Literals of which the text must hold one, in lower case for a pattern without case; none for a pattern that is a long run."""
    if pattern.startswith("(?i)("):
        return ("lower", *pattern[5 : pattern.index(")")].replace("[_-]?key", "").split("|"))
    return next(((literal,) for beginning, literal in _NEEDS if pattern.startswith(beginning)), ())


def _holds(text: Column, needed: tuple[str, ...]) -> Column:
    if not needed:
        return text.rlike(f"(?<!{_RUN}){_RUN}{{32}}")
    low, literals = needed[0] == "lower", needed[len(needed) > 1 :]
    where = F.lower(text) if low else text
    out = F.contains(where, F.lit(literals[0]))
    for x in literals[1:]:
        out = out | F.contains(where, F.lit(x))
    return out


def _scrubs(traces: bool) -> list[tuple[tuple[str, ...], str]]:
    return [(SECRETS, "[REDACTED]"), (FILTERS, "[FILTERED]"), *([(TRACES, "[STACK_TRACE]")] if traces else [])]


def scrubbed_sql(text: str) -> str:
    for patterns, by in _scrubs(False):
        for pattern in patterns:
            text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return text


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
