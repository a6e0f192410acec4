"""Table functions over texts, for SQL with LATERAL.

``register`` puts them into a session:

    SELECT d.doc_id, c.* FROM docs d, LATERAL text_chunks(d.text, 500) c
    SELECT d.doc_id, b.* FROM docs d, LATERAL text_blocks(d.text) b

Texts and rows travel in Arrow batches.
``operators.review.chunks`` and ``operators.curation.rule_blocks`` say the same
in expressions and are faster; these serve users who write SQL.

Defined cases: null and empty texts give no row; a width under one or null is an
error; line ends are \\n or \\r\\n; lengths are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# As the engine's own patterns read them: lines end at these characters, blanks are those of ASCII.
HEADING = re.compile("(?:\\A|(?<=[\n\r\u0085\u2028\u2029]))(?=#{1,6} )")
HEAD_LINE = re.compile("#{1,6}[ \t\n\x0b\f\r]")
#: What Spark's trim takes off.
BLANK = " "


@udtf(returnType="chunk int, body string", useArrow=True)
class TextChunks:
    """Q16: a text cut before its headings, each part into slices of ``width`` characters; blank slices go but keep their number."""

    def eval(self, text: str, width: int) -> Iterator[tuple[int, str]]:
        if width is None or width < 1:
            raise ValueError("width is at least 1")
        slices = (part[k : k + width] for part in HEADING.split(text or "") for k in range(0, len(part), width))
        for chunk, body in enumerate(slices):
            if body.strip(BLANK):
                yield chunk, body


@udtf(returnType="start_line int, n_lines long, block string", useArrow=True)
class TextBlocks:
    """Blocks of lines; they end at blank lines and before headings."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        start, held = 0, []
        for number, line in enumerate(re.split("\r?\n", text or ""), 1):
            blank = not line.strip(BLANK)
            if held and (blank or HEAD_LINE.match(line.lstrip(BLANK))):
                yield start, len(held), "\n".join(held)
                held = []
            if not blank:
                start = start if held else number
                held.append(line)
        if held:
            yield start, len(held), "\n".join(held)


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("text_blocks", TextBlocks)
