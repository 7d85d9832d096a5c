"""The visible text of HTML by patterns and Spark's own libraries; no parser, and no Python worker for columns.

Comments and the contents of silent elements go (an unclosed one hides the rest), tags of blocks break lines, other tags go,
character references are read (HTML 4's names, and numbers), white space is one blank.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteproof.functions.values import collapsed

# Tags that break lines, tags whose text is not shown.
BREAKING = "address article blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li ol p pre section table td th tr ul"
SILENT = "script style head title"

_END = r"(?![\s\S])"
HIDDEN = rf"(?is)<!--.*?-->|<({SILENT.replace(' ', '|')})\b[^>]*>.*?(?:</\1\s*>|{_END})"
BREAKS = rf"(?i)</?(?:{BREAKING.replace(' ', '|')})(?:[\s/][^>]*)?>"
TAGS = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
LINE_ENDS = r"\r\n|\r|\n"


def visible_text(page: Column) -> Column:
    """Lines of visible text, divided by line feeds; null of null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    read = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.coalesce(bare, F.lit("")))
    lines = F.filter(F.transform(F.split(read, LINE_ENDS), collapsed), lambda x: x != "")
    return F.when(page.isNotNull(), F.array_join(lines, "\n"))


def text_of(page: str) -> str:
    """``visible_text`` of one string, by the same patterns."""
    for pattern, put in ((HIDDEN, ""), (BREAKS, "\n"), (TAGS, "")):
        page = re.sub(pattern, put, page)
    lines = (" ".join(x.split()) for x in re.split(LINE_ENDS, html.unescape(page)))
    return "\n".join(filter(None, lines))
