"""Unicode folding in the JVM: compatibility forms and case folding by the Unicode library that Spark itself brings (ICU),
called through Spark's ``reflect`` function, the rest by patterns. No Python worker is started.

Spark takes ``reflect`` for non-deterministic, so these columns belong in a projection, not in a join's condition. Fold a
segment or quote once and keep the column. Nulls stay null, so a caller names the rows it needs with ``F.when``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteproof.functions import grammar as g
from quoteproof.functions.values import let

_SHY = "­"
_SINGLE = {a: b for a, b in g.FOLDED.items() if b is not None}
_BROKEN_WORD = rf"([{g.WORD}])-[{g.BLANK}&&[^\n]]*\n[{g.BLANK}]*([{g.WORD}])"
#: Stands between strings that are folded as one; no folding makes or takes it.
_BETWEEN = "\x01"
#: Any character but those that are their own compatibility form and whose case folding is their lower case, but for sharp s.
_UNUSUAL = "[^\\x00-\\x7eÀ-ÖØ-öø-ÿ]"
#: Likewise, and no white space but the blank.
_UNUSUAL_IN_LINE = "[^\\x01\\x20-\\x7eÀ-ÖØ-öø-ÿ]"


def _called(cls: str, method: str, text: Column) -> Column:
    """A static method of (string, boolean), which knows no nulls."""
    return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(True))


def _known(text: Column, unusual: Callable[[Column], Column], otherwise: Callable[[Column], Column]) -> Column:
    """The lower case of a text that is not ``unusual``, else ``otherwise`` of it; the text is folded once."""
    low = let(text, lambda t: F.when(~unusual(t), F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))))
    return F.coalesce(low, F.when(text.isNotNull(), otherwise(F.coalesce(text, F.lit("")))))


def compatible(text: Column) -> Column:
    """NFKC."""
    return F.when(text.isNotNull(), _called("text.Normalizer", "compose", F.coalesce(text, F.lit(""))))


def casefolded(text: Column) -> Column:
    """Full case folding."""
    return _known(text, lambda t: t.rlike(_UNUSUAL), lambda held: _called("lang.UCharacter", "foldCase", held))


def folded_text(text: Column) -> Column:
    """The form in which quotes are compared: compatibility forms and soft hyphens are gone, a word broken at a line end is
    one word, dashes and quotes are plain, white space is one blank, letters are case-folded."""

    def folded(held: Column) -> Column:
        plain = F.replace(_called("text.Normalizer", "compose", held), F.lit(_SHY), F.lit(""))
        whole = F.translate(F.regexp_replace(plain, _BROKEN_WORD, "$1$2"), "".join(_SINGLE), "".join(_SINGLE.values()))
        return _called("lang.UCharacter", "foldCase", F.regexp_replace(F.regexp_replace(whole, f"[{g.BLANK}]+", " "), r"^ | \z", ""))

    blank = F.lit(" ")
    return _known(text, lambda t: F.startswith(t, blank) | F.endswith(t, blank) | F.contains(t, F.lit("  ")) | t.rlike(_UNUSUAL_IN_LINE), folded)


def folded_each(texts: Column) -> Column:
    """An array's strings, each folded (nulls are left out): joined, folded as one text and cut again."""
    safe = F.transform(texts, lambda x: F.replace(x, F.lit(_BETWEEN), F.lit("�")))
    cut = F.split(F.regexp_replace(folded_text(F.array_join(safe, _BETWEEN)), f" ?{_BETWEEN} ?", _BETWEEN), _BETWEEN)
    return F.when(F.size(texts) > 0, cut).when(texts.isNotNull(), F.array().cast("array<string>"))
