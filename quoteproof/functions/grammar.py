"""Fixed values of the typed-value grammars: what counts as a number, date, week, unit, address or phone number.

Patterns are written for Java. ``WORD`` and ``BLANK`` spell out the word and white-space characters, since Java's own
classes take in combining marks and leave out superscripts and some separators.
"""

from __future__ import annotations

from quoteproof.schema import UNIT_SPELLINGS

# Character classes.
WORD = r"\p{L}\p{N}_"
BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"

# Single characters that are written in another way before quotes are compared (None: left out).
FOLDED = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "‘": "'", "’": "'", "‚": "'", "×": "x",
}

# The grammars.
GROUP_BLANKS = r" \u00a0\u202f"
NUMBER = rf"[0-9]{{1,3}}(?:\.[0-9]{{3}})+(?:,[0-9]+)?|[0-9]{{1,3}}(?:[{GROUP_BLANKS}][0-9]{{3}})+(?:,[0-9]+)?|[0-9]+,[0-9]+|[0-9]+\.[0-9]+|[0-9]+"
NUMBER_IN_TEXT = rf"(?<![{DIGIT}.,])(?:(?<![^{BLANK}(])-)?(?:{NUMBER})(?![{DIGIT}]|[.,]{DIGIT})"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})"
DATE_IN_TEXT = rf"(?<![{DIGIT}.\-])(?:{DATE})(?![{DIGIT}]|-{DIGIT})"
WEEK = rf"(?iu)(?:kw|kalenderwoche|cw)\.?[{BLANK}]*([0-9]{{1,2}})(?:[{BLANK}]*/[{BLANK}]*([0-9]{{4}}|[0-9]{{2}})|[{BLANK}]+(20[0-9]{{2}}))?"
WEEK_IN_TEXT = rf"(?<![{WORD}]){WEEK}(?!{DIGIT})"
UNIT_AFTER_NUMBER = rf"{DIGIT}[{BLANK}]*([\p{{L}}\p{{Nl}}\p{{No}}]+)\.?(?![\p{{L}}\p{{N}}])"
CELL_BORDER = r"[|\t]"
MAIL = rf"[^{BLANK}@<>]+@[^{BLANK}@<>]+\.[^{BLANK}@<>]+"
MAIL_BOUNDS = (rf"(?<![{WORD}.+\-])", rf"(?![{WORD}\-]|\.[{WORD}])")
PHONE = r"\+?[0-9 \u00a0/()\-]+"
PHONE_IN_TEXT = rf"(?<![{WORD}+.])\+?[0-9][0-9 \u00a0/()\-]*[0-9](?![{WORD}.]{DIGIT}|[{WORD}])"
PHONE_DIGITS = 6

#: Spelling to canonical unit.
UNITS = {spelling: unit for unit, spellings in UNIT_SPELLINGS.items() for spelling in spellings}
