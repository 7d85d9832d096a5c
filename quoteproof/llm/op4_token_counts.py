"""Token counts by prefix dynamic programming.

For a BPE vocabulary the tokens of a prefix are the tokens of a shorter prefix plus one last token, and that
token is the only one whose merge with its predecessor is stable. So one pass over a text's prefixes gives the
exact token count at each of them. ``prefix_profiles`` returns these counts as signed one-byte steps, from which
``count_at`` and ``longest_prefix`` answer truncation and budget questions without encoding again.

Null texts count as empty (0 tokens, empty profile); rows are kept one to one, in any number and with any extra
columns (``carry`` names those to return); nothing is grouped, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._encode import text_blocks, tokenizer_path
from ._shared import KEPT, frugal, load, text_or_empty

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Entries of a worker's memo of words, and of its memo of stable token pairs.
MEMO_ENTRIES = 600_000
MEMO_CHARS = 64

_BLANK = "▁"


class PrefixCounter:
    """Exact token counts at all prefixes, for a byte-fallback BPE model without text normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        # no piece joins letters to other characters, or has a blank inside: the text may be cut there
        mixed = re.compile(r"▁*[^\W\d_²]+|▁*(?:(?!▁)[\W\d_²])+|▁+")
        self.cuts = mixed if all(mixed.fullmatch(p) for p in self.score) else re.compile("(?s).+")
        self.stable: dict[tuple[str, str], bool] = {}
        self.groups: dict[str, list[int]] = {}
        self.words: dict[str, tuple[bytes, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def group(self, text: str) -> list[int]:
        """Counts at prefixes 1..n of a group that is encoded by itself."""
        if (kept := self.groups.get(text)) is not None:
            return kept
        score, stable, longest = self.score, self.stable, self.longest
        last, count = [""] * (len(text) + 1), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                known = (token := text[start:end]) in score
                if not known and end - start > 1:
                    continue
                if start:
                    pair = (last[start], token)
                    ok = stable.get(pair)
                    if ok is None:
                        both = pair[0] + token  # a piece itself would not have stayed apart
                        ok = stable[pair] = both not in score and self.merged(both) == [*pair]
                    if not ok:
                        continue
                last[end], count[end] = token, count[start] + (1 if known else len(token.encode()))
                break
        if len(text) <= MEMO_CHARS:
            self.groups[text] = count[1:]
        return count[1:]

    def word(self, word: str, first: bool) -> tuple[bytes, int]:
        """Steps of the count over a word and the blank before it; the first word's blank is only thought."""
        steps, before, total = array("b"), 0, 0
        for group in self.cuts.findall(_BLANK + word):
            for c in self.group(group):
                steps.append(total + c - before)
                before = total + c
            total = before
        if first:
            steps[0:2] = array("b", [steps[0] + steps[1]])
        return steps.tobytes(), total

    def runs(self, text: str) -> tuple[bytes, int]:
        """A text with runs of blanks: cut before each run, by the same rule."""
        steps, before, total = array("b"), 0, 0
        for group in self.cuts.findall(_BLANK + text.replace(" ", _BLANK)):
            for c in self.group(group):
                steps.append(total + c - before)
                before = total + c
            total = before
        steps[0:2] = array("b", [steps[0] + steps[1]])
        return steps.tobytes(), total

    def profile(self, text: str) -> tuple[bytes, int]:
        """Steps (one for each code point) and the whole text's count."""
        if not text:
            return b"", 0
        words = text.split(" ")
        if "" in words or _BLANK in text:
            return self.runs(text)
        steps, total = self.word(words[0], True)
        found = []
        for w in words[1:]:
            got = self.words.get(w)
            if got is None:
                got = self.word(w, False)
                if len(w) <= MEMO_CHARS:
                    self.words[w] = got
            found.append(got)
        return steps + b"".join([x[0] for x in found]), total + sum([x[1] for x in found])

    def trim(self) -> None:
        for memo in (self.words, self.groups, self.stable):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()


_COUNTERS: dict[str, PrefixCounter] = KEPT.setdefault("counters", {})


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def count_at(profile: bytes, n_chars: int) -> int:
    """Tokens of the prefix of ``n_chars`` code points."""
    return int(np.frombuffer(profile, dtype=np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix(profile: bytes, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(profile, dtype=np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_profiles(
    docs: DataFrame, model_file: str, carry: tuple[str, ...] = ("doc_id",), budgets: tuple[int, ...] = (), profiles: bool = True
) -> DataFrame:
    """One row per document: ``carry``, n_tokens, n_bytes, chars_within (one for each budget) and the prefix profile.

    ``profiles=False`` answers the budgets on the executors and leaves the profiles there.
    """
    schema = docs.select(*carry).schema
    out = schema.add("n_bytes", "long").add("n_tokens", "long").add("chars_within", T.ArrayType(T.LongType())).add("profile", "binary")
    names = [f.name for f in out.fields]

    def run(batches):
        c = counter(model_file)
        for batch in batches:
            for start, end, texts in text_blocks(batch.column("_text")):
                part = batch.slice(start, end - start)
                c.trim()
                found = [c.profile(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in carry]
                    + [
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([n for _, n in found], pa.int64()),
                        pa.array([[len(t) if n <= b else longest_prefix(p, b) for b in budgets] for t, (p, n) in zip(texts, found, strict=True)], pa.list_(pa.int64())),
                        pa.array([p if profiles else None for p, _ in found], pa.binary()),
                    ],
                    names=names,
                )

    return docs.select(*carry, text_or_empty().alias("_text")).mapInArrow(frugal(run, "counters"), out)


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return prefix_profiles(docs, tokenizer_path(MODEL), budgets=(TOKEN_LIMIT,), profiles=False).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
        F.col("chars_within")[0].alias("chars_within_limit"),
    )
