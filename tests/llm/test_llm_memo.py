"""The word memo of the tokenizers library."""

from quoteproof.llm import _encode as e


def test_forms_of_a_word_ask_the_model_once(monkeypatch):
    """Also when the memo of written forms has given up those that it knew."""
    monkeypatch.setattr(e, "MEMO_ENTRIES", 6)
    one, asked = e.MemoEncoder(e.tokenizer_path("word_bpe_49k.json")), []
    ask = one._model
    one.heads.make = lambda part: asked.append(part) or ask(part)
    texts = ["verauver Verauver, VERAUVER. verauver; Verauver! einauer Einauer (x)", "Verauver? Einauer; einauer: verauver& Einauer"]
    assert [one.encode([x])[0] for x in texts] == one._library(texts)
    assert asked == ["verauver", "einauer"]
