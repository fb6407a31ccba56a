"""Merges over many words at once against the tokenizer itself."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

from quire.llm import packing
from quire.llm.packing import Encoder
from quire.llm.queries import tokenizer_path

CASES = ["'s", "it's", "IT'S", "''s", "l'été", "5's", "we'll've", "a'tb", "<|endoftext|>", "<|", "<|x", "½", "İx", "é", "Ÿ…", "中文", "a" * 64, "a" * 65, "ab" * 40, "12.50€", "'"]


def _words():
    r = random.Random(8)
    signs = "abcdeilnorstvABCXYZ'''sStmdrevl0123.,;-_<>|\"!éÉßÿÖñçœŒ“”’…€×÷½İЖ中́­"
    return list(dict.fromkeys(CASES + ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(20_000)]))


def test_ids_are_the_tokenizers():
    encoder, words = Encoder(tokenizer_path()), _words()
    assert len([w for w in words if encoder.merges.plain(w)]) > 1_000
    for k in range(0, len(words), 3_000):
        encoder._learn(words[k : k + 3_000])
    for w in words:
        assert encoder.young[w] == b"".join(i.to_bytes(4, "little") for i in encoder.tokenizer.encode(w, add_special_tokens=False).ids), w


def test_plain_words_need_no_tokenizer():
    """What took most of op8_packing's time."""
    encoder = Encoder(tokenizer_path())
    want = encoder.tokenizer.encode("Ciónesas, l'été isn't 2nd…", add_special_tokens=False).ids
    encoder.tokenizer = None
    assert encoder.encode(["Ciónesas, l'été isn't 2nd…"]) == [b"".join(i.to_bytes(4, "little") for i in want)]


def test_other_rules_have_no_merges(tmp_path):
    """A tokenizer of another rule is asked for every word."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('"Lowercase"', '"NFD"'), encoding="utf-8")
    encoder = Encoder(str(other))
    assert encoder.merges is None
    assert encoder.encode(["Été"]) == [b"".join(i.to_bytes(4, "little") for i in encoder.tokenizer.encode("Été", add_special_tokens=False).ids)]


def test_texts_at_once(monkeypatch):
    """Many texts in a row are each as if encoded whole, with any white space, words that need the tokenizer, nulls and empty ones; a slice is as its texts."""
    monkeypatch.setattr(packing, "WORDS", 1_000)
    r, words = random.Random(9), _words()
    texts = [None, "", "  ", *["".join(r.choice(words) + r.choice([" ", "\n", "\t\r ", "\x0b\x0c", "\xa0", "\u3000", "\x1c"]) for _ in range(r.randint(0, 60))) for _ in range(300)], None]
    encoder = Encoder(tokenizer_path())
    for first, n in ((0, len(texts)), (2, 150)):
        ids, edges = encoder.encode_all(pa.array(texts).slice(first, n), 1)
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[first : first + n]]
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == want
    assert encoder.encode_all(pa.array([], pa.string()), 1)[1] == [0] and encoder.encode([]) == []


def test_words_of_many_texts_are_looked_up_once():
    """What took most of op8_packing's time."""
    encoder, seen = Encoder(tokenizer_path()), []
    of_words = encoder.merges.encode
    encoder.merges.encode = lambda words: seen.extend(words.to_pylist()) or of_words(words)
    assert len(set(encoder.encode(["one two two", "two one"] * 500))) == 2
    assert seen == ["one", "two"]


def test_portions_have_every_row(monkeypatch):
    monkeypatch.setattr(packing, "PORTION", 10)
    for texts in ([], [None], ["", None, "a" * 25, "b", "", "c" * 9, "d" * 9, None]):
        got = packing._portions(pa.array(texts, pa.string()))
        assert [k for first, n in got for k in range(first, first + n)] == list(range(len(texts)))
