import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import token_codec

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 8191, 8192, 8193, 100_000])
@pytest.mark.parametrize("kinds", [1, 2, 500, 49_408])
def test_round_trip(n, kinds):
    draw = np.random.default_rng(n + kinds)
    ids = np.minimum(draw.zipf(1.3, n), kinds).astype(np.uint16) - 1
    payload = token_codec.encode(ids)
    assert (token_codec.decode(payload) == ids).all() and len(token_codec.decode(payload)) == n


def test_any_block_alone():
    ids = np.random.default_rng(3).integers(0, 3000, 5 * token_codec.BLOCK + 77).astype(np.uint16)
    payload = token_codec.encode(ids)
    for first in range(6):
        low = first * token_codec.BLOCK
        assert (token_codec.decode(payload, first, 2) == ids[low : low + 2 * token_codec.BLOCK]).all()


def test_frequent_ids_cost_less():
    ids = np.minimum(np.random.default_rng(3).zipf(1.5, 200_000), 40_000).astype(np.uint16)
    share = np.bincount(ids) / len(ids)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(token_codec.encode(ids)) * 8 < 1.05 * bits * len(ids)


def test_damage_is_found():
    ids = np.random.default_rng(3).integers(0, 300, 20_000).astype(np.uint16)
    payload = bytearray(token_codec.encode(ids))
    payload[-2000] ^= 1
    with pytest.raises(ValueError):
        token_codec.decode(bytes(payload))


def test_words_give_the_ids_of_whole_texts():
    draw = random.Random(5)
    signs = [*"abcz AB.,;:!?'\"-_<|>019\n\t\r\x0b\x1c\x85\xa0éßñİΣς½①’“中 ", "'s", "'re", "<|endoftext|>", "<|STARTOFTEXT|>", ". ", ", ", "é"]
    whole, coder = Tokenizer.from_file(PATH), token_codec._Words(PATH)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 20))) for _ in range(3000)]
    for text, got in zip(texts, coder.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, np.uint16).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def expected(rows):
    """Rows without id first, then by id; of rows that share an id any order."""
    whole = Tokenizer.from_file(PATH)
    ids = [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    return sorted((-1 if d is None else d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)


@pytest.mark.parametrize("which", ["documents", "odd", "nothing"])
def test_files(request, spark, tmp_path, which):
    rows = request.getfixturevalue(which)
    path = str(tmp_path / "tokens")
    token_codec.write_tokens(rows, PATH, path, row_ids=30_000)
    got = token_codec.read_tokens(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected(
        [(r.doc_id, r.text) for r in rows.collect()]
    )
    at = 0
    in_order = sorted(got, key=lambda r: r.start)
    for r in in_order:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert keys == sorted(keys)


def test_new_words_share_a_text():
    """Thousands of new words cost the tokenizer a few texts, and the ids are those of whole texts."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode(self, *args, **kwargs):
            return self.inner.encode(*args, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **kwargs)

    coder, plain = token_codec._Words(PATH), Tokenizer.from_file(PATH)
    coder.tokenizer = Counting(coder.tokenizer)
    texts = [" ".join(f"w{'abcdefghij'[n % 10]}x{n}" for n in range(k, k + 500)) for k in range(0, 5000, 500)]
    odd = [
        "", "  ", " a\tb ", "nul\0in \0 \0x", "END.%%% don't... dogs'. don't's x'", "\u00c9t\u00c9, \u00e9. e\u0301! \u03a3\u03a3. a\u00a0b\u2003c",
        "a=\u0338 b< \u0338", "<|endoftext|> w", "a\x1cb\x0bc\x0cd", "x.\u0301 y,z; (q) \U0001f600! 1.5, 2. \ufb01.",
    ]
    got = coder.encode([t.encode() for t in texts + odd])
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts + odd]
    assert coder.tokenizer.texts < 50


def test_words_of_letters_skip_the_patterns():
    """Words of small letters reach the model without the normalizer and its patterns, closing signs are cut off before, ids stay."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.bytes = inner, 0

        def encode_batch_fast(self, texts, **kwargs):
            self.bytes += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **kwargs)

    draw, plain = random.Random(9), Tokenizer.from_file(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzAEIOUéèñßüÿÉÑ"
    words = ["".join(draw.choices(letters, k=draw.randint(1, 14))) + draw.choice(["", "", ",", "!!", "###", "."]) for _ in range(6000)]
    texts = [" ".join(words[k : k + 300]) for k in range(0, 6000, 300)]
    coder = token_codec._Words(PATH)
    coder.tokenizer = Counting(coder.tokenizer)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time the words are known
        got = coder.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, np.uint16).tolist() for g in got] == expected
    # What is left for the patterns: closing signs, and words with large letters beyond A-Z.
    rest = sum(len(w) + 4 for w in set(words) if "É" in w or "Ñ" in w) + 100
    assert 0 < coder.tokenizer.bytes < rest


def test_signs_at_the_ends_of_texts():
    """Pieces end with their text, whatever the next text begins with."""
    texts = ["a!", "!b", "", "##", "c.", "×!", "é,", ",", " ", "d", "'s", "e'", "÷.", "\t", "f́!", "ª."]
    whole = Tokenizer.from_file(PATH)
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    pieces, cuts = token_codec._pieces([t.encode() for t in texts])
    parts = [[p.decode() for p in pieces.to_pylist()[a:b]] for a, b in zip(cuts, cuts[1:])]
    assert ["".join(p) for p in parts] == [t.strip().lower() for t in texts]
    assert parts[0] == ["a", "!"] and parts[5] == ["×!"] and parts[6] == ["é", ","]
    coder = token_codec._Words(PATH)
    for some in (texts, texts[::-1], [], [""], [","]):
        got = [np.frombuffer(g, np.uint16).tolist() for g in coder.encode([t.encode() for t in some])]
        assert got == [expected[texts.index(t)] for t in some]


def test_what_is_not_remembered(monkeypatch):
    monkeypatch.setattr(token_codec, "CACHE_WORDS", 5)
    coder, whole = token_codec._Words(PATH), Tokenizer.from_file(PATH)
    for k in range(4):
        texts = [f"some words {k}, others\0 (here) x{k}é! word{'abcd'[k]}.", "words, once more"]
        got = [np.frombuffer(g, np.uint16).tolist() for g in coder.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert 5 <= len(coder.known) == len(coder.bounds) - 1 < 20
