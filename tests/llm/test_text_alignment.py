import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A_PATH)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def coders():
    return alignment.Tokenizers(A_PATH, B_PATH)


def token_bytes(libraries, a, b):
    first, second = libraries
    signs = alignment.byte_level_alphabet()
    left = [bytes(signs[c] for c in first.id_to_token(i)) for i in a]
    right = []
    for i in b:
        piece = second.id_to_piece(i)
        right.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
    return left, right


def brute(libraries, rows):
    """Whole texts, byte by byte."""
    docs, holders = [], Counter()
    for doc, text in rows:
        a = libraries[0].encode(" " + text, add_special_tokens=False).ids if text else []
        b = libraries[1].encode(text) if text else []
        left, right = token_bytes(libraries, a, b)
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            docs.append((doc, None))
            continue
        a_of = [i for i, t in enumerate(left) for _ in t]
        b_of = [i for i, t in enumerate(right) for _ in t]
        links = sorted(set(zip(a_of, b_of, strict=True)))
        groups, start_a, start_b = [], 0, 0
        for k in range(len(a_of)):
            end = k + 1 == len(a_of) or (a_of[k] != a_of[k + 1] and b_of[k] != b_of[k + 1])
            if end:
                groups.append((a[start_a : a_of[k] + 1], b[start_b : b_of[k] + 1]))
                start_a, start_b = a_of[k] + 1, b_of[k] + 1
        pairs = [(a[i], b[j]) for i, j in links]
        holders.update(set(pairs))
        docs.append((doc, (a, b, groups, pairs)))
    top = defaultdict(int)
    for (i, _), n in holders.items():
        top[i] = max(top[i], n)
    out = []
    for doc, found in docs:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, pairs = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(holders[p] == top[p[0]] for p in pairs)
        total = sum(holders[p] for p in pairs)
        out.append((doc, len(a), len(b), len(groups), len(pairs), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, documents, libraries):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = alignment.aligned_documents(documents.repartition(3), A_PATH, B_PATH, chunk_links=5000)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(libraries, rows)
    assert got(out) == want and sum(r[1] > 0 for r in want) > 150


ODD = [
    "a  b", " a", "a ", "   ", "\n x", "x\n \ny", "x <s> y <unk>", "<|endoftext|> z", "▁a b", "a▁ b", "a  b", "a  b",
    "a\u0000b c", "a　 b", "tab\t tab", "é́ e", "日本語 テキスト", "👩‍👩‍👧 family", "ﬁ ﬂ", "I'm you'll 's", "it's’ ok", "123 4567 !?",
    "\u0085 a", "a  b", "ß ﬀ İ i̇", "﻿a b", "x" * 5000, "word " * 3000, "\r\n a\r\n",
]


def test_odd_texts(spark, libraries):
    rows = [*enumerate(ODD), (None, None), (None, "one two"), (90, ""), (91, "one two"), (91, "one two")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, sha string")
    assert got(alignment.aligned_documents(df.repartition(3), A_PATH, B_PATH)) == brute(libraries, rows)


def test_pieces_give_the_ids_of_whole_texts(coders, libraries):
    draw = random.Random(4)
    signs = [*"ab é\n.,'!0", "  ", " ", " ", " ", "\t", "the", "日", " ", "'s", "ñ", "▁", "​", " "]
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 25))) for _ in range(4000)]
    chunk = alignment._Chunk(0)
    chunk.add(list(range(len(texts))), texts, coders)
    n_a = alignment._opened(chunk.record().column("numbers")[0].as_py(), 8)[5].tolist()
    for text, tokens, digest in zip(texts, n_a, chunk.digests, strict=True):
        a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
        left, right = token_bytes(libraries, a, b)
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            assert (tokens, digest) == (0, "")
        else:
            windows = coders.windows(a, b)
            known = coders.aligned(list(windows))
            whole = ";".join(known[w].text for w in windows)
            assert tokens == len(a) and digest == hashlib.sha256(whole.encode()).hexdigest(), text


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_odd_rows(request, libraries, which, odd_rows):
    want = brute(libraries, [r[:2] for r in odd_rows] if which == "odd" else [])
    assert got(alignment.aligned_documents(request.getfixturevalue(which), A_PATH, B_PATH)) == want
