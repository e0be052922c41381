import random

import pytest

from arbor.llm import tokenize as T

ALPHABET = ["a", "b", " ", "  ", "'", "'s", "ll", "\n", "é", "ш", "1", "22", "...", "the", " cat", "😀", "aaaaaaa", "===", "re", "\u00a0"]


def _tree(text, leaf, enc):
    at = T.cuts(len(text), leaf)
    return [i for _, p in T.join_tree([T.encode_pieces(text[s:e], enc) for s, e in zip(at, at[1:])], enc) for i in p]


def test_tree_equals_whole():
    enc, rng = T.encoder(), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET[: rng.randint(2, len(ALPHABET))]) for _ in range(rng.randint(1, 120)))
        assert _tree(text, rng.randint(1, 30), enc) == enc.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "abcdefghij" * 700, "=" * 3000, " " * 3000 + "x", "\n" * 2000, "".join(random.Random(1).choice("abcdeé") for _ in range(6000))])
def test_unsplit_text(text):
    enc = T.encoder()
    assert _tree(text, 300, enc) == enc.encode_ordinary(text)


def test_tables(spark):
    enc = T.encoder()
    texts = {1: "Hello <|endoftext|> world", 2: "", 3: None, 4: "long words " * 40, 5: "x" * 700, 6: "über\r\n  Maß"}
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(4, texts[4], "c")], "doc_id long, text string, ids string")
    got = T.token_ids(docs, long_chars=100, leaf_chars=37).collect()
    assert len(got) == 7
    for r in got:
        assert list(r.ids) == (enc.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
    assert T.token_ids(docs.limit(0)).count() == 0
    assert T.token_ids(docs).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_same_as_the_reference_tokenizer_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{T.DEFAULT_DIR}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    enc, rng = T.encoder(), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET) for _ in range(60))
        assert own.encode(text, add_special_tokens=False).ids == enc.encode_ordinary(text)
