import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def agree(library, texts):
    fsa = bpe.automaton(VOCABULARY).compile()
    for t in texts:
        ids = np.frombuffer(fsa.encode(t), dtype="<u4")
        wanted = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == wanted, t[:80]
        assert fsa.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)


def test_whole_table(spark, library):
    agree(library, [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])


def test_hard_texts(library):
    rnd = random.Random(1)
    odd = ["<|endoftext|> hi<|startoftext|>", "ΑΣ ΣΣ", "aaaa aaaaa " + "a" * 333, "İstanbul é é", "​\x1cx\x1d 　y\x85z", "don't we'll 'tis x's!'s 123 ½²", "\U0001f600\U0001f600 क़ ﬀ Å", "!!!---... ,a, .b. a.b", "\x00\x01 \x7f", "_a_b_"]
    odd += ["".join(rnd.choice("abcdefgh") for _ in range(6_000)), " ".join("".join(rnd.choice("aeinrstlo'.é") for _ in range(rnd.randint(1, 14))) for _ in range(9_000))]
    agree(library, odd)


def test_all_code_points(library):
    """Each between letters and twice in a row, some hundreds a text, and marks behind others."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    agree(library, ["".join(f" a{c}b {c}{c}" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)])
    marks = [c for c in chars if unicodedata.combining(c) or ord(c) in (0x11930, 0x11938)]
    others = [*"\u0300\u0328\u0334\u1df6\U00011f42\U00011a34\U00011935", "é"]
    agree(library, ["".join(f" a{c}{o}z a{o}{c}z" for c in marks[i : i + 100] for o in others) for i in range(0, len(marks), 100)])
    agree(library, ["\ue000\U00100000\u0558x\U00100001 \u0558\U00100000", "\u1c89B\u0328\U00011f42É"])


def test_gadgets_of_a_small_merge_list():
    """The automaton of three merges against merging by rank."""
    labels = ["a", "b", "a</w>", "b</w>", "aa", "ab</w>", "aaab</w>"]
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "ab</w>")]
    chars = bpe._byte_chars()
    vocabulary = {x: i for i, x in enumerate([*labels, *(c for c in chars if c not in "ab"), *(c + "</w>" for c in chars if c not in "ab")])}
    fsa = bpe.Automaton({"model": {"vocab": vocabulary, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"}}).compile()

    def by_rank(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (x, y) in merges]
            if not ranks:
                return [vocabulary[p] for p in parts]
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert fsa.encode_word(word) == by_rank(word), word


def test_edges_of_input(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "One two", "x"), (3, "One two", "x")], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    assert [len(r["ids"]) for r in got] == [0, 0, 2, 2]
    assert [r["decoded"] for r in got] == ["", "", "one</w> two</w>", "one</w> two</w>"]
    assert {c for c in df.columns} <= set(got[0].asDict())
    assert bpe.round_trip(df, VOCABULARY).where(F.col("n_tokens") == 0).count() == 2
    assert bpe.round_trip(df.limit(0), VOCABULARY).count() == 0
