"""Cuts of the pipeline keep all characters that no cut touches."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp

from vacantia.llm.suffix_index import without


def test_replacement_characters_far_from_a_cut_stay(spark):
    passage = "a passage of more than fifty bytes that both documents hold, word for word"
    docs = spark.createDataFrame([(1, passage, "en", "s", 0), (2, f"x \ufffd y {passage} z \ufffd", "en", "s", 0), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.cut_repeats(spark, docs, "").collect()}
    assert got[2][0].count("\ufffd") == 2 and passage[10:40] not in got[2][0]
    assert got[2][1] == len(got[2][0]) and got[1] == (passage, len(passage)) and got[3][0] is None


def test_bytes_beside_a_cut_make_no_new_character():
    text = "aébcñd".encode()  # bytes: a C3 A9 b c C3 B1 d
    assert without(text, [(2, 6)]) == "ad"  # C3 and B1 would join to a third character
    assert without(text, [(1, 2), (2, 3)]) == "abcñd"
    assert without(text, [(0, 8)]) == "" and without(text, []) == text.decode()
