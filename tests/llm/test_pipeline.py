import importlib.util
import sys
from pathlib import Path

import duckdb
import numpy as np
from test_near_copies import brute_classes
from test_suffix_index import N
from test_toxicity import brute_chain

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp

from vacantia.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        before = rows_of(kept)
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(cp.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns)
            after = rows_of(out)
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = before.keys() - after.keys()
            assert all(labels.get(d, 1) for d in gone)
            chain = toxicity.train(kept, toxicity.label_table(spark.read.parquet(f"{SF}/labels.parquet")), toxicity.CATEGORIES)
            assert gone == {d for d, t in before.items() if brute_chain(chain, t)[1] >= chain.thresholds[1]}
        elif name == "simhash":
            classes = brute_classes(before)
            assert after.keys() == set(classes.values())
        elif name == "suffix_dedup":
            least = {}
            for d in sorted(before):
                b = before[d].encode()
                for k in range(len(b) - N + 1):
                    least.setdefault(b[k : k + N], d)
            for d, t in before.items():
                b = t.encode()
                gone = np.zeros(len(b), dtype=bool)
                for k in range(len(b) - N + 1):
                    if least[b[k : k + N]] < d:
                        gone[k : k + N] = True
                left = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
                assert after[d] == left
        elif name == "decontaminate":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/suffix_dedup/*.parquet')")
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
            leaked = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({decontaminate.report_sql()})").fetchall()}
            assert leaked and after.keys() == before.keys() - leaked
        kept = out
    rows = kept.collect()
    tok = importlib.util.find_spec("tokenizers")
    if tok:
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        assert all(t.encode(after[r["doc_id"]], add_special_tokens=False).ids == r["ids"] for r in rows)
    assert {r["doc_id"] for r in rows} == after.keys()


def test_nulls_and_repeats(spark):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", None, None, 0), (None, "text without id", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        # a null text is an empty one, so rows 1 and 2 are copies
        assert {r["doc_id"] for r in out.collect()} >= {None, 1}, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_and_not_ids_go(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, bench), (None, bench), (6, f"{b} {bench}"), (6, "other words of a clean text"), (7, "seven"), (7, "seven"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert key(cp.drop_near_copies(spark, docs, SF)) == sorted([(1, a), (5, b), (None, bench), (6, f"{b} {bench}"), (6, "other words of a clean text"), (7, "seven"), (None, None)], key=str)
    assert key(cp.drop_leaks(spark, docs, SF)) == sorted([r for r in rows if not r[1] or bench not in r[1]], key=str)
