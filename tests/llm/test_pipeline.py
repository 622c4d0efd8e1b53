import re
import shutil

import public_tokenizers
from quantloom.llm.decontaminate import budget, words_of
from quantloom.llm.piece_sampling import Lattice
from quantloom.llm.toxicity import toxicity_scores
from test_minhash import brute
from test_toxicity_leaks_pieces import edit_distance

import corpus_pipeline

D = "/root/testdata/sf0.001"


def brute_stages(docs, items):
    """What stages two to four keep of (doc_id, text) rows."""
    least = {}
    for i, t in sorted(docs):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    docs = sorted(least.values())
    groups = brute(docs, 80)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    items = [w for w in map(words_of, items) if w]
    # an item with few edits leaves one of its five-word runs whole
    runs = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in items]

    def leaks(text):
        own = words_of(text)
        have = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}
        return any(r & have and edit_distance(w, own)[0] <= budget(len(w)) for w, r in zip(items, runs, strict=True))

    return [(i, t) for i, t in docs if not leaks(t)]


def test_run_matches_brute_force(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    calm = {r.doc_id for r in toxicity_scores(docs, labels).where("predicted = 0").collect()}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = brute_stages([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in calm], items)
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want)
    lattice = Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(want)
    for r in got:
        assert r.lossless and r.n_pieces == len(r.piece_ids)
        assert r.piece_ids == lattice.encode([texts[r.doc_id] or ""], [r.doc_id])[0].tolist()


def test_stages_keep_the_columns_and_stand_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{D}/{t}.parquet", tmp_path)
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (2, "", None, None, None), (3, "word " * 3000, "en", "a", 15000), (4, "a b c d e f g", "en", "a", 13), (5, "a  b c d e f g", "en", "b", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        kept = sorted(str(r.doc_id) for r in now.collect())
        assert kept == ([] if table is not docs else ["1", "3", "4"])
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).where("lossless").count() == len(kept)


def test_each_stage_is_one_operators_work():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "piece_sampling"]
    assert corpus_pipeline.ORACLE_SQL is None
