"""The queries over a whole table against the libraries themselves."""

import public_tokenizers
from quantloom.llm.queries import QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, folder=SMALL):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_of_all_documents_are_the_librarys(spark):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts(spark)
    got = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, SMALL).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_sampled_pieces_of_all_documents_decode_and_come_again(spark):
    want = texts(spark)
    one, two = ({r.doc_id: (r.n_bytes, r.n_pieces, r.pieces_hash, r.lossless) for r in QUERIES["op6_piece_sampling"](spark, SMALL).repartition(k).collect()} for k in (1, 3))
    assert one == two and set(one) == set(want)
    for i, t in want.items():
        assert one[i][0] == len(t.encode()) and one[i][3] and (one[i][1] > 0) == bool(t)


def test_contaminated_documents_are_those_that_every_place_shows(spark):
    """Each item against each place of each document, a row of the table of distances at a time."""
    import numpy as np
    from quantloom.llm.decontaminate import budget, words_of

    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{MORE}/benchmark.parquet").collect()]
    number: dict = {}
    coded = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    docs, want = [(i, coded(words_of(t))) for i, t in texts(spark, MORE).items()], set()
    for item, words in items:
        if not len(words):
            continue
        p = coded(words)
        for i, t in docs:
            row, at = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
            for k, w in enumerate(p, 1):
                best = np.minimum(row[:-1] + (t != w), row[1:] + 1)
                row = np.minimum.accumulate(np.concatenate([[k], best]) - at) + at
            if row.min() <= budget(len(p)):
                want.add((i, item, int(row.min())))
    got = [(r.doc_id, r.item_id, r.distance) for r in QUERIES["op9_decontamination"](spark, MORE).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
