import hashlib
import random
import re

import public_tokenizers
import pytest
from quantloom.llm.exact_dedup import drop_exact_duplicates, exact_groups
from quantloom.llm.license_scan import scan_licenses
from quantloom.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, dg string, id int, row int, kept int, first string, n_words int, labels string"


def odd_rows(texts):
    return [(i, t, None, 1, 2, 3, "x", None, None) for i, t in texts]


def brute_groups(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    by = {}
    for i, t in norm:
        by.setdefault(t, []).append(i)
    return sorted((i, min(by[t]), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " ", "a  b", "a\tb", "a b", "hot"] + [f"t{rng.randrange(40)}"] * 5)) for i in range(400)] + [(1000 + i, "hot \n text") for i in range(200)]
    df = spark.createDataFrame(odd_rows(rows), ODD).repartition(5)
    got = exact_groups(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    few = exact_groups(df, tracked=64, share=3).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, got))
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_exact_groups_of_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c"), (2, "d")] + [(7, "h")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_groups(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256[:2], r.group_size) for r in got if r.kept) == sorted((i is None, i or 0, hashlib.sha256(t.encode()).hexdigest()[:2], n) for i, t, n in [(1, "a", 3), (None, "b", 1), (2, "c", 1), (2, "d", 1), (7, "h", 30)])
    assert sorted((r.doc_id or 0, r.text) for r in drop_exact_duplicates(df).collect()) == [(0, "b"), (1, "a"), (2, "c"), (2, "d"), (7, "h")]
    assert exact_groups(df.limit(0)).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0


def test_exact_duplicates_go_whatever_the_columns_are_called(spark):
    names = ["__exact_dg", "__exact_first", "__exact_n", "_own0", "_own1", "_OWN2", "dg", "row"]
    rows = [(i, t, *range(8)) for i, t in enumerate(["a b", "a  b", None, "", "x" * 3_000_000, "x" * 3_000_000] + ["hot"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6]
    assert sorted(tuple(r)[2:] for r in kept.collect()) == [tuple(range(8))] * 4


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


TEXTS = [None, "", " ", "\n\n", "a b", "a   b   c", "x!\x1cy \x1f z", "it's <|endoftext|> here<|endoftext|>", "é 漢字 😀😀", "a" * 3000, " " * 700 + "z", "don't stop\r\n\r\n  now", "​ a　　b"]


def test_token_counts_are_the_librarys(spark, library):
    df = spark.createDataFrame(odd_rows(list(enumerate(TEXTS))), ODD)
    got = {r.doc_id: r for r in count_tokens(df, PATH).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (library(t), len((t or "").encode()), library(t) > 1024), repr(t)
    assert count_tokens(df.limit(0), PATH).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(rows, PATH).collect()) == [(0, 2), (3, 1), (3, 1)]


def test_huge_texts_are_spliced_where_both_chunks_agree(library):
    rng, c = random.Random(2), Counter(PATH)
    bits = ["word ", "don't ", "  ", "\n", "12345", "!?!", "<|endoftext|>", "é", "漢字", " ", " " * 40, "x" * 50, "|endoftext|>", "<|"]
    for n in range(60):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(50, 500)))
        assert c.huge(t, rng.choice([200, 300, 500]), rng.choice([70, 100])) == library(t), n
    for t in ["a" * 5000, " " * 5000, "ab" * 900 + " " + "cd" * 900, "!" * 3000 + " x" * 500]:
        assert c.huge(t, 300, 80) == library(t)


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", None, "", "Released undr the MIT Licence, and more", "plain words only", "Licensed under CC BY-NC 4.0. cc by nc CC-BY-NC",
        "x " * 5000 + "This work is licensed under the GNU General Public License, version 3.", "licensed under the apache licence, versoin 2.0", "under the mit licenses",
    ]
    df = spark.createDataFrame(odd_rows(list(enumerate(texts))), ODD)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (5, 1, 1, 1, "mit", 1.0)
    for i in (1, 2, 4):
        assert (got[i].n_base, got[i].first_word, got[i].last_word, got[i].labels, got[i].score) == (0, None, None, "", 0.0)
    assert got[3].base_labels == "" and got[3].labels == "mit" and 0.8 < got[3].score < 1 and got[3].spans[0].first_word == 0
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].labels) == (3, 2, 10, "cc-by-nc")
    assert got[6].labels == "gpl-3" and got[6].spans[0].first_word == 5003 and got[6].spans[0].edits == 0
    assert got[7].labels == "apache-2" and got[7].base_labels == ""
    assert got[8].n_base == 0
    assert scan_licenses(df.limit(0)).count() == 0


def test_fuzzy_notices_against_every_place(spark):
    import regex
    from quantloom.llm.license_scan import NOTICES, Scanner, budget

    rng, s = random.Random(3), Scanner({}, NOTICES)
    for _ in range(150):
        notice, label = rng.choice(list(NOTICES.items()))
        t = list(notice)
        for _ in range(rng.randrange(0, budget(notice) + 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["q"], [t[k], "q"]])
        line = " ".join(("ab cd " * rng.randrange(0, 9) + "".join(t) + " ef gh" * rng.randrange(0, 9)).split())
        want = {lab for n, lab in NOTICES.items() if regex.search(rf"(?<![^ ])(?:{n}){{e<={budget(n)}}}(?![^ ])", line)}
        assert {x[0] for x in s.fuzzy(f" {line} ")} == want, line


def test_exact_notices_get_their_own_label_only(spark):
    from quantloom.llm.license_scan import BASE, NOTICES

    texts = {k: f"one two. This is {n.title()}, and more" for k, n in enumerate(NOTICES)}
    texts |= {100: "under the mit license and licensed under the gnu general public license, version 3", 101: None}
    rows = [*texts.items(), (None, "released under the mit license"), (0, texts[0])]
    got = [(r.doc_id, r.labels) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    for k, (n, label) in enumerate(NOTICES.items()):
        assert set(lab for i, lab in got if i == k) == {label}, n
    assert dict(got)[100] == "gpl-3,mit" and dict(got)[101] == "" and dict(got)[None] == "mit"
    assert all(any(p in n for n in NOTICES) or p in "cc by nc" for p in BASE)


def test_license_query_matches_brute_force(spark):
    """Base columns by a plain search for words in a row; labels against a fuzzy search of whole texts, overlaps settled."""
    import re

    import regex
    from quantloom.llm.license_scan import BASE, NOTICES, Scanner, budget
    from quantloom.llm.queries import op4_license_scan

    d, s = "/root/testdata/sf0.001", Scanner(BASE, NOTICES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op4_license_scan(spark, d).collect()}
    assert got.keys() == texts.keys()
    word, found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0
    for i, t in texts.items():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, lab) for p, lab in BASE.items() for k in range(len(words)) if words[k : k + p.count(" ") + 1] == p.split())
        r = got[i]
        base = {lab for _, lab in at}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)))
        line = " ".join(words)
        every = {lab for n, lab in NOTICES.items() if regex.search(rf"(?<![^ ])(?:{n}){{e<={budget(n)}}}(?![^ ])", line)}
        assert {x[0] for x in s.fuzzy(f" {line} ")} == every
        own = set(filter(None, r.labels.split(",")))
        assert base <= own <= base | every and bool(own) == bool(base | every)
        found += bool(own)
    assert found == 3


def test_notices_of_a_long_text_take_time_in_proportion():
    import time

    from quantloom.llm.license_scan import BASE, NOTICES, Scanner

    scanner, took = Scanner(BASE, NOTICES), []
    some = " ".join(NOTICES) + " under the mit license, cc by nc. "
    for n in (40, 400):
        text = (some.replace("software", "softwere") + "other words between them. ") * n
        t = time.time()
        out = scanner.scan(text)
        took.append(time.time() - t)
        assert out[1] == scanner.scan(some)[1] * n and len(out[7]) >= n
    assert took[1] < 30 * took[0] + 1 and took[1] < 60, took
