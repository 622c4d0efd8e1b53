import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
from quantloom.llm.collocations import collocations
from quantloom.llm.queries import QUERIES, SQL
from quantloom.llm.spelling import spelling_variants

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, phrase string, f long, w int, word string, n int, k int, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd(rows):
    return [(i, t, g, "x", 1, 2, "y", 3, 4, 5) for i, t, g in rows]


def brute_phrases(rows, max_n=4, least=30, percent=80, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(b >= least and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=300):
    rng = random.Random(seed)
    bits = ["New York city", "new york", "of the", "the", "of", "a\tb  c", "é è", "x!y", "z\x0bz", ",", ".\n", "ÀB"]
    return [(i, None if i % 50 == 7 else " ".join(rng.choices(bits, k=rng.randrange(0, 30))), rng.choice(["en", "en", "de", None])) for i in range(n)]


def test_phrases_equal_brute_force(spark):
    rows = phrase_rows(1)
    df = spark.createDataFrame(odd(rows), ODD).repartition(3)
    for kw in ({}, {"least": 3, "top": 7}, {"max_n": 3, "percent": 50}):
        names = {"least": "min_count", "percent": "held_percent"}
        got = collocations(df, **{names.get(k, k): v for k, v in kw.items()})
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_of_long_texts_repeated_rows_ties_and_no_rows(spark):
    rows = [(1, "one two " * 40000, "en")] * 2 + [(2, "", None), (3, None, None)] + [(None, "b c. a d", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, collocations(df).collect()))
    assert got == brute_phrases(rows) and [g[2] for g in got if g[0] == "und"] == ["a d", "b c"]
    assert collocations(df.limit(0)).count() == 0


def test_phrase_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = QUERIES["op12_collocations"](spark, SMALL)
    want = con.execute(SQL["op12_collocations"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


def brute_variants(rows, ratio=2, slip=97, shortest=5, least=3):
    count = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in by.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= ratio * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(by[w]), words.get(form.get(w), 0)) for w, n in words.items())


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        base = rng.choice(["abcde", "hello", "colour", "aabbcc", "Éclair", "zzzzzz"])
        w = list(base)
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice([["a"], ["b"], [], ["z", "z"], ["é"]])
        rows.append((None if i == 3 else i % 90, None if i == 5 else " ".join(["".join(w)] * rng.choice([1, 2, 5, 9]) + ["abcdefgh" * 9] * 3)))
    df = spark.createDataFrame(odd([(i, t, "l") for i, t in rows]), ODD).repartition(3)
    assert told(spelling_variants(df)) == brute_variants(rows)
    assert told(spelling_variants(df, slip=5, least=1, shortest=3)) == brute_variants(rows, slip=5, least=1, shortest=3)


def test_variants_follow_chains_keep_ties_and_take_any_length(spark):
    chain = ["aaaaa" + "b" * k for k in range(9)]
    text = " ".join(w + " " + (w + " ") * (3 * 2 ** k - 1) for k, w in enumerate(chain)) + "longx " * 9 + "longa longa longa longb longb longb " + "q" * 50000 + "1" + "q" * 50000 + " " + "q" * 50000
    rows = [(1, text), (1, text), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = told(spelling_variants(df, slip=10**9))
    assert got == brute_variants(rows, slip=10**9)
    assert {r[2] for r in got if r[0].startswith("aaaaa")} == {chain[-1]}
    assert spelling_variants(df.limit(0)).count() == 0


def test_variant_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert told(QUERIES["op13_spelling_variants"](spark, SMALL)) == brute_variants(rows)
