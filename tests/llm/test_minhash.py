import random
from collections import defaultdict

from pyspark.sql import functions as F
from quantloom.llm import minhash
from quantloom.llm.minhash import drop_near_duplicates, near_groups
from quantloom.llm.queries import op7_minhash_dedup

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    """id -> (size, component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    shared, inverted = defaultdict(int), defaultdict(list)
    distinct = {}
    for k, (_, s) in enumerate(sets):
        if s and s in distinct:
            up[root(k)] = root(distinct[s])
        elif s:
            distinct[s] = k
            for h in s:
                for j in inverted[h]:
                    shared[j, k] += 1
                inverted[h].append(k)
    for (j, k), n in shared.items():
        if 100 * n >= percent * (len(sets[j][1]) + len(sets[k][1]) - n):
            up[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def near_texts(rng, groups=30):
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            rows.append((n, rng.choice([" ", "\n", "  "]).join(t)))
            n += 1
    return rows


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    for percent in (80, 85):
        rows = near_texts(rng) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO")]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sk": F.lit(1), "id": F.lit("x"), "stays": F.lit(0)}).repartition(4)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, percent=percent).collect()}
        assert got == brute(rows, percent)
        kept = drop_near_duplicates(df, percent=percent)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, c) in got.items() if i == c)


def test_copies_linked_through_one_text_only(spark):
    """Variants that are near the base and not near each other: a star at a variant finds the base, and the base the rest."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(f"z{i}" for i in range(50)))]
    for k in range(1, 40):
        t = list(base)
        for j in range(7):
            t[10 * ((k * 7 + j) % 39) + 4] = f"v{k}x{j}{rng.random()}"
        rows.append((k, " ".join(t)))
    rows.append((77, " ".join(base)))
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=83).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 83).items()} and got[77] == 1 and got[39] == 1


def test_repeated_rows_null_ids_and_no_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, a + " more"), (1, b), (2, b), (None, a), (None, "only here"), (None, None), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_groups(df)
    assert got.count() == len(rows)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in drop_near_duplicates(df).collect())
    assert len(kept) == 6 and [i for i, _ in kept] == [0, 0, 1, 1, 3, 3] and (0, "only here") in kept and (1, b) in kept
    assert near_groups(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_minhash_dedup(spark, d).collect()}
    assert got == brute(rows, 85)


def test_rounds_leave_no_rows_behind(spark, monkeypatch):
    """A round's rows, each with its set's digits, are tables that are removed, not checkpoints that stay."""
    from pathlib import Path

    from quantloom.functions.storage import shared_dir

    kept, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: kept.append(df.columns) or cut(df))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(["x" * (k + 1) if i == 7 * k else w for i, w in enumerate(words)]) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("tables-*"))
    assert {r["component_id"] for r in minhash.near_groups(docs).collect()} == {0}
    assert kept and not any("d" in columns for columns in kept)
    assert set(folder.glob("tables-*")) == before
