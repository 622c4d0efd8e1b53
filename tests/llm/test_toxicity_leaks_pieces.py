import math
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
from pyspark.sql import functions as F
from quantloom.llm.decontaminate import budget, drop_contaminated, find_matches, myers, words_of
from quantloom.llm.piece_sampling import Lattice, decode, encode, encode_and_check
from quantloom.llm.queries import op1_toxicity, op9_decontamination
from quantloom.llm.toxicity import build, curve, discounts, drop_toxic, measure, toxicity_scores

D = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def planted(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(400)}x" for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "foul"])
        rows.append((i, " ".join(words), "t", 1.5, 7, 0))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_planted_words(spark):
    rows, labels = planted(random.Random(1), 800)
    rows += [(None, "x", "", 0.0, 0, 0), (901, None, "", 0.0, 0, 0), (902, "", "", 0.0, 0, 0), (903, "a " * 50_000 + "nasty", "", 0.0, 0, 0), (0, rows[0][1], "", 0.0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double, h int, predicted int").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1), (0, 0)], "doc_id long, toxic int")
    got = toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert len(held) > 100 and all((r.doc_id % 5 == 0) == bool(r.predicted) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (901, 902))
    assert next(r.predicted for r in got if r.doc_id == 903) == 1  # a text's length hides no word
    kept = drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity_scores(docs, marks.limit(0)).where("score >= 0.01").count() == 0
    assert toxicity_scores(docs.limit(0), marks).count() == 0


def test_texts_of_nothing_but_toxic_words_are_toxic(spark):
    rows, labels = planted(random.Random(1), 800)
    texts = {901: "nasty", 902: "vile nasty", 903: "foul vile nasty", 904: "w1x nasty w2x", 905: "", 906: "w1x", 907: "w1x w2x w3x"}
    docs = spark.createDataFrame(rows + [(i, t, "t", 1.5, 7, 0) for i, t in texts.items()], "doc_id long, text string, y string, score double, h int, predicted int")
    got = {r.doc_id: r.predicted for r in toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id > 900").collect()}
    assert got == {901: 1, 902: 1, 903: 1, 904: 1, 905: 0, 906: 0, 907: 0}


def kneser_ney(texts):
    """The evidence of a text, by the definition, from training texts (words, toxic)."""
    pairs = [Counter(), Counter()]
    for words, toxic in texts:
        line = ["", *words, ""]
        pairs[toxic].update(zip(line, line[1:], strict=False))
    after, seen, before = [Counter(), Counter()], [Counter(), Counter()], Counter()
    for c in (0, 1):
        for (_, w), n in pairs[c].items():
            after[c][w] += 1
            seen[c][w] += n
    for _, w in set(pairs[0]) | set(pairs[1]):
        before[w] += 1
    model = []
    for counts in (after[0], after[1], before):
        few = Counter(counts.values())
        d = discounts([few[k] for k in (1, 2, 3, 4)])
        model.append((counts, lambda n, d=d: d[min(n, 3) - 1] if n else 0.0, sum(counts.values()), sum(d[min(n, 3) - 1] for n in counts.values()) / sum(counts.values())))

    def shared(w):
        counts, d, size, rest = model[2]
        return (counts[w] - d(counts[w])) / size + rest / (len(counts) + 1)

    def alone(c, w):
        counts, d, size, rest = model[c]
        return (counts[w] - d(counts[w])) / size + rest * shared(w)

    def follows(c, v, w):
        if not (size := seen[c][v]):
            return alone(c, w)
        left = sum(1 for x, _ in pairs[c] if x == v) / size
        return max(pairs[c][v, w] - 1, 0) / size + left * alone(c, w)

    def evidence(words):
        base = math.log(model[1][3] / model[0][3])
        if not words:
            return [0.0] * 5
        ratio = lambda f, *x: math.log(f(1, *x) / f(0, *x))
        counted = [(v, w) for v, w in zip(words, words[1:], strict=False) if max(pairs[0][v, w], pairs[1][v, w]) > 1]
        line = ["", *words, ""]
        # the chance of the closing border is left out where the pair isn't counted, as it says nothing of words
        whole = sum(ratio(follows, v, w) for v, w in zip(line, line[1:], strict=False)) - ratio(alone, "")
        worst = sorted((max(ratio(alone, w) - base, 0) for w in set(words)), reverse=True)
        best = max([(ratio(alone, v) + ratio(follows, v, w)) / 2 for v, w in counted], default=base)
        return [*[sum(worst[:k]) / len(worst[:k]) for k in (1, 2, 3)], max(best - base, 0), whole / len(words) - base]

    return evidence


def test_a_score_is_the_same_whether_the_model_is_broadcast_or_joined(spark):
    given = spark.createDataFrame([("bad worse bad worse fine", 1), ("fine good fine good bad", 0), ("good fine bad", 0)], "text string, y int")
    docs = spark.createDataFrame([(1, "bad worse bad worse bad"), (2, "fine good bad good"), (3, "")], "i long, text string")
    model = build(given)
    joined, broadcast = ({r.i: r.x for r in measure(docs, *model, hot).collect()} for hot in (0, 10**6))
    assert all(math.isclose(a, b, abs_tol=1e-12) for i in broadcast for a, b in zip(joined[i], broadcast[i], strict=True))


def on_disk(spark):
    """The shuffle files of this session, and the tables in its shared folder."""
    import glob

    from quantloom.llm.common import shared_dir

    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}, set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables-*"))


def test_neither_shuffles_nor_tables_stay_on_disk(spark):
    rows, labels = planted(random.Random(3), 300)
    y = dict(labels)
    given = spark.createDataFrame([(r[1], y[r[0]]) for r in rows], "text string, y int").repartition(3)
    docs = spark.createDataFrame([r[:2] for r in rows], "i long, text string")
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, kept = on_disk(spark), [spark.conf.get(k, None) for k in names]
    got = measure(docs, *build(given), 100)
    after = on_disk(spark)
    assert not after[0] - before[0] and not after[1] - before[1]
    assert got.count() == len(rows) and [spark.conf.get(k, None) for k in names] == kept


def test_python_reads_a_model_and_its_texts_in_small_batches(spark, monkeypatch):
    """A worker holds a whole batch, so one of the usual 10,000 texts costs an executor's memory."""
    import quantloom.llm.toxicity as m

    given = spark.createDataFrame([("bad worse bad worse fine", 1), ("fine good fine good bad", 0)], "text string, y int")
    model, real, most = build(given), m.columns_of, spark.sparkContext.accumulator(0)

    def watched(batches, **kw):
        for b in batches:
            most.add(b.num_rows > 1000)
            yield from real(iter([b]), **kw)

    monkeypatch.setattr(m, "columns_of", watched)
    docs = spark.range(3000).select(F.col("id").alias("i"), F.lit("fine bad").alias("text")).coalesce(1)
    assert measure(docs, *model).count() == 3000 and most.value == 0


def test_parts_hold_all_pairs_once(spark):
    from quantloom.llm.toxicity import PARTS, count_pairs

    rows, labels = planted(random.Random(4), 200)
    y = dict(labels)
    given = spark.createDataFrame([(r[1], y[r[0]]) for r in rows], "text string, y int").repartition(2)
    parts = [{(r.w, r.v): (r.t, r.o) for r in count_pairs(given, k).collect()} for k in range(PARTS)]
    want = Counter()
    for _, text, *_ in rows:
        line = ["", *text.split(), ""]
        want.update(zip(line, line[1:], strict=False))
    assert sum(map(len, parts)) == len(set().union(*parts)) == len(want)
    assert sum(sum(n) for p in parts for n in p.values()) == want.total()
    assert all(len(p) < 0.5 * len(want) for p in parts) and not {w for w, _ in parts[0]} & {w for w, _ in parts[1]}


def test_the_broadcast_part_is_filled(spark, monkeypatch):
    """Of equally frequent entries as many are broadcast as fit, not none."""
    import quantloom.llm.toxicity as m

    given = spark.createDataFrame([(" ".join(f"u{i}x{k}" for k in range(50)), i % 2) for i in range(40)], "text string, y int")
    docs = spark.createDataFrame([(1, "u1x1 u1x2 u2x1 new"), (2, "")], "i long, text string")
    sizes, real, model = [], m.Known.__init__, build(given)
    monkeypatch.setattr(m.Known, "__init__", lambda self, part, rest: sizes.append(part.num_rows) or real(self, part, rest))
    half, none = ({r.i: r.x for r in measure(docs, *model, hot).collect()} for hot in (1000, 0))
    assert 800 < sizes[0] < 1200 and sizes[1] == 0
    assert all(math.isclose(a, b, abs_tol=1e-9) for i in none for a, b in zip(half[i], none[i], strict=True))


def test_evidence_equals_the_definition(spark):
    """Counts and evidences by the definition; how much of the model is broadcast changes none."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    draw = lambda n: [rng.choice(vocabulary[: rng.choice([5, 20, 60])]) for _ in range(n)]
    train = [(draw(rng.randrange(0, 30)), int(rng.random() < 0.3)) for _ in range(120)]
    evidence = kneser_ney([x for x in train if x[0]])
    texts = [[], ["zzz"], ["zzz", vocabulary[0]], vocabulary[:1] * 30, *[draw(rng.randrange(1, 40)) for _ in range(40)]]
    given = spark.createDataFrame([(" ".join(w), y) for w, y in train], "text string, y int").repartition(3)
    docs = spark.createDataFrame([(i, ", ".join(w).upper().replace("É", "é")) for i, w in enumerate(texts)], "i long, text string").repartition(3)
    model = build(given)
    for hot in (0, 40, 10**6):
        got = {r.i: r.x for r in measure(docs, *model, hot).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert all(math.isclose(a, b, abs_tol=1e-5) for a, b in zip(got[i], evidence(t), strict=True)), (hot, t, got[i], evidence(t))


def test_query_equals_the_definition_over_a_whole_table(spark):
    """Every score of the query: counts, evidences and curve of a plain program over the same rows."""
    import zlib

    import numpy as np

    d = D.replace("0.01", "0.001")
    docs = {r.doc_id: (words_of(r.text), r.c) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("c")).collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    own = [i for i in sorted(docs) if i in y and zlib.crc32(str(i).encode()) % 4 != 2]
    distinct = {}
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    for i in own:
        if not docs[i][1]:
            distinct.setdefault(raw[i], i)
    evidence = kneser_ney([(docs[i][0], y[i]) for i in distinct.values() if docs[i][0]])
    x = {i: evidence(w) for i, (w, _) in docs.items()}
    known = [i for i in own if docs[i][1]]
    c = curve(np.array([x[i] for i in known]), np.array([y[i] for i in known], float))
    got = op1_toxicity(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x[r.doc_id], c, strict=False)) + c[-1])))
        assert abs(r.score - want) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_query_equals_its_operator_without_broadcast(spark):
    """The whole query on one table: the same scores whichever way words are looked up."""
    tables = [spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels")]
    want = {r.doc_id: r for r in toxicity_scores(*tables, hot=3000).collect()}
    got = op1_toxicity(spark, D).collect()
    assert len(got) == len(want) == tables[0].count()
    assert all(abs(r.score - want[r.doc_id].score) < 1e-4 and r.held_out == want[r.doc_id].held_out for r in got)


def test_toxicity_query_on_held_out_rows(spark):
    got = op1_toxicity(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert len(got) > 50 and hit >= 9 and sum(r.predicted for r in got) - hit <= 3


def edit_distance(p, t):
    """Least edits of p to a part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(300):
        p = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 90))]
        t = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 120))]
        want = edit_distance(p, t)
        assert myers(p, t) == want if want[0] < len(p) else myers(p, t)[0] == len(p)


def test_matches_against_every_place(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, " . ")]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.randrange(0, 2 + budget(len(w)))):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(0, 2)] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
        docs.append((i, ", ".join(words).upper(), "x", 5))
    docs += [(500, None, "x", 5), (501, "", "x", 5), (0, docs[0][1], "x", 5), (None, items[9][1], "x", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string, distance int").repartition(3)
    got = find_matches(df, spark.createDataFrame(items, "item_id int, text string"))
    want = Counter()
    for i, t, *_ in docs:
        for k, p in items:
            w = words_of(p)
            if w and (d := edit_distance(w, words_of(t))[0]) <= budget(len(w)):
                want[i, k, d] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.item_id, r.distance) for r in rows) == want and len(want) > 60
    for r in rows[:60]:
        text = words_of(dict((d[0], d[1]) for d in docs)[r.doc_id])
        assert edit_distance(words_of(dict(items)[r.item_id]), text[r.first_word : r.last_word + 1])[0] == r.distance
    clean = drop_contaminated(df, spark.createDataFrame(items, "item_id int, text string"))
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d[0]) for d in docs if d[0] not in {k[0] for k in want})
    none = spark.createDataFrame([], "item_id int, text string")
    assert find_matches(df, none).count() == 0 and drop_contaminated(df, none).count() == len(docs) and find_matches(df.limit(0), none).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    import quantloom.llm.decontaminate as m

    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    one = sorted(map(tuple, op9_decontamination(spark, D).collect()))
    monkeypatch.setattr(m, "BLOCK", 2000)
    assert sorted(map(tuple, find_matches(docs, items).collect())) == one and len(one) > 10
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if t and r.text in t}
    assert exact <= {(r[0], r[1]) for r in one}


TEXTS = ["", "a  b ", " a", "x▁y", "é漢 　A ｱ ﬁ\n\n x, ok); 'y'", "ab" * 900, "\0 \x7f", "the quick brown fox " * 300, None]


def test_pieces_decode_to_the_text_and_repeat(spark):
    rows = [(i, t, i, "z") for i, t in enumerate(TEXTS)] + [(None, "some words", 1, ""), (7, TEXTS[7], 2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")
    run = lambda d: d.select("doc_id", "text", encode(F.col("text"), F.col("doc_id"), MODEL).alias("p")).withColumn("back", decode(F.col("p"), MODEL)).collect()
    one, two = run(df.repartition(1)), run(df.repartition(5))
    key = lambda r: (str(r.doc_id), r.text or "")
    assert sorted(one, key=key) == sorted(two, key=key)
    assert all(r.back == r.text for r in one) and sum(r.p is None for r in one) == 1
    assert len({tuple(r.p) for r in one if r.doc_id == 7}) == 1
    checked = df.select("doc_id", "text", encode_and_check(F.col("text"), F.col("doc_id"), MODEL).alias("x")).collect()
    assert all(r.x.lossless for r in checked if r.text is not None)
    assert sorted((str(r.doc_id), r.text or "", r.x.ids or []) for r in checked) == sorted((str(r.doc_id), r.text or "", r.p or []) for r in one)
    assert df.limit(0).select(encode(F.col("text"), F.col("doc_id"), MODEL).alias("p")).select(decode(F.col("p"), MODEL)).count() == 0


def test_draws_follow_the_weights():
    lat = Lattice(MODEL)

    def ways(s):
        if not s:
            yield (), 1.0
        for j in range(1, len(s) + 1):
            if s[:j] in lat.weight:
                i, w = lat.weight[s[:j]]
                for rest, x in ways(s[j:]):
                    yield (i, *rest), w * x

    for word in ("those", "is", "notion"):
        every = list(ways(" " + word))
        total = sum(w for _, w in every)
        seen = Counter(tuple(x.tolist()) for x in lat.encode([word] * 6000, list(range(6000))))
        assert set(seen) <= {p for p, _ in every} and len(seen) > 1
        assert sum(abs(seen[p] / 6000 - w / total) for p, w in every) < 0.08
    assert len({tuple(x.tolist()) for x in lat.encode(["those words are here"] * 50, list(range(50)))}) > 5
    other = Lattice(MODEL, seed=1).encode(["those words are here"] * 50, list(range(50)))
    assert [x.tolist() for x in other] != [x.tolist() for x in lat.encode(["those words are here"] * 50, list(range(50)))]


def test_long_chunks_are_one_lattice(monkeypatch):
    """Nothing is cut: filtering a chunk without remembering its beginnings gives the same draws, and pieces go across
    every place of a long one."""
    texts = ["those notions are here", "x" * 30, "  two   spaces", *["".join(random.Random(k).choice("etaoinsh") for _ in range(40)) for k in range(20)]]
    want = [x.tolist() for x in Lattice(MODEL).encode(texts, list(range(len(texts))))]
    monkeypatch.setattr("quantloom.llm.piece_sampling.LONG", 0)
    assert [x.tolist() for x in Lattice(MODEL).encode(texts, list(range(len(texts))))] == want
    monkeypatch.undo()
    lat, text = Lattice(MODEL), "thosenotionsarehere" * 200
    found = lat.encode([text] * 60, list(range(60)))
    assert all(lat.decode(x) == text for x in found)
    cuts = [set(accumulate(len(lat.spelled[i]) for i in x.tolist())) for x in found]
    share = [sum(k in c for c in cuts) / 60 for k in range(19, 19 * 100)]
    usual = [sum(share[k::19]) / len(share[k::19]) for k in range(19)]
    assert all(abs(x - usual[k % 19]) < 0.35 for k, x in enumerate(share)) and min(usual) < 0.9


def test_runs_of_spaces_are_pieces():
    lat = Lattice(MODEL)
    runs = {i for p, (i, _) in lat.pieces.items() if len(p) > 1 and not p.strip(" ")}
    assert len(runs) >= 10
    texts = [" " * n for n in range(1, 40)] + ["if x:\n" + " " * 16 + "return  a  b", "a" + " " * 500 + "b", "\t  \n   ", " " * 7 + "☃" + " " * 3]
    for key in range(5):
        found = lat.encode(texts, [key] * len(texts))
        assert [lat.decode(x) for x in found] == texts
        assert all(runs & set(x.tolist()) for x in found[20:39])
    assert len({tuple(x.tolist()) for x in lat.encode(["if  x:" + " " * 16 + "y"] * 50, list(range(50)))}) > 5


def test_every_evidence_keeps_its_least_weight():
    """Though the whole text's evidence falls where the others rise, the score grows with it."""
    import numpy as np
    from quantloom.llm.toxicity import LEAST

    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.2).astype(float)
    x = np.abs(rng.normal(size=(400, 5))) + y[:, None] * 2
    x[:, 4] = rng.normal(size=400) * 0.1 - y
    c = curve(x, y)
    assert np.all(c[:-1] >= np.array(LEAST) - 1e-12) and c[4] == LEAST[4] and c[0] > LEAST[0]
    assert np.all(curve(np.zeros((5, 5)), np.array([0, 1.0, 0, 0, 0]))[:-1] >= np.array(LEAST) - 1e-9)
