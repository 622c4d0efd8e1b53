import base64
import gzip
import hashlib
import io
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.llm.common import WordHashes
from quantloom.llm.line_dedup import drop_boilerplate_lines, spread_lines
from quantloom.llm.quality import BUCKETS, LANGUAGES, MEASURES, SITES, Logistic, balance, co_train, measures, quality_scores
from quantloom.llm.queries import op2_warc, op3_line_dedup, op5_quality
from quantloom.llm.warc import Counted, inflated, normalise_archive, normalise_archives, read_archives, read_index, record, write_archives

D = "/root/testdata/sf0.01"
B32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute_warc(rows):
    least, out = {}, []
    for i, h in rows:
        b = (h or "").encode()
        k = (i is None, i or 0)
        least[b] = min(least.get(b, k), k)
    for i, h in rows:
        b = (h or "").encode()
        again = (i is None, i or 0) != least[b]
        out.append((i, len(b), B32(b), "revisit" if again else "response", least[b][1] if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    pages = [(i, f"http://a/{i}", rng.choice([None, "", "same page", "é漢\r\n\r\nWARC/1.1\r\n", "x" * rng.randrange(5000)])) for i in range(300)] + [(900, None, "y" * 3_000_000), (None, "u", "only null"), (None, "u", "same page"), (901, "a b\nc", "z")]
    df = spark.createDataFrame([(u, p, h, "x", 5) for p, u, h in pages], "url string, page_id long, html string, payload string, first int").repartition(4)
    raw = write_archives(df, str(tmp_path / "raw"))
    members = normalise_archives(raw, str(tmp_path / "members"))
    index = read_index(members)
    got = read_archives(index).collect()
    assert sorted(((int(r.id) if r.id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in got), key=str) == brute_warc([(p, h) for p, _, h in pages])
    texts = {p: h for p, _, h in pages}
    assert all((r.payload or b"").decode() == (texts[int(r.id)] or "") for r in got if r.record_type == "response" and r.id)
    for r in members.collect():  # every record is a member of its own, and the members are the file
        data, at = Path(r.path).read_bytes(), 0
        for line in Path(r["index"]).read_text().splitlines():
            name, offset, length = line.split("\t")
            assert int(offset) == at and gzip.decompress(data[at : at + int(length)]).startswith(b"WARC/1.1\r\n") and name.encode() in gzip.decompress(data[at : at + int(length)])
            at += int(length)
        assert at == len(data) and r.records == len(Path(r["index"]).read_text().splitlines())
    assert sum(1 for r in raw.collect()) == len({r.path for r in raw.collect()})
    none = read_archives(read_index(normalise_archives(write_archives(df.limit(0), str(tmp_path / "none")), str(tmp_path / "none2"))))
    assert none.count() == 0
    assert write_archives(df, str(tmp_path / "big"), least=10).count() > 0


def test_equal_rows_have_one_response(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "p")] * 3 + [(2, "u", "p")] * 2, "page_id long, url string, html string").repartition(3)
    got = read_archives(read_index(normalise_archives(write_archives(df, str(tmp_path / "r")), str(tmp_path / "m")))).collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in got) == [("1", "response", None), ("1", "revisit", "1"), ("1", "revisit", "1"), ("2", "revisit", "1"), ("2", "revisit", "1")] or sorted((r.id, r.record_type) for r in got) == [("1", "response"), ("1", "revisit"), ("1", "revisit"), ("2", "revisit"), ("2", "revisit")]


def test_broken_archives_are_told():
    whole = record("1", "u", b"abc" * 100, None, False)
    for cut in (10, len(whole) - 20):
        with pytest.raises(ValueError, match="ends within"):
            list(normalise_archive(io.BytesIO(gzip.compress(whole + whole[:cut])), Counted(io.BytesIO())))
    assert len(list(normalise_archive(io.BytesIO(gzip.compress(whole) + gzip.compress(whole)), Counted(io.BytesIO())))) == 2
    assert b"".join(inflated(io.BytesIO(gzip.compress(b"")))) == b""


def test_warc_query_matches_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{D}/pages.parquet").collect()]
    assert sorted(map(tuple, op2_warc(spark, D).collect()), key=str) == brute_warc(rows)


def brute_lines(rows, least):
    sites = defaultdict(set)
    for _, s, t in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                sites[line.strip(" \t\n\x0b\x0c\r")].add(s)
    bad = {x for x, s in sites.items() if len(s) >= least}
    return bad, [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad)) for i, _, t in rows]


def test_lines_against_brute_force(spark, monkeypatch):
    import quantloom.llm.line_dedup as m

    rng = random.Random(4)
    spots = [f" line {i} é\t" for i in range(80)]
    rows = [(i, rng.choice([None, *[f"s{k}" for k in range(int(3 + i % 40))]]), rng.choice([None, "", "\n\n"] + ["\n".join(rng.choice(spots) + rng.choice(["", " ", "x" * (i % 3)]) for _ in range(rng.randrange(1, 12)))] * 9)) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, text string, h int, site string").repartition(4)
    for least in (5, 15, 25):
        bad, want = brute_lines(rows, least)
        assert spread_lines(df, min_sites=least).count() == len(bad) > 0
        monkeypatch.setattr(m, "BLOCK", 7)
        got = drop_boilerplate_lines(df, min_sites=least)
        assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
        monkeypatch.undo()
    assert drop_boilerplate_lines(df.limit(0)).count() == 0


def test_line_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = {i: t or "" for i, t in brute_lines(rows, 10)[1]}
    got = op3_line_dedup(spark, D).collect()
    assert len(got) == len(rows) and all(r.text_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.n_chars == len(want[r.doc_id]) for r in got)


class Local:
    """A pool in memory, row by row as the definition says."""

    def __init__(self, views):
        self.views = views

    def counts(self, models, line):
        z = [m.logit(v) for m, v in zip(models, self.views, strict=True)]
        return [(int((x < -line).sum()), int((x > line).sum())) for x in z]

    def sums(self, teachers, weights, line, models):
        out = []
        for k in (0, 1):
            gradient, second = np.zeros(len(models[k].weights)), np.zeros((len(models[k].weights),) * 2)
            for says, row in zip(teachers[1 - k].logit(self.views[1 - k]), models[k].design(self.views[k]), strict=True):
                if abs(says) > line:
                    p = 1 / (1 + np.exp(-np.clip(row @ models[k].weights, -30, 30)))
                    w = weights[1 - k][int(says > 0)]
                    gradient += w * (float(says > 0) - p) * row
                    second += w * p * (1 - p) * np.outer(row, row)
            out.append((gradient, second))
        return out


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 6000).astype(float)
    a, b = y[:, None] * 3 + rng.normal(size=(6000, 4)), y[:, None] * 3 + rng.normal(size=(6000, 4))
    one, two = co_train((a[:12], b[:12]), y[:12], Local((a[12:4000], b[12:4000])))
    alone, _ = co_train((a[:12], b[:12]), y[:12], Local((a[:0], b[:0])))
    right = lambda m, v: ((m.logit(v[4000:]) > 0) == (y[4000:] > 0.5)).mean()
    assert right(one, a) > 0.97 and right(two, b) > 0.97 and right(one, a) >= right(alone, a) - 0.002


def test_pseudo_labels_keep_the_classes_shares():
    for bad, good, share in ((100, 900, 0.5), (50, 50, 0.8), (7, 0, 0.5), (0, 0, 0.3)):
        no, yes = balance(bad, good, share)
        assert 0 <= no <= 0.5 and 0 <= yes <= 0.5 and max(no, yes) in (0.5, 0.0)
        if bad and good:
            assert abs(good * yes / (good * yes + bad * no) - share) < 1e-9
    assert balance(7, 0, 0.5)[0] == 0.0


def test_quality_query_equals_a_local_fit(spark):
    """The whole query against one fit in memory over all its rows."""
    import zlib

    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = {r.doc_id: r for r in op5_quality(spark, D).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    group = lambda c, n: F.pmod(F.xxhash64(F.coalesce(c, F.lit("\0"))), F.lit(n)).cast("int")
    rows = docs.select("doc_id", "text", group("source", SITES).alias("site"), group("lang", LANGUAGES).alias("lang"), F.log1p(F.col("n_chars").cast("double")).alias("size")).toPandas()
    hashes = WordHashes()
    text = np.stack([measures(t, hashes) for t in rows["text"]]).astype(float)
    meta = np.zeros((len(rows), SITES + LANGUAGES + 1))
    for k, r in enumerate(rows.itertuples()):
        meta[k, r.site], meta[k, SITES + r.lang], meta[k, -1] = 1, 1, r.size
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in rows["doc_id"]])
    y = np.array([marks.get(i, np.nan) for i in rows["doc_id"]], float)
    fit, hold, pool = ~np.isnan(y) & (part < 2), ~np.isnan(y) & (part == 3), np.isnan(y) & (part != 2)
    models = co_train((text[fit], meta[fit]), y[fit], Local((text[pool], meta[pool])))
    z = np.stack([m.logit(v) for m, v in zip(models, (text, meta), strict=True)], 1)
    score = 1 / (1 + np.exp(-Logistic.fit(z[hold], y[hold]).logit(z)))
    assert len(got) == len(rows)
    for i, s, p in zip(rows["doc_id"], score, part, strict=True):
        assert abs(got[i].score - s) < 1e-4 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (p == 2)


def test_quality_query_on_held_out_rows(spark):
    got = op5_quality(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert op5_quality(spark, D).count() == spark.read.parquet(f"{D}/documents.parquet").count()


def test_quality_of_odd_rows(spark):
    rows = [(i, f"w{i} " * 20, None, None, None, 1) for i in range(40)] + [(None, None, "s", "en", 5, 1), (50, "", "s", "en", -3, 1), (3, "again", "", "", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, y int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (5, None), (5, 0)], "doc_id long, quality int")
    assert quality_scores(df, marks).count() == len(rows)
    assert {r.score for r in quality_scores(df, marks.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality_scores(df, marks.where("quality = 1")).collect()} == {1}
    assert quality_scores(df.limit(0), marks).count() == 0
    assert len(measures(None, WordHashes())) == len(measures("a b\n\nc", WordHashes())) == MEASURES + BUCKETS


def test_one_response_among_equal_rows_however_partitions_are_split(spark, tmp_path):
    """Repeated rows, with joins whose partitions adaptive execution splits: each payload has one response."""
    rows = [(i % 17, f"http://h/{i % 5}", f"page {i % 11} " + "x" * 200) for i in range(3000)] + [(None, None, "page 3 " + "x" * 200), (None, None, None), (None, None, None), (4, "http://z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        back = read_archives(read_index(normalise_archives(write_archives(pages, f"{tmp_path}/a"), f"{tmp_path}/b"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(back) == len(rows)
    least = {}
    for i, _, t in rows:
        least.setdefault(t or "", []).append(10**9 if i is None else i)
    responses = {}
    for r in back:
        if r.record_type == "response":
            assert r.payload_digest not in responses
            responses[r.payload_digest] = int(r.id or 10**9)
    assert sorted(responses.values()) == sorted(map(min, least.values()))
    assert all(int(r.refers_to) == responses[r.payload_digest] for r in back if r.record_type == "revisit")
