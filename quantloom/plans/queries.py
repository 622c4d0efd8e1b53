"""Named queries of the matrix operators over the test tables, each with the SQL that says the same where SQL can.

Numbers are rounded to DIGITS decimals on either side, since sums are added up in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_dir
from ..operators import annotate, cluster, compare, decoys, filters, impute, learn, normalize, quantify, scaling
from ..sources import diann, tables
from . import fixtures as fx

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CELLS = """
raw AS (SELECT l_partkey AS row_id, l_suppkey % 12 AS s, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS (SELECT row_id, 's' || lpad(CAST(s AS VARCHAR), 2, '0') AS sample, v AS value FROM raw),
planted AS (SELECT row_id, 's' || lpad(CAST(s AS VARCHAR), 2, '0') AS sample, v * CASE WHEN s >= 6 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM raw JOIN part ON row_id = p_partkey),
features AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 97 = 0 THEN 'contam_' ELSE '' END || p_brand || '/' || p_type || CASE WHEN p_partkey % 89 = 0 THEN ';' ELSE '' END AS Protein,
  p_name AS PeptideSequence, p_size % 4 + 1 AS Charge, p_retailprice AS RetentionTime, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS Decoy,
  CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 50000 AS PeptideQValue, CAST(p_partkey * 104729 % 1000 AS DOUBLE) / 50000 AS ProteinQValue FROM part),
samples AS (SELECT 's' || lpad(CAST(i AS VARCHAR), 2, '0') AS sample, CAST(i AS INTEGER) AS sample_ord, CASE WHEN i < 6 THEN 1 ELSE 2 END AS grp, CAST(i % 3 + 1 AS INTEGER) AS batch,
  's' || lpad(CAST((i + 6) % 12 AS VARCHAR), 2, '0') AS pair, CAST(i * 3 + 20 AS INTEGER) AS age, CASE WHEN i % 2 = 0 THEN 'f' ELSE 'm' END AS gender FROM range(12) t(i)),
grid AS (SELECT f.row_id, s.sample, c.value FROM features f CROSS JOIN samples s LEFT JOIN cells c ON c.row_id = f.row_id AND c.sample = s.sample)"""
#: mean-normalised log2 values with the planted effect
NORM = """,
stat AS (SELECT sample, avg(value) AS m FROM planted GROUP BY 1),
norm AS (SELECT row_id, p.sample, log2(value * (SELECT avg(m) FROM stat) / m) AS value FROM planted p JOIN stat USING (sample))"""


def query(name: str, sql: str | None = None, base: str = CELLS):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {base.strip()}{sql}" if base else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})


def m(spark, d, planted=False):
    return fx.matrix(spark, d, planted)


def norm(spark, d):
    x = m(spark, d, True)
    return normalize.normalize(x.cells, "mean"), x


V = "round(value, 6) AS value"

# -- sources and sinks


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def _written(spark, d) -> str:
    x = m(spark, d)
    path = _folder(spark)
    x.write(path)
    return path


@query("write_tsv", ", x AS (SELECT count(*) AS n, count(value) AS observed, round(sum(value), 2) AS total FROM grid) SELECT * FROM x")
def write_tsv(spark, d):
    wide = tables.scan_quant_tsv(spark, _written(spark, d))
    cells, _ = tables.split_matrix(wide.withColumn("row_id", F.monotonically_increasing_id()), m(spark, d).get_samples())
    return cells.agg(F.count("*").alias("n"), F.count("value").alias("observed"), F.round(F.sum("value"), 2).alias("total"))


@query("scan_quant_tsv", f" SELECT PeptideSequence, Protein, sample, {V} FROM grid JOIN features USING (row_id) WHERE value IS NOT NULL")
def scan_quant_tsv(spark, d):
    wide = tables.scan_quant_tsv(spark, _written(spark, d))
    cells, feats = tables.split_matrix(wide.withColumn("row_id", F.monotonically_increasing_id()), m(spark, d).get_samples())
    return rounded(cells.where("value IS NOT NULL").join(feats.select("row_id", "PeptideSequence", "Protein"), "row_id").drop("row_id"))


SUPPLIERS = """WITH sup AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS sample, CAST(s_suppkey AS INTEGER) AS sample_ord, CAST(s_nationkey % 2 + 1 AS INTEGER) AS "group", CAST(s_nationkey % 3 + 1 AS INTEGER) AS batch,
  's' || lpad(CAST(s_suppkey + CASE WHEN s_suppkey % 2 = 1 THEN 1 ELSE -1 END AS VARCHAR), 9, '0') AS pair, CAST(floor(s_acctbal) AS INTEGER) AS age, CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender FROM supplier)"""


def _suppliers(spark, d):
    """A matrix whose samples are the suppliers."""
    x = m(spark, d)
    return type(x)(x.cells, x.features, fx.supplier_design(spark, d))


@query("scan_design_tsv", SUPPLIERS + " SELECT * FROM sup", "")
def scan_design_tsv(spark, d):
    path = _folder(spark)
    design = fx.supplier_design(spark, d)
    tables.write_tsv(design.toDF(*[c.capitalize() for c in design.columns]), path)
    return tables.scan_design_tsv(spark, path)


@query("scan_dataframe", f" SELECT row_id, sample, {V} FROM cells")
def scan_dataframe(spark, d):
    return rounded(m(spark, d).cells)


@query("split_matrix", f" SELECT row_id, sample, {V} FROM grid")
def split_matrix(spark, d):
    x = m(spark, d)
    return rounded(tables.split_matrix(x.to_df(), x.get_samples())[0])


@query("sort_rt", " SELECT RetentionTime, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT RetentionTime, row_number() OVER (ORDER BY RetentionTime) - 1 AS k FROM features) GROUP BY 1")
def sort_rt(spark, d):
    out = tables.number_rows(fx.features(spark, d).drop("row_id"))
    return out.groupBy("RetentionTime").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query("to_df", " SELECT row_id, " + ", ".join(f"round(max(value) FILTER (sample = 's{i:02d}'), 6) AS s{i:02d}" for i in range(12)) + " FROM grid GROUP BY row_id")
def to_df(spark, d):
    x = m(spark, d)
    return rounded(x.to_df().select("row_id", *x.get_samples()))


@query("to_ml", " SELECT sample, CAST(grp - 1 AS DOUBLE) AS label, count(*) AS n_features, round(sum(coalesce(value, 0)), 2) AS total FROM grid JOIN samples USING (sample) GROUP BY 1, 2")
def to_ml(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return m(spark, d).to_ml().select("sample", "label", F.size(v).cast("long").alias("n_features"), F.round(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), 2).alias("total"))


@query("format_data", " SELECT sample, row_id, round(coalesce(value, 0), 6) AS value FROM grid")
def format_data(spark, d):
    x = m(spark, d)
    return rounded(impute.constant(impute.grid(x.cells, x.features, x.samples), 0.0).select("sample", "row_id", "value"))


REPORT = """
first AS (SELECT l_suppkey % 12 AS s, l_partkey, arg_min({'q': l_quantity, 'p': l_extendedprice, 'd': l_discount}, l_orderkey * 100 + l_linenumber) AS x FROM lineitem GROUP BY 1, 2),
report AS (SELECT 'run' || s AS sample, p_brand AS Protein, CAST(l_partkey AS VARCHAR) AS PrecursorId, p_name AS PeptideSequence, p_size AS Charge, x.q AS RT,
  CASE WHEN l_partkey % 50 = 0 THEN 0.0 ELSE x.p END AS value, x.d AS q, CAST(l_partkey % 7 AS DOUBLE) / 1000 AS PeptideQValue, CAST(l_partkey % 5 AS DOUBLE) / 1000 AS ProteinQValue FROM first JOIN part ON l_partkey = p_partkey),
kept AS (SELECT * FROM report WHERE q <= 0.05)"""


@query("diann_qfilter", " SELECT sample || '.mzML.x' AS \"Run\", PrecursorId AS \"Precursor.Id\", value AS \"Precursor.Quantity\", q AS \"Q.Value\" FROM kept", REPORT)
def diann_qfilter(spark, d):
    return diann.q_filter(fx.report(spark, d), 0.05).select("Run", "`Precursor.Id`", "`Precursor.Quantity`", "`Q.Value`")


COLS = "sample, Protein AS \"Protein.Ids\", PrecursorId AS \"Precursor.Id\", PeptideSequence AS \"Modified.Sequence\", Charge AS \"Precursor.Charge\", RT, value, PeptideQValue, ProteinQValue"


@query("diann_colpick", f" SELECT {COLS} FROM kept", REPORT)
def diann_colpick(spark, d):
    return diann.pick_columns(diann.q_filter(fx.report(spark, d), 0.05))


@query("diann_runname", " SELECT DISTINCT sample FROM report", REPORT)
def diann_runname(spark, d):
    return fx.report(spark, d).select(diann.run_name(F.col("Run")).alias("sample")).distinct()


@query("diann_rt_median", ' SELECT Protein AS "Protein.Ids", PrecursorId AS "Precursor.Id", PeptideSequence AS "Modified.Sequence", Charge AS "Precursor.Charge", median(RT) AS RetentionTime FROM kept GROUP BY ALL', REPORT)
def diann_rt_median(spark, d):
    return diann.rt_medians(diann.pick_columns(diann.q_filter(fx.report(spark, d), 0.05)))


@query("diann_pivot", f" SELECT {COLS.replace('RT, value', 'nullif(value, 0) AS value')} FROM kept", REPORT)
def diann_pivot(spark, d):
    return diann.pivoted(diann.pick_columns(diann.q_filter(fx.report(spark, d), 0.05)))


FULL = """, rt AS (SELECT PrecursorId, median(RT) AS RetentionTime FROM kept GROUP BY 1)
SELECT Protein, PrecursorId, PeptideSequence, Charge, PeptideQValue, ProteinQValue, RetentionTime, sample, nullif(value, 0) AS value FROM kept JOIN rt USING (PrecursorId)"""


@query("scan_diann", FULL, REPORT)
def scan_diann(spark, d):
    return diann.scan_diann(fx.report(spark, d), 0.05)


@query("diann_join_rt", FULL.replace("SELECT Protein, PrecursorId, PeptideSequence, Charge, PeptideQValue, ProteinQValue, RetentionTime, sample, nullif(value, 0) AS value", "SELECT sample, PrecursorId, RetentionTime"), REPORT)
def diann_join_rt(spark, d):
    return diann.scan_diann(fx.report(spark, d), 0.05).select("sample", "PrecursorId", "RetentionTime")


@query("diann_rename", " SELECT DISTINCT Protein, PrecursorId, PeptideSequence, Charge FROM report", REPORT)
def diann_rename(spark, d):
    return diann.rename(fx.report(spark, d).select("`Protein.Ids`", "`Precursor.Id`", "`Modified.Sequence`", "`Precursor.Charge`")).distinct()


@query("diann_zero_null", " SELECT sample, PrecursorId, nullif(value, 0) AS value FROM kept", REPORT)
def diann_zero_null(spark, d):
    return diann.scan_diann(fx.report(spark, d), 0.05).select("sample", "PrecursorId", "value")


def _fasta(spark, d, key: F.Column, name: F.Column, plain: F.Column) -> DataFrame:
    """The names of a packed FASTA file of the parts: an entry each, in the order of their keys."""
    path = _folder(spark)
    head = F.when(plain, F.concat(F.lit(">"), key)).otherwise(F.concat(F.lit(">sp|"), key, F.lit("|"), name, F.lit(" description")))
    entries = fx.table(spark, d, "part").select("p_partkey", F.concat(head, F.lit("\nPEPTIDE\nSEQUENCE")).alias("value"))
    entries.orderBy("p_partkey").select("value").write.text(path, compression="gzip")
    return tables.read_fasta(spark, path)


@query("scan_fasta", "SELECT CAST(p_partkey AS VARCHAR) AS accession, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS name FROM part", "")
def scan_fasta(spark, d):
    return _fasta(spark, d, F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_partkey") % 3 == 0)


def _mapping(spark, d):
    part = fx.table(spark, d, "part").where("p_size <= 25")
    return part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("accession"), F.concat(F.lit("G"), F.col("p_size").cast("string")).alias("name"))


MAPPING = " , mapping AS (SELECT p_brand || '/' || p_type AS accession, min('G' || p_size) AS name FROM part WHERE p_size <= 25 GROUP BY 1)"


@query("gene_map_remote", MAPPING + " SELECT accession, name FROM mapping")
def gene_map(spark, d):
    return _mapping(spark, d).groupBy("accession").agg(F.min("name").alias("name"))


@query("annotate", MAPPING + " SELECT row_id, Protein, coalesce(name, Protein) AS Gene FROM features LEFT JOIN mapping ON Protein = accession")
def annotate_(spark, d):
    return annotate.annotate(fx.features(spark, d), _mapping(spark, d)).select("row_id", "Protein", "Gene")


@query("protein_label", ", last AS (SELECT p_brand || '/' || p_type AS accession, arg_max(p_name, p_partkey) AS name FROM part WHERE p_size <= 25 GROUP BY 1) SELECT row_id, Protein, coalesce(name, Protein) AS ProteinLabel FROM features LEFT JOIN last ON Protein = accession")
def protein_label(spark, d):
    """Labels from a FASTA file in which accessions come again: the last entry of one counts."""
    names = _fasta(spark, d, F.when(F.col("p_size") <= 25, F.concat("p_brand", F.lit("/"), "p_type")).otherwise("none"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(False))
    named = names.withColumn("name", F.replace("name", F.lit("_"), F.lit(" ")))
    return annotate.annotate(fx.features(spark, d), named, "Protein", "ProteinLabel").select("row_id", "Protein", "ProteinLabel")


@query("geneset_library", "SELECT 'brands' AS library, p_brand AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part UNION ALL SELECT 'brands', 'size' || p_size, CAST(p_partkey AS VARCHAR) FROM part", "")
def geneset_library(spark, d):
    sets = fx.gene_sets(spark, d)
    path = _folder(spark)
    lines = sets.groupBy("term").agg(F.concat_ws("\t", F.collect_list("gene")).alias("g")).select(F.concat_ws("\t", "term", F.lit(""), "g").alias("value"))
    lines.write.text(path)
    return tables.read_gmt(spark, path, "brands")


# -- filters and accessors

FILTERS = {
    "filter_peptide_q": (dict(peptide_q_value=0.01), "PeptideQValue <= 0.01"),
    "filter_protein_q": (dict(protein_q_value=0.01), "ProteinQValue <= 0.01"),
    "filter_decoys": (dict(remove_decoys=True), "Decoy = 0"),
    "filter_contaminants": (dict(remove_contaminants=True), "Protein NOT LIKE '%contam%' AND Protein NOT LIKE '%cont_crap%'"),
    "filter_proteotypic": (dict(remove_non_proteotypic=True), "Protein NOT LIKE '%;%'"),
}
for _name, (_args, _where) in FILTERS.items():
    query(_name, f" SELECT row_id, Protein FROM features WHERE {_where}")(lambda spark, d, a=_args: (f := fx.features(spark, d)).where(filters.predicates(f.columns, **a)).select("row_id", "Protein"))


@query("filter_zero_rows", " SELECT row_id, Protein FROM features WHERE row_id IN (SELECT row_id FROM cells WHERE value <> 0)")
def filter_zero_rows(spark, d):
    x = m(spark, d)
    return x.features.join(filters.nonzero_rows(x.cells), "row_id", "left_semi").select("row_id", "Protein")


@query("filter_max_zeros", " SELECT row_id FROM grid GROUP BY 1 HAVING count(*) FILTER (coalesce(value, 0) = 0) <= 1")
def filter_max_zeros(spark, d):
    x = m(spark, d)
    return filters.few_zero_rows(x.cells, fx.N, 1)


@query("filter", f" SELECT row_id, Protein FROM features WHERE {' AND '.join(w for _, w in FILTERS.values())} AND row_id IN (SELECT row_id FROM cells WHERE value <> 0)")
def filter_(spark, d):
    return m(spark, d).filter().features.select("row_id", "Protein")


@query("distinct_proteins", " SELECT Protein, min(row_id) AS first FROM features GROUP BY 1")
def distinct_proteins(spark, d):
    from ..matrix import first_seen

    return first_seen(fx.features(spark, d), "Protein")


@query("distinct_peptides", " SELECT PeptideSequence, min(row_id) AS first FROM features GROUP BY 1")
def distinct_peptides(spark, d):
    from ..matrix import first_seen

    return first_seen(fx.features(spark, d), "PeptideSequence")


@query("precursor_id", " SELECT row_id, PeptideSequence || '_' || Charge AS PrecursorId FROM features")
def precursor_id(spark, d):
    return m(spark, d).with_precursor_id().features.select("row_id", "PrecursorId")


@query("protein_labels", " SELECT row_id, Protein FROM features")
def protein_labels(spark, d):
    return fx.features(spark, d).select("row_id", "Protein")


@query("sample_groups", SUPPLIERS + ' SELECT sample, "group" FROM sup', "")
def sample_groups(spark, d):
    return _suppliers(spark, d).samples.select("sample", "group")


@query("get_samples", SUPPLIERS + ' SELECT sample FROM sup WHERE "group" = 2', "")
def get_samples(spark, d):
    return spark.createDataFrame([(s,) for s in _suppliers(spark, d).get_samples(2)], "sample string")


@query("get_pairs", SUPPLIERS + ' SELECT sample, pair FROM sup WHERE "group" = 1', "")
def get_pairs(spark, d):
    x = _suppliers(spark, d)
    own = x.get_samples(1)
    return spark.createDataFrame(list(zip(own, x.get_pairs(own), strict=True)), "sample string, pair string")


@query("get_batches", SUPPLIERS + " SELECT sample, batch FROM sup", "")
def get_batches(spark, d):
    x = _suppliers(spark, d)
    return spark.createDataFrame(list(zip(x.get_samples(), x.get_batches(), strict=True)), "sample string, batch int")


@query("case_species", " SELECT row_id, CASE WHEN Protein LIKE '%Brand#1%' THEN 'one' WHEN Protein LIKE '%Brand#2%' THEN 'two' ELSE 'other' END AS species FROM features")
def case_species(spark, d):
    p = F.col("Protein")
    return fx.features(spark, d).select("row_id", F.when(p.contains("Brand#1"), "one").when(p.contains("Brand#2"), "two").otherwise("other").alias("species"))


# -- scaling and normalisation

OVER = "OVER (PARTITION BY row_id)"
SCALE_SQL = {
    "scale_zscore": ("zscore", f"CASE WHEN stddev_pop(value) {OVER} <> 0 THEN (value - avg(value) {OVER}) / stddev_pop(value) {OVER} END"),
    "scale_minmax": ("minmax", f"CASE WHEN max(value) {OVER} <> min(value) {OVER} THEN (value - min(value) {OVER}) / (max(value) {OVER} - min(value) {OVER}) END"),
    "scale_absmax": ("absmax", f"value / nullif(max(abs(value)) {OVER}, 0)"),
    "standard_scale": ("standard", f"(value - avg(value) {OVER}) / CASE WHEN stddev_pop(value) {OVER} > 0 THEN stddev_pop(value) {OVER} ELSE 1 END"),
}
for _name, (_how, _sql) in SCALE_SQL.items():
    query(_name, f" SELECT row_id, sample, round({_sql}, 6) AS value FROM cells")(lambda spark, d, how=_how: rounded(scaling.scale(m(spark, d).cells, how)))
query("scale", SQL["scale_zscore"].split(CELLS.strip(), 1)[1])(lambda spark, d: rounded(m(spark, d).scale("zscore").cells))


def _norm_sql(stat: str, centre: str) -> str:
    return f", st AS (SELECT sample, {stat}(value) AS m FROM cells GROUP BY 1) SELECT row_id, c.sample, round(value * (SELECT {centre}(m) FROM st) / m, 4) AS value FROM cells c JOIN st USING (sample)"


query("norm_log2", " SELECT row_id, sample, round(CASE WHEN value > 0 THEN log2(value) END, 6) AS value FROM cells")(lambda spark, d: rounded(normalize.normalize(m(spark, d).cells, "log2")))
for _how, _centre in (("tic", "median"), ("median", "avg"), ("mean", "avg")):
    query(f"norm_{_how}", _norm_sql({"tic": "sum", "median": "median", "mean": "avg"}[_how], _centre))(lambda spark, d, how=_how: rounded(normalize.normalize(m(spark, d).cells, how, log_transform=False), 4))
query("normalize", _norm_sql("avg", "avg").replace("round(value * (SELECT avg(m) FROM st) / m, 4)", "round(log2(value * (SELECT avg(m) FROM st) / m), 6)"))(lambda spark, d: rounded(m(spark, d).normalize("mean").cells))

STRIDE, MINIMUM = 5.0, 150
BINS = f""", span AS (SELECT min(RetentionTime) AS lo, greatest(CAST(ceil((max(RetentionTime) - min(RetentionTime)) / {STRIDE}) AS BIGINT), 1) AS nb FROM features),
bins AS (SELECT row_id, least(CAST(floor((RetentionTime - lo) / {STRIDE}) AS BIGINT), nb - 1) AS bin, nb AS n_bins FROM features, span)"""
EXPAND = BINS + f""", spots AS (SELECT b AS bin, nb AS n_bins FROM span, range((SELECT nb FROM span)) t(b)),
radius AS (SELECT a.bin, a.n_bins, coalesce((SELECT min(e) FROM range((SELECT nb FROM span)) t(e) WHERE (SELECT count(*) FROM bins x WHERE abs(x.bin - a.bin) <= e) >= {MINIMUM}), a.n_bins - 1) AS radius FROM spots a)"""
OVERLAP = EXPAND + """, times AS (SELECT w.bin AS "window", b.bin AS bin, count(*) AS times FROM spots w JOIN radius k ON abs(k.bin - w.bin) <= 1 JOIN spots b ON abs(k.bin - b.bin) <= k.radius GROUP BY 1, 2)"""
WINDOW = OVERLAP + """, wstat AS (SELECT t."window" AS w, c.sample, sum(t.times * value) / sum(t.times) AS m FROM cells c JOIN bins b USING (row_id) JOIN times t ON t.bin = b.bin GROUP BY 1, 2),
centre AS (SELECT w, CASE WHEN count(*) = (SELECT count(DISTINCT sample) FROM cells) THEN avg(m) END AS c FROM wstat GROUP BY 1),
fac AS (SELECT w, sample, c / m AS f FROM wstat JOIN centre USING (w) WHERE c IS NOT NULL AND m <> 0),
binfac AS (SELECT t.bin, sample, sum(t.times * f) / sum(t.times) AS f FROM times t JOIN fac ON t."window" = fac.w GROUP BY 1, 2)
SELECT row_id, c.sample, round(value * f, 4) AS value FROM cells c JOIN bins b USING (row_id) LEFT JOIN binfac USING (bin, sample)"""


@query("rt_bins", BINS + " SELECT * FROM bins")
def rt_bins(spark, d):
    return normalize.rt_bins(fx.features(spark, d), STRIDE)


@query("rt_expand", EXPAND + " SELECT bin, radius, n_bins FROM radius")
def rt_expand(spark, d):
    return normalize.rt_expand(rt_bins(spark, d), MINIMUM)


@query("rt_overlap", OVERLAP + ' SELECT "window", bin, times FROM times')
def rt_overlap(spark, d):
    return normalize.rt_overlap(rt_expand(spark, d))


@query("norm_rt_window", WINDOW)
def norm_rt_window(spark, d):
    x = m(spark, d)
    return rounded(normalize.by_rt_window(x.cells, x.features, "mean", MINIMUM, STRIDE), 4)


@query("correct_mean", """, p AS (SELECT row_id, sample, batch, value FROM cells JOIN samples USING (sample)),
b AS (SELECT row_id, batch, avg(value) AS mu, stddev_pop(value) AS sd FROM p GROUP BY 1, 2)
SELECT p.row_id, p.sample, round((value - b.mu) * (r.sd / nullif(b.sd, 0)) + r.mu, 6) AS value FROM p JOIN b USING (row_id, batch) LEFT JOIN b r ON r.row_id = p.row_id AND r.batch = 1""")
def correct_mean(spark, d):
    return rounded(m(spark, d).correct("mean", 1).cells)


# -- quantification

RANKED = ", r AS (SELECT Protein AS key, sample, value, row_number() OVER (PARTITION BY Protein, sample ORDER BY coalesce(value, 0) DESC) AS k FROM cells JOIN features USING (row_id))"
for _how, _agg in (("sum", "coalesce(sum(nullif(value, 0)), 0)"), ("mean", "avg(nullif(value, 0))"), ("median", "median(nullif(value, 0))")):
    query(f"topn_{_how}", RANKED + f" SELECT key, sample, round({_agg}, 6) AS value FROM r WHERE k <= 3 GROUP BY 1, 2")(lambda spark, d, how=_how: rounded(quantify.top_n((x := m(spark, d)).cells, x.features, "protein", 3, how)))
query("topn_level", RANKED.replace("Protein AS key", "Charge AS key").replace("BY Protein", "BY Charge") + " SELECT key, sample, round(sum(value), 6) AS value FROM r WHERE k <= 5 GROUP BY 1, 2")(lambda spark, d: rounded(quantify.top_n((x := m(spark, d)).cells, x.features, "Charge", 5, "sum")))
query("quantify", " SELECT Protein, sample, round(max(value), 6) AS value FROM cells JOIN features USING (row_id) GROUP BY 1, 2")(lambda spark, d: rounded((q := m(spark, d).quantify("top_n", "protein", 1)).cells.join(q.features, "row_id").select("Protein", "sample", "value")))

LOGS = ", l AS (SELECT row_id, sample, log2(value) AS x FROM cells WHERE value > 0), lr AS (SELECT Protein AS key, row_id, sample, x FROM l JOIN features USING (row_id))"
LFQ = ", lo AS (SELECT f.Protein AS key, f.row_id, row_number() OVER (PARTITION BY f.Protein ORDER BY avg(x) DESC NULLS LAST, f.row_id) AS rank FROM features f JOIN l USING (row_id) GROUP BY f.Protein, f.row_id)"
RATIOS = ", ra AS (SELECT a.key, a.sample AS i, b.sample AS j, median(a.x - b.x) AS ratio FROM lr a JOIN lr b ON a.key = b.key AND a.row_id = b.row_id AND a.sample <> b.sample GROUP BY 1, 2, 3)"


def _logs(spark, d):
    x = m(spark, d)
    return normalize.log2(x.cells), x


@query("lfq_order", LOGS + LFQ + " SELECT row_id, key, rank FROM lo")
def lfq_order(spark, d):
    cells, x = _logs(spark, d)
    return quantify.lfq_order(cells, x.features, "Protein")


@query("lfq_topn", LOGS + LFQ + " SELECT key, row_id, sample, round(x, 6) AS value FROM lr JOIN lo USING (key, row_id) WHERE rank <= 3")
def lfq_topn(spark, d):
    cells, x = _logs(spark, d)
    return rounded(quantify.lfq_rows(cells, x.features, "Protein", 3))


@query("lfq_mask", LOGS + " SELECT key, row_id, sample, round(x, 6) AS value FROM lr WHERE key IN (SELECT key FROM lr GROUP BY 1 HAVING count(DISTINCT row_id) >= 10)")
def lfq_mask(spark, d):
    cells, x = _logs(spark, d)
    return rounded(quantify.lfq_rows(cells, x.features, "Protein", 0, 10))


@query("lfq_ratios", LOGS + RATIOS + " SELECT key, i, j, round(ratio, 6) AS ratio FROM ra")
def lfq_ratios(spark, d):
    cells, x = _logs(spark, d)
    return rounded(quantify.lfq_ratios(quantify.lfq_rows(cells, x.features, "Protein")))


#: The groups of a key's samples: going by their order, one that no earlier seed has met is a seed and takes all samples
#: that it shares a feature with; a sample belongs to its last seed.
GROUPS = """, nb AS (SELECT a.key, sa.sample_ord AS s, list(DISTINCT sb.sample_ord) AS near FROM lr a JOIN lr b ON a.key = b.key AND a.row_id = b.row_id JOIN samples sa ON sa.sample = a.sample JOIN samples sb ON sb.sample = b.sample GROUP BY 1, 2),
walk AS (SELECT DISTINCT key, 0 AS i, []::INTEGER[] AS seen FROM nb UNION ALL SELECT w.key, w.i + 1, CASE WHEN n.near IS NOT NULL AND NOT list_contains(w.seen, w.i) THEN list_concat(w.seen, n.near) ELSE w.seen END FROM walk w LEFT JOIN nb n ON n.key = w.key AND n.s = w.i WHERE w.i < 12),
seeds AS (SELECT w.key, w.i AS seed, n.near FROM walk w JOIN nb n ON n.key = w.key AND n.s = w.i WHERE NOT list_contains(w.seen, w.i)),
member AS (SELECT key, m AS sample_ord, max(seed) AS seed FROM (SELECT key, seed, unnest(near) AS m FROM seeds) GROUP BY 1, 2)"""


@query("lfq_graph", LOGS + GROUPS + " SELECT key, sample, CAST(len(near) AS INTEGER) AS n FROM member JOIN seeds USING (key, seed) JOIN samples USING (sample_ord)")
def lfq_graph(spark, d):
    cells, x = _logs(spark, d)
    graph = quantify.lfq_graph(quantify.lfq_rows(cells, x.features, "Protein"), x.samples.select("sample", "sample_ord"))
    return graph.select("key", "sample", F.size("members").alias("n"))


PROFILE = LOGS + RATIOS + GROUPS + """, pull AS (SELECT k.key, o.sample, k.seed, coalesce(sum(ratio) FILTER (list_contains(s.near, p.sample_ord)), 0) / len(s.near) AS r FROM member k JOIN seeds s USING (key, seed) JOIN samples o USING (sample_ord) LEFT JOIN ra ON ra.key = k.key AND ra.i = o.sample LEFT JOIN samples p ON p.sample = ra.j GROUP BY 1, 2, 3, s.near),
mu AS (SELECT s.key, s.seed, len(s.near) AS n, avg(x) AS m, median(x) AS md FROM seeds s JOIN (SELECT key, sample_ord, x FROM lr JOIN samples USING (sample)) v ON v.key = s.key AND list_contains(s.near, v.sample_ord) GROUP BY 1, 2, 3)
SELECT key, sample, round(CASE WHEN n = 1 THEN md ELSE nullif(m + r, 0) END, 6) AS value FROM pull JOIN mu USING (key, seed)"""


@query("maxlfq", PROFILE)
@query("lfq_solve", PROFILE)
def maxlfq(spark, d):
    cells, x = _logs(spark, d)
    return rounded(quantify.maxlfq(cells, x.features, x.samples))


for _name in ("lfq_graph", "maxlfq", "lfq_solve"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)


@query("lfq_single", " SELECT Protein || '@' || sample AS key, sample, round(median(log2(value)), 6) AS value FROM cells JOIN features USING (row_id) GROUP BY 1, 2")
def lfq_single(spark, d):
    """Each protein of each sample is a key of its own, which has that sample only."""
    cells, x = _logs(spark, d)
    one = cells.join(x.features.select("row_id", "Protein"), "row_id").withColumn("Protein", F.concat_ws("@", "Protein", "sample"))
    place = F.substring("sample", 2, 2).cast("long")
    one = one.select((F.col("row_id") * 100 + place).alias("row_id"), "sample", "value", "Protein")
    return rounded(quantify.maxlfq(one.select("row_id", "sample", "value"), one.select("row_id", "Protein"), x.samples))


@query("lfq_annotate", " SELECT Charge, min(row_id) AS row_id, arg_min(Protein, row_id) AS Protein FROM features GROUP BY 1")
def lfq_annotate(spark, d):
    x = m(spark, d)
    profiles = quantify.top_n(x.cells, x.features, "Charge")
    return quantify.lfq_annotate(profiles, x.features, "Charge").select("Charge", "row_id", "Protein")


# -- imputation and decoys

U = "CAST(('0x' || substr(md5(row_id || '|' || sample || '|0|'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


def _imputed(how: str, **kw) -> Query:
    return lambda spark, d: rounded(m(spark, d).impute(how, **kw).cells)


query("impute_constant", " SELECT row_id, sample, round(coalesce(value, 7), 6) AS value FROM grid")(_imputed("constant", constant_value=7.0))
query("impute_uniform_range", f" SELECT row_id, sample, round(coalesce(nullif(value, 0), 2 + 3 * ({U})), 6) AS value FROM grid")(_imputed("uniform_range", minvalue=2.0, maxvalue=5.0))
query("impute_uniform_percentile", f", e AS (SELECT min(nullif(value, 0)) AS lo, max(value) AS hi FROM cells) SELECT row_id, sample, round(coalesce(nullif(value, 0), lo + hi * 0.1::DOUBLE * ({U})), 6) AS value FROM grid, e")(_imputed("uniform_percentile"))
query("impute", " SELECT row_id, sample, round(coalesce(value, 0), 6) AS value FROM grid")(_imputed("constant"))


@query("impute_knn", """, lg AS (SELECT row_id, sample, log2(value) AS v FROM grid), need AS (SELECT row_id FROM lg GROUP BY 1 HAVING count(v) < 12),
dist AS (SELECT a.row_id AS i, b.row_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v)) * 12 / count(*)) AS d FROM lg a JOIN lg b ON a.sample = b.sample AND a.row_id <> b.row_id WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND a.row_id IN (SELECT row_id FROM need) GROUP BY 1, 2),
best AS (SELECT m.row_id, m.sample, d, g.v AS x, row_number() OVER (PARTITION BY m.row_id, m.sample ORDER BY d, j) AS k FROM lg m JOIN dist ON i = m.row_id JOIN lg g ON g.row_id = j AND g.sample = m.sample WHERE m.v IS NULL AND g.v IS NOT NULL),
guess AS (SELECT row_id, sample, sum(x / d) / sum(1 / d) AS v FROM best WHERE k <= 5 GROUP BY 1, 2)
SELECT l.row_id, l.sample, round(coalesce(l.v, g.v), 5) AS value FROM lg l LEFT JOIN guess g USING (row_id, sample)""")
def impute_knn(spark, d):
    cells, x = _logs(spark, d)
    return rounded(impute.impute(cells, x.features, x.samples, "knn"), 5)


@query("decoy_shuffle", f", a AS (SELECT row_id, sample, value, row_number() OVER (PARTITION BY row_id ORDER BY sample) AS t, row_number() OVER (PARTITION BY row_id ORDER BY md5(row_id || '|' || sample || '|0'), sample) AS f FROM cells) SELECT x.row_id, x.sample, round(y.value, 6) AS value FROM a x JOIN a y ON x.row_id = y.row_id AND x.t = y.f")
def decoy_shuffle(spark, d):
    return rounded(decoys.decoy_shuffle(m(spark, d).cells))


UU = [U.replace("'|0|'", f"'|0|{s}'") for s in "ab"]


@query("decoy_mean", f" SELECT row_id, sample, round(avg(value) {OVER} + stddev_pop(value) {OVER} * sqrt(-2 * ln(1 - ({UU[0]}))) * cos(2 * pi() * ({UU[1]})), 4) AS value FROM cells")
def decoy_mean(spark, d):
    return rounded(decoys.decoy_mean(m(spark, d).cells), 4)


@query("append", """, hi AS (SELECT max(row_id) + 1 AS h FROM features), b AS (SELECT row_id, Protein FROM features UNION ALL SELECT row_id + h, 'decoy_' || Protein FROM features, hi)
SELECT row_id, Protein, CASE WHEN contains(Protein, 'decoy') THEN 1 ELSE 0 END AS Decoy FROM b""")
def append(spark, d):
    return m(spark, d).append().features.select("row_id", "Protein", "Decoy")


SCORES = ", sc AS (SELECT row_id, max(value) AS score, max(Decoy) AS Decoy FROM cells JOIN features USING (row_id) GROUP BY 1)"


def _scores(spark, d):
    x = m(spark, d)
    return x.cells.groupBy("row_id").agg(F.max("value").alias("score")).join(x.features.select("row_id", "Decoy"), "row_id")


@query("qvalue_counter", SCORES + ", q AS (SELECT row_id, score, Decoy, sum(CASE WHEN Decoy = 1 THEN 0.4::DOUBLE ELSE 0 END) OVER w AS ds, sum(1 - Decoy) OVER w AS ts FROM sc WINDOW w AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)) SELECT row_id, Decoy, round(score, 6) AS score, round(ds / (ds + ts), 6) AS q_value FROM q")
def qvalue_counter(spark, d):
    return rounded(decoys.qvalue_counter(_scores(spark, d), pit=0.4))


@query("qvalue_distribution", SCORES + """, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS w FROM sc), h AS (SELECT least(CAST(floor((score - lo) / w) AS BIGINT), 49) AS bin, sum(Decoy) AS nd, sum(1 - Decoy) AS nt FROM sc, e GROUP BY 1),
g AS (SELECT b AS bin, lo + (b + 0.5::DOUBLE) * w AS score, w, coalesce(nt, 0) / ((SELECT sum(nt) FROM h) * w) AS target, coalesce(nd, 0) / ((SELECT sum(nd) FROM h) * w) AS decoy FROM range(50) t(b) CROSS JOIN e LEFT JOIN h ON h.bin = t.b),
s AS (SELECT *, coalesce((target + lead(target) OVER o) / 2 * w, 0) AS st, coalesce((decoy + lead(decoy) OVER o) / 2 * w, 0) AS sd FROM g WINDOW o AS (ORDER BY bin)),
a AS (SELECT *, sum(st) OVER o AS ta, sum(sd) OVER o AS ad FROM s WINDOW o AS (ORDER BY bin DESC))
SELECT round(score, 4) AS score, round(target * 1e6, 6) AS target, round(decoy * 1e6, 6) AS decoy, CASE WHEN ad + ta <> 0 THEN round(ad / (ad + ta), 6) END AS q_value FROM a""")
def qvalue_distribution(spark, d):
    out = decoys.qvalue_distribution(_scores(spark, d))
    return out.select(F.round("score", 4).alias("score"), F.round(F.col("target") * 1e6, 6).alias("target"), F.round(F.col("decoy") * 1e6, 6).alias("decoy"), F.round("q_value", 6).alias("q_value"))


@query("qvalue_scores", SCORES.replace("max(value) AS score", "log2(max(value)) AS score") + """, e AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n, 2 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / count(*) ^ (1.0::DOUBLE / 3) AS fd FROM sc),
b AS (SELECT lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END) AS BIGINT) AS bins FROM e),
w AS (SELECT lo, hi, bins, (hi - lo) / bins AS w FROM b),
h AS (SELECT least(CAST(floor((score - (lo + 0.5::DOUBLE * w)) / w) AS BIGINT), bins - 2) AS k, sum(Decoy)::DOUBLE AS d, sum(1 - Decoy)::DOUBLE AS t FROM sc, w WHERE score BETWEEN lo + 0.5::DOUBLE * w AND lo + (bins - 0.5::DOUBLE) * w GROUP BY 1),
f AS (SELECT k.k, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM (SELECT unnest(range(bins - 1)) AS k FROM w) k LEFT JOIN h ON h.k = k.k),
g AS (SELECT row_id, i, n, least(greatest((score + i * 0.1::DOUBLE - (lo + w)) / w, 0), bins - 2) AS u, bins FROM (SELECT row_id, score, lo, w, bins, CAST(ceil((hi - score) / 0.1::DOUBLE) AS BIGINT) AS n, unnest(range(CAST(ceil((hi - score) / 0.1::DOUBLE) AS BIGINT))) AS i FROM sc, w)),
y AS (SELECT row_id, i, n, x.t + (u - floor(u)) * (z.t - x.t) AS t, x.d + (u - floor(u)) * (z.d - x.d) AS d FROM g JOIN f x ON x.k = CAST(floor(u) AS BIGINT) JOIN f z ON z.k = least(CAST(floor(u) AS BIGINT) + 1, bins - 2)),
ar AS (SELECT row_id, 0.1::DOUBLE * sum(t * CASE WHEN i IN (0, n - 1) THEN 0.5::DOUBLE ELSE 1 END) AS t, 0.1::DOUBLE * sum(d * CASE WHEN i IN (0, n - 1) THEN 0.5::DOUBLE ELSE 1 END) * 0.4::DOUBLE AS d FROM y WHERE n > 1 GROUP BY 1)
SELECT row_id, round(score, 6) AS score, round(CASE WHEN coalesce(t, 0) + coalesce(d, 0) = 0 THEN 0 ELSE d / (d + t) END, 6) AS q_value FROM sc LEFT JOIN ar USING (row_id)""")
def qvalue_scores(spark, d):
    return rounded(decoys.qvalue_of_scores(_scores(spark, d).withColumn("score", F.log2("score")), pit=0.4).select("row_id", "score", "q_value"))


# -- comparison

STATS = NORM + """, z AS (SELECT n.row_id, grp, sample, nullif(value, 0) AS v FROM norm n JOIN samples USING (sample)),
st AS (SELECT row_id, count(v) FILTER (grp = 1) AS n_a, count(v) FILTER (grp = 2) AS n_b, avg(v) FILTER (grp = 1) AS ma, avg(v) FILTER (grp = 2) AS mb, stddev_pop(v) FILTER (grp = 1) AS sa, stddev_pop(v) FILTER (grp = 2) AS sb FROM z GROUP BY 1),
gs AS (SELECT row_id, n_a, n_b, CASE WHEN n_a >= {k} AND (n_b >= {k} OR n_a = 6) THEN ma END AS mean_a, CASE WHEN n_b >= {k} AND (n_a >= {k} OR n_b = 6) THEN mb END AS mean_b, CASE WHEN n_a >= {k} AND (n_b >= {k} OR n_a = 6) THEN sa END AS sd_a,
  CASE WHEN n_b >= {k} AND (n_a >= {k} OR n_b = 6) THEN sb END AS sd_b, CASE WHEN n_a >= {k} AND n_b >= {k} THEN ma - mb END AS log2_fc FROM st)"""
STATS2, STATS5 = STATS.replace("{k}", "2"), STATS.replace("{k}", "5")


def p_sql(t: str, nu: str) -> str:
    """1 - A(t | nu) by finite sums with the coefficients' logarithms."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    even = f"1 - sin({th}) * list_sum(list_transform(range(CAST({nu} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - lgamma(0.5)) * pow(cos({th}), 2 * j)))"
    odd = f"1 - 2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(CAST(({nu} - 1) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos({th}), 2 * j + 1))), 0))"
    return f"CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END"


T = "log2_fc / sqrt(nullif((n_a * sd_a * sd_a + n_b * sd_b * sd_b) / (n_a + n_b - 2), 0) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))"
TESTS = STATS2 + f", tt AS (SELECT *, {T} AS t, n_a + n_b - 2 AS nu FROM gs), tests AS (SELECT row_id, log2_fc, {p_sql('t', 'nu')} AS p FROM tt WHERE log2_fc IS NOT NULL)"


def _tests(spark, d):
    cells, x = norm(spark, d)
    return compare.ttest(compare.group_stats(cells, x.samples, (1, 2))).where("log2_fc IS NOT NULL").select("row_id", "log2_fc", "p")


STAT_COLS = "row_id, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(sd_a, 6) AS sd_a, round(sd_b, 6) AS sd_b, round(log2_fc, 6) AS log2_fc"
query("de_group_stats", STATS2 + f" SELECT {STAT_COLS} FROM gs")(lambda spark, d: rounded(compare.group_stats((z := norm(spark, d))[0], z[1].samples, (1, 2), 2)))
query("de_min_reps", STATS5 + f" SELECT {STAT_COLS} FROM gs")(lambda spark, d: rounded(compare.group_stats((z := norm(spark, d))[0], z[1].samples, (1, 2), 5)))
for _name in ("de_ttest", "de_anova", "de_linregress"):
    query(_name, TESTS + " SELECT row_id, round(log2_fc, 6) AS log2_fc, round(p, 6) AS p FROM tests")(lambda spark, d: rounded(_tests(spark, d)))


@query("de_ttest_paired", NORM + f""", df AS (SELECT a.row_id, a.value - b.value AS x FROM norm a JOIN samples s ON s.sample = a.sample AND grp = 1 JOIN norm b ON b.row_id = a.row_id AND b.sample = s.pair),
pt AS (SELECT row_id, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM df GROUP BY 1), t2 AS (SELECT *, m / (nullif(sd, 0) / sqrt(n)) AS t, n - 1 AS nu FROM pt)
SELECT row_id, n AS n_pairs, round(m, 6) AS mean_difference, CASE WHEN n >= 2 THEN round({p_sql('t', 'nu')}, 6) END AS p FROM t2""")
def de_ttest_paired(spark, d):
    cells, x = norm(spark, d)
    return rounded(compare.paired(cells, x.samples, (1, 2)).where("n_pairs > 0"))


@query("de_linregress_cov")
def de_linregress_cov(spark, d):
    cells, x = norm(spark, d)
    return rounded(compare.with_covariates(cells, x.samples, (1, 2), ["age", "gender"]))


#: p-values near zero are differences of nearly equal numbers in SQL: both sides take them as LEAST
LEAST = 1e-9


@query("de_score", TESTS + f", cl AS (SELECT row_id, log2_fc, greatest(p, {LEAST}) AS p FROM tests), mx AS (SELECT max(-ln(p)) AS a, max(abs(log2_fc)) AS b FROM cl) SELECT row_id, round(sqrt((-ln(p) / a) ** 2 + (log2_fc / b) ** 2), 5) AS de_score FROM cl, mx")
def de_score(spark, d):
    tests = _tests(spark, d).withColumn("p", F.when(F.col("p").isNotNull(), F.greatest("p", F.lit(LEAST))))
    return rounded(compare.score(tests).select("row_id", "de_score"), 5)


BH = TESTS + ", rk AS (SELECT *, row_number() OVER (ORDER BY p, row_id) AS k, count(*) OVER () AS m FROM tests WHERE p IS NOT NULL), bh AS (SELECT *, least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE) AS q FROM rk)"
TSBH = BH + ", r1 AS (SELECT count(*) FILTER (q <= 0.05) AS r, count(*) AS n FROM bh), ts AS (SELECT row_id, p, least(q * CASE WHEN r IN (0, n) THEN 1.0::DOUBLE ELSE (n - r) / n::DOUBLE END, 1.0::DOUBLE) AS c FROM bh, r1)"


def _corrected(spark, d, how="fdr_tsbh"):
    return compare.correct_p(_tests(spark, d).where("p IS NOT NULL"), how)


query("de_multitest", TSBH + " SELECT row_id, round(c, 6) AS corrected FROM ts")(lambda spark, d: rounded(_corrected(spark, d).select("row_id", "corrected")))
query("de_multitest_bh", BH + " SELECT row_id, round(q, 6) AS corrected FROM bh")(lambda spark, d: rounded(_corrected(spark, d, "fdr_bh").select("row_id", "corrected")))
query("de_multitest_holm", BH + " SELECT row_id, round(least(max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS corrected FROM rk")(lambda spark, d: rounded(_corrected(spark, d, "holm").select("row_id", "corrected")))
query("de_multitest_bonferroni", BH + " SELECT row_id, round(least(p * m, 1.0::DOUBLE), 6) AS corrected FROM rk")(lambda spark, d: rounded(_corrected(spark, d, "bonferroni").select("row_id", "corrected")))
query("de_neglog10", TSBH + f" SELECT row_id, round(-log10(greatest(c, {LEAST})), 5) AS neglog10 FROM ts")(lambda spark, d: rounded(_corrected(spark, d).select("row_id", (-F.log10(F.greatest("corrected", F.lit(LEAST)))).alias("neglog10")), 5))
_GROUPS = ["Group1Mean", "Group1Stdev", "Group1RepCounts", "Group2Mean", "Group2Stdev", "Group2RepCounts"]


@query("compare", TSBH + f""", mx AS (SELECT max(-ln(p)) AS a, max(abs(log2_fc)) AS b FROM tests WHERE p > 0)
SELECT row_id, round(sqrt((-ln(tests.p) / a) ** 2 + (tests.log2_fc / b) ** 2), 4) AS "DEScore1-2", round(tests.log2_fc, 6) AS "Log2FoldChange1-2", round(tests.p, 6) AS "PValue1-2", round(c, 6) AS "CorrectedPValue1-2", round(-log10(greatest(c, {LEAST})), 4) AS "-Log10CorrectedPValue1-2",
  round(mean_a, 6) AS Group1Mean, round(sd_a, 6) AS Group1Stdev, n_a AS Group1RepCounts, round(mean_b, 6) AS Group2Mean, round(sd_b, 6) AS Group2Stdev, n_b AS Group2RepCounts FROM tests JOIN ts USING (row_id) JOIN gs USING (row_id), mx""")
def compare_(spark, d):
    cells, x = norm(spark, d)
    out = type(x)(cells, x.features, x.samples).compare((1, 2)).features.where("`PValue1-2` IS NOT NULL")
    log = F.least(F.col("`-Log10CorrectedPValue1-2`"), F.lit(-math.log10(LEAST)))
    few = out.select("row_id", F.round("`DEScore1-2`", 4).alias("DEScore1-2"), F.round(log, 4).alias("-Log10CorrectedPValue1-2"), "Log2FoldChange1-2", "PValue1-2", "CorrectedPValue1-2", *_GROUPS)
    return rounded(few)


@query("de_multi_comparison", STATS2 + ' SELECT row_id, round(log2_fc, 6) AS "Log2FoldChange1-2", round(-log2_fc, 6) AS "Log2FoldChange2-1", n_a AS Group1RepCounts, n_b AS Group2RepCounts FROM gs WHERE log2_fc IS NOT NULL')
def de_multi_comparison(spark, d):
    cells, x = norm(spark, d)
    out = compare.compare(cells, x.features, x.samples, [(1, 2), (2, 1)])
    return rounded(out.where("`Log2FoldChange1-2` IS NOT NULL").select("row_id", "Log2FoldChange1-2", "Log2FoldChange2-1", "Group1RepCounts", "Group2RepCounts"))


@query("de_level", NORM + ", pl AS (SELECT Protein, sample, max(coalesce(value, 0)) AS v FROM norm JOIN features USING (row_id) GROUP BY 1, 2) SELECT Protein, round(avg(nullif(v, 0)) FILTER (grp = 1) - avg(nullif(v, 0)) FILTER (grp = 2), 6) AS log2_fc FROM pl JOIN samples USING (sample) GROUP BY 1 HAVING count(nullif(v, 0)) FILTER (grp = 1) >= 2 AND count(nullif(v, 0)) FILTER (grp = 2) >= 2")
def de_level(spark, d):
    cells, x = norm(spark, d)
    q = type(x)(cells, x.features, x.samples).quantify("top_n", "protein", 1).compare((1, 2), level="protein").features
    return rounded(q.where("`Log2FoldChange1-2` IS NOT NULL").select("Protein", F.col("Log2FoldChange1-2").alias("log2_fc")))


@query("pr_curve", TSBH + """, y AS (SELECT c, CASE WHEN Protein LIKE '%Brand#1/%' OR Protein LIKE '%Brand#2/%' OR Protein LIKE '%Brand#3/%' THEN 1 ELSE 0 END AS y FROM ts JOIN features USING (row_id)), tot AS (SELECT sum(y) AS p, sum(1 - y) AS n FROM y)

, h AS (SELECT CAST(ceil(c * 10000) AS BIGINT) AS k, sum(y) AS tp, sum(1 - y) AS fp FROM y GROUP BY 1), run AS (SELECT t.k, sum(coalesce(tp, 0)) OVER w AS tp, sum(coalesce(fp, 0)) OVER w AS fp FROM range(0, 10001) t(k) LEFT JOIN h USING (k) WINDOW w AS (ORDER BY t.k ROWS UNBOUNDED PRECEDING))
SELECT round(k / 10000.0::DOUBLE, 6) AS cutoff, round(tp / p::DOUBLE, 6) AS recall, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) END AS "precision", round(fp / n::DOUBLE, 6) AS fpr FROM run, tot WHERE k BETWEEN 1 AND 9999""")
def pr_curve(spark, d):
    p = F.col("Protein")
    tests = _corrected(spark, d).join(fx.features(spark, d), "row_id")
    return rounded(compare.pr_curve(tests, p.contains("Brand#1/") | p.contains("Brand#2/") | p.contains("Brand#3/")))


@query("flagship", TSBH + " SELECT Protein, row_id, round(p, 6) AS p, round(c, 6) AS corrected FROM ts JOIN features USING (row_id)")
def flagship(spark, d):
    return rounded(_corrected(spark, d).join(fx.features(spark, d).select("row_id", "Protein"), "row_id").select("Protein", "row_id", "p", "corrected"))


# -- clusters

EMB = """
ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS k FROM embeddings),
rk AS (SELECT k, vec_id, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS r FROM ex),
rho AS (SELECT a.k AS a, b.k AS b, 1 - abs(corr(a.r, b.r)) AS distance FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY 1, 2)"""


def _all(spark, d):
    """All vectors, whatever their labels."""
    return fx.embedding_matrix(spark, d, tuple(range(10)))


@query("cluster_spearman", " SELECT a, b, round(distance, 6) AS distance FROM rho", EMB)
def cluster_spearman(spark, d):
    return rounded(cluster.spearman(_all(spark, d).cells))


@query("cluster_mindist", ", two AS (SELECT a AS row_id, distance FROM rho UNION ALL SELECT b, distance FROM rho) SELECT row_id, round(min(distance), 6) AS distance FROM two GROUP BY 1", EMB)
def cluster_mindist(spark, d):
    return rounded(cluster.nearest(_all(spark, d).cells))


@query("cluster_cutoff")
def cluster_cutoff(spark, d):
    cells = _all(spark, d).cells
    return rounded(cluster.cutoff(cluster.nearest(cells), cluster.nearest(decoys.decoy_shuffle(cells)), 0.9))


@query("cluster_ward")
def cluster_ward(spark, d):
    x = _all(spark, d)
    return cluster.ward(x.cells, x.features, 0.9)


@query("cluster")
def cluster_(spark, d):
    return _all(spark, d).cluster(q_value=0.4).features


@query("cluster_representative", TESTS + " SELECT Charge, arg_min(row_id, p) AS row_id FROM tests JOIN features USING (row_id) GROUP BY 1")
def cluster_representative(spark, d):
    rows = _tests(spark, d).join(fx.features(spark, d).select("row_id", "Charge"), "row_id")
    return annotate.representative(rows, "Charge", "p").select("Charge", "row_id")


# -- enrichment

SETS = ", sets AS (SELECT p_brand AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part UNION SELECT 'size' || p_size, CAST(p_partkey AS VARCHAR) FROM part), sel AS (SELECT CAST(row_id AS VARCHAR) AS gene FROM tests WHERE p < 0.05)"


def _selected(spark, d):
    return annotate.select_genes(_tests(spark, d).withColumn("Gene", F.col("row_id").cast("string")), "Gene", "p", 0.05)


query("enrich_select", TESTS + SETS + " SELECT gene FROM sel")(_selected)
query("enrich_subset", TESTS + SETS + " SELECT term, gene FROM sets WHERE term IN (SELECT term FROM sets JOIN sel USING (gene))")(lambda spark, d: annotate.subset_library(fx.gene_sets(spark, d).select("term", "gene"), _selected(spark, d)))
OVERREP = TESTS + SETS + """, tot AS (SELECT count(DISTINCT gene) AS nn FROM sets), ns AS (SELECT count(*) AS n FROM sel JOIN (SELECT DISTINCT gene FROM sets) USING (gene)),
o AS (SELECT term, count(sel.gene) AS x, count(*) AS k FROM sets LEFT JOIN sel USING (gene) GROUP BY 1 HAVING count(sel.gene) > 0),
hp AS (SELECT term, x AS overlap, k AS size, n AS n_selected, nn AS n_background, least(list_sum(list_transform(range(x, least(k, n) + 1), lambda j: exp(lgamma(k + 1.0) - lgamma(j + 1.0) - lgamma(k - j + 1.0) + lgamma(nn - k + 1.0) - lgamma(n - j + 1.0) - lgamma(nn - k - n + j + 1.0) - lgamma(nn + 1.0) + lgamma(n + 1.0) + lgamma(nn - n + 1.0)))), 1.0::DOUBLE) AS p FROM o, tot, ns)
, hk AS (SELECT *, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS m FROM hp)
SELECT term, overlap, size, n_selected, n_background, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS corrected FROM hk"""
query("enrich_overrep", OVERREP)(lambda spark, d: rounded(annotate.overrepresented(fx.gene_sets(spark, d), _selected(spark, d))))
for _name, _how in (("enrich", "overreptest"), ("enrich_enrichr", "enrichr_overreptest")):
    query(_name, OVERREP)(lambda spark, d, how=_how: rounded(annotate.enrich(_tests(spark, d).withColumn("Gene", F.col("row_id").cast("string")), fx.gene_sets(spark, d), how, pvalue_column="p", pvalue_cutoff=0.05)))


@query("enrichment_map", """
st AS (SELECT DISTINCT p_brand AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part UNION SELECT 'size' || p_size, CAST(p_partkey AS VARCHAR) FROM part), sz AS (SELECT term, count(*) AS n FROM st GROUP BY 1),
pr AS (SELECT x.term AS a, y.term AS b, count(*) AS common FROM st x JOIN st y ON x.gene = y.gene AND x.term < y.term GROUP BY 1, 2)
SELECT a, b, common, round(common / (s.n + t.n - common)::DOUBLE, 6) AS jaccard, round(common / least(s.n, t.n)::DOUBLE, 6) AS overlap FROM pr JOIN sz s ON s.term = a JOIN sz t ON t.term = b""", " ")
def enrichment_map(spark, d):
    return rounded(annotate.enrichment_map(fx.gene_sets(spark, d)))


@query("enrichment_map_near", """
st AS (SELECT DISTINCT p_brand AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part UNION SELECT 'size' || p_size, CAST(p_partkey AS VARCHAR) FROM part), sz AS (SELECT term, count(*) AS n FROM st GROUP BY 1),
pr AS (SELECT x.term AS a, y.term AS b, count(*) AS common FROM st x JOIN st y ON x.gene = y.gene AND x.term < y.term GROUP BY 1, 2)
SELECT a, b, common, round(common / (s.n + t.n - common)::DOUBLE, 6) AS jaccard, round(common / least(s.n, t.n)::DOUBLE, 6) AS overlap FROM pr JOIN sz s ON s.term = a JOIN sz t ON t.term = b WHERE common / (s.n + t.n - common)::DOUBLE >= 0.03""", " ")
def enrichment_map_near(spark, d):
    return rounded(annotate.enrichment_map(fx.gene_sets(spark, d), at_least=0.03))


# -- learning


def _rows(spark, d):
    x = fx.embedding_matrix(spark, d)
    return learn.to_ml(scaling.standard(x.cells), x.samples)


@query("label_encode", "SELECT o_orderkey AS sample, o_orderstatus AS \"group\", CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label FROM orders", "")
def label_encode(spark, d):
    return learn.label_encode(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("group")))


@query("classifier_wrap", "SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings WHERE label < 2) / (2.0::DOUBLE * count(*)), 6) AS weight FROM (SELECT CAST(label AS DOUBLE) AS label FROM embeddings WHERE label < 2) GROUP BY 1", "")
def classifier_wrap(spark, d):
    return rounded(learn.balanced(_rows(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("weight")))


def _u(*keys: str, seed: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5({' || '.join(f"{k} || '|'" for k in keys)} || {seed} || '|{salt}'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


SAMP = "'v' || lpad(CAST(vec_id AS VARCHAR), 9, '0')"


@query("undersample", f"WITH e AS (SELECT {SAMP} AS sample, CAST(label AS DOUBLE) AS label FROM embeddings WHERE label < 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_u('sample', seed="'0'", salt='under')}, sample) AS k FROM e) SELECT sample, label FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM e GROUP BY label))", "")
def undersample(spark, d):
    return learn.undersample(_rows(spark, d)).select("sample", "label")


@query("bootstrap_resample", f"""WITH e AS (SELECT {SAMP} AS sample, CAST(label AS DOUBLE) AS label FROM embeddings WHERE label < 2), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM e),
s AS (SELECT i AS iteration, label, place AS slot, CAST(floor({_u('i', "(CASE WHEN label = 0 THEN '0.0' ELSE '1.0' END)", 'place', seed="'0'", salt='boot')} * n) AS BIGINT) AS at FROM p, range(5) t(i))
SELECT CAST(iteration AS INTEGER) AS iteration, s.label, CAST(slot AS INTEGER) AS slot, sample FROM s JOIN p ON p.label = s.label AND p.place = s.at""", "")
def bootstrap_resample(spark, d):
    return learn.bootstrap_resample(_rows(spark, d), 5)


WEIGHTS = [((k * 37) % 11 - 5) / 10 for k in range(64)]


@query("linear_importance", """
ex AS (SELECT vec_id, """ + SAMP + """ AS sample, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS k FROM embeddings WHERE label < 2),
sc AS (SELECT sample, k, (x - avg(x) OVER (PARTITION BY k)) / stddev_pop(x) OVER (PARTITION BY k) AS x FROM ex),
sh AS (SELECT i, sample, k, x, row_number() OVER (PARTITION BY i, k ORDER BY sample) AS t, row_number() OVER (PARTITION BY i, k ORDER BY """ + _u("k", "sample", seed="i", salt="shuffle") + """, x) AS f FROM sc, range(3) g(i)),
mv AS (SELECT a.k, a.sample, avg(a.x - b.x) AS d FROM sh a JOIN sh b ON a.i = b.i AND a.k = b.k AND a.t = b.f GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS k, round(avg(abs(d * ((k * 37) % 11 - 5) / 10.0::DOUBLE)), 6) AS importance FROM mv GROUP BY 1""")
def linear_importance(spark, d):
    return rounded(learn.linear_importance(_rows(spark, d), WEIGHTS))


SQL["linear_importance"] = SQL["linear_importance"].replace(CELLS.strip(), "", 1)


LOCAL = SQL["linear_importance"].rsplit("\nSELECT", 1)[0]
WEIGHTED = "((k * 37) % 11 - 5) / 10.0::DOUBLE"
SQL["feature_importance"] = SQL["linear_importance"]
SQL["interpret"] = LOCAL + f"\nSELECT CAST(k AS INTEGER) AS k, sample, round(d * {WEIGHTED}, 6) + 0.0::DOUBLE AS value FROM mv"
SQL["local_importance_top"] = LOCAL + f"\n, loc AS (SELECT CAST(k AS INTEGER) AS k, sample, d * {WEIGHTED} AS value FROM mv), am AS (SELECT k, avg(abs(value)) AS mean_abs FROM loc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT k, sample, round(value, 6) AS value, round(mean_abs, 6) AS mean_abs FROM loc JOIN am USING (k)"
#: A linear model that was given, not fitted, so that SQL can say what its importances are.
MODEL = learn.Linear(WEIGHTS)

query("feature_importance", None)(lambda spark, d: rounded(learn.feature_importance(_rows(spark, d), MODEL)))
query("interpret", None)(lambda spark, d: rounded(learn.local_importance(_rows(spark, d), MODEL)).withColumn("value", F.col("value") + 0.0))  # no zero with a sign
query("local_importance_top", None)(lambda spark, d: rounded(learn.local_importance_top(learn.local_importance(_rows(spark, d), MODEL))))
query("plot_importance_data")(lambda spark, d: rounded(learn.plot_importance_data(learn.local_importance(_rows(spark, d), MODEL))))
query("plot")(lambda spark, d: rounded(fx.embedding_matrix(spark, d).plot("importance_summary", model=MODEL, downsample_background=False)))
query("bootstrap_importance")(lambda spark, d: rounded(learn.summarise(learn.bootstrap_importance(_rows(spark, d), 20))))
query("select_features")(lambda spark, d: learn.select_features(learn.bootstrap_importance(_rows(spark, d), 20), "count", 10, 0.5))
query("select_features_knee")(lambda spark, d: rounded(learn.select_features(learn.bootstrap_importance(_rows(spark, d), 20), "mean", cutoff="knee")))
query("explain")(lambda spark, d: rounded((x := fx.embedding_matrix(spark, d)).explain(None, [(1, 2)], 20).features))
query("bootstrap_rfe")(lambda spark, d: learn.bootstrap_rfe(_rows(spark, d), 5, 4, 8))
query("rfe_scores")(lambda spark, d: rounded(learn.rfe_scores(learn.bootstrap_rfe(_rows(spark, d), 5, 4, 8))))
query("rfe_ranks")(lambda spark, d: rounded(learn.rfe_ranks(learn.bootstrap_rfe(_rows(spark, d), 5, 4, 8))))


@query("rfe_evaluate")
def rfe_evaluate(spark, d):
    rows = cut(_rows(spark, d))
    ranks = learn.rfe_ranks(learn.bootstrap_rfe(rows, 5, 4, 8))
    return spark.createDataFrame(learn.rfe_evaluate(rows, ranks, [10.0, 40.0], LogisticRegression(maxIter=10)), "cutoff double, n_features int, accuracy double")


@query("plot_rfe_pca_data")
def plot_rfe_pca_data(spark, d):
    rows = cut(_rows(spark, d))
    return rounded(learn.plot_rfe_pca_data(rows, learn.rfe_ranks(learn.bootstrap_rfe(rows, 5, 4, 8)), [20.0, 60.0]), 4)


@query("train")
def train(spark, d):
    result = fx.embedding_matrix(spark, d).train(LogisticRegression(maxIter=20, weightCol="weight"))
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(result.scores)], "fold int, accuracy double")


@query("predict")
def predict(spark, d):
    x = fx.embedding_matrix(spark, d)
    return x.predict(x.train(LogisticRegression(maxIter=20, weightCol="weight"), validate=False).model).samples


GRID = {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}


def _make(**params) -> LogisticRegression:
    return LogisticRegression(maxIter=10, **params)


def _searched(spark, result: learn.SearchResult) -> DataFrame:
    return spark.createDataFrame([(g, float(s), str(sorted(p.items()))) for g, h in enumerate(result.history) for s, p in h], "generation int, score double, params string")


query("search_random")(lambda spark, d: _searched(spark, learn.search_random(cut(_rows(spark, d)), _make, GRID, 3)))
query("search_genetic")(lambda spark, d: _searched(spark, learn.search_genetic(cut(_rows(spark, d)), _make, GRID, 2, 3, 1)))
query("optimize")(lambda spark, d: _searched(spark, fx.embedding_matrix(spark, d).optimize(_make, "random", GRID, n_iter=2)))


@query("evaluate")
def evaluate(spark, d):
    cells, x = norm(spark, d)
    both = type(x)(cells, x.features.drop("Decoy"), x.samples).append("shuffle").compare((1, 2))
    return rounded(both.evaluate(LogisticRegression(maxIter=20), (1, 2), "deg").features.select("row_id", "Decoy", "DegFeatureScore1-2", "DegFeatureQValue1-2"))
