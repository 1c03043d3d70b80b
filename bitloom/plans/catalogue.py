"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import isim as I
from ..estimator import BitClusters
from ..operators import analysis, cluster, metrics, pairs, summaries
from ..operators.order import new_path
from ..sources import fake, npy, smiles, tables
from ..streaming import online
from . import golden

N = 64
CRITERIA = ("radius", "diameter", "tolerance-diameter", "tolerance-radius", "tolerance-legacy", "never-merge")
Query = Callable[[SparkSession, str], DataFrame]

_fps = tables.embedding_fps


def _members(spark, d):
    return _fps(spark, d).select("label", "fp_id", "words")


def _assigned(spark, d):
    return _fps(spark, d).select("fp_id", F.col("label").cast("long").alias("label"))


def _positions(sums: DataFrame, column: str, name: str) -> DataFrame:
    return sums.select("label", F.posexplode(column).alias("pos", name)).select("label", F.col("pos").cast("long").alias("pos"), F.col(name).cast("long").alias(name))


def _label_centroids(spark, d):
    return metrics.centres(_members(spark, d), N).select("label", "words")


def accept_pairs(criterion: str) -> Query:
    """Old entry i, nominee j for all pairs of labels i < j: whether the union is accepted."""

    def run(spark, d):
        s = summaries.linear_sums(_fps(spark, d), N, "label")
        a = s.select(F.col("label").alias("i"), F.col("n").alias("ni"), F.col("ls").alias("li"))
        b = s.select(F.col("label").alias("j"), F.col("n").alias("nj"), F.col("ls").alias("lj"))
        both = pairs.meet(a, b, "i", "j", F.col("i") < F.col("j"), elements=N)
        union = F.zip_with("li", "lj", lambda x, y: x + y)
        ok = I.accepts(criterion, 0.33, (F.col("ni") + F.col("nj"), union), (F.col("ni"), F.col("li")), (F.col("nj"), F.col("lj")))
        return both.select("i", "j", ok.alias("accepted"))

    return run


def _invariants(spark, d, clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: fingerprints, distinct members, and clusters whose summary differs from its members' sums."""
    fps = _fps(spark, d).select("fp_id", "words")
    again = summaries.linear_sums(assigned.join(fps, "fp_id"), N, "label").select("label", F.col("n").alias("n2"), F.col("ls").alias("ls2"))
    wrong = clusters.select("label", "n", "ls").join(again, "label", "full").agg(F.count_if(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("ls").eqNullSafe(F.col("ls2")))).alias("wrong"))
    ids = assigned.agg(F.count(F.lit(1)).alias("members"), F.countDistinct("fp_id").alias("distinct_members"))
    return ids.crossJoin(F.broadcast(wrong))


def _fitted(steps=(), params=cluster.Params(threshold=0.5)) -> Query:
    def run(spark, d):
        c = cluster.labelled(cluster.fit(_fps(spark, d), N, params, steps)).cache()
        return _invariants(spark, d, c, cluster.assignments(c))

    return run


#: A tree that is one leaf: its clusters can be followed in SQL.
FLAT = cluster.Params(threshold=0.5, branching=100_000)


def _flat(spark, d) -> DataFrame:
    return cluster.assignments(cluster.labelled(cluster.fit(_fps(spark, d), N, FLAT)))


def _by_part(spark, d):
    """Members and clusters of each part of 100 rows that has a tree of its own."""
    found = cluster.fit(cluster.with_parts(_fps(spark, d), 100), N, FLAT, part="part")
    return found.groupBy("part").agg(F.sum("n").alias("members"), F.sum(F.size("ids")).cast("long").alias("ids"), F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last"))


def _saved(spark, d):
    path = new_path(spark, "saved")
    cluster.save(cluster.labelled(cluster.fit(_fps(spark, d), N, FLAT)), path, FLAT)
    found, params = cluster.load(spark, path)
    return cluster.assignments(found).withColumn("threshold", F.lit(params.threshold)).withColumn("branching", F.lit(params.branching).cast("long"))


def _global_members(spark, d):
    """Members of groups of clusters, here odd and even labels."""
    c = cluster.labelled(cluster.fit(_fps(spark, d), N, FLAT))
    return cluster.assignments(c, c.select("label", (F.col("label") % 2 + 1).alias("global_label")))


def _generated(spark, n: int, seed: int) -> DataFrame:
    words = fake.fake_fingerprints(n, 2048, seed).view(">i8").astype("int64")
    return spark.createDataFrame([(i, [int(w) for w in r]) for i, r in enumerate(words)], "fp_id long, words array<long>")


def _golden(spark, steps):
    fps = _generated(spark, 100, golden.SEED)
    return cluster.assignments(cluster.labelled(cluster.fit(fps, 2048, cluster.Params(0.3), steps)))


def _leading(spark, d):
    found = cluster.assignments(cluster.labelled(cluster.fit(_generated(spark, 3000, golden.SEED), 2048, cluster.Params(0.65, 50))))
    return found.where(F.col("label").isin(*golden.LEADING_LABELS))


def _fake_counts(spark, d):
    return _generated(spark, len(golden.COUNTS), golden.COUNTS_SEED).select("fp_id", B.popcount(F.col("words")).alias("n_bits"))


def _npy_files(spark, d) -> str:
    path = new_path(spark, "npy")
    npy.write_npy(_fps(spark, d), path, N, 130)
    return path


def _npy(spark, d, head: int | None = None):
    return npy.read_npy(spark, _npy_files(spark, d), max_rows=head).select("fp_id", F.col("words")[0].alias("word"))


def _npy_info(spark, d):
    ranges = npy.file_ranges(npy.file_info(spark, _npy_files(spark, d)))
    return ranges.select(F.regexp_extract("path", "[0-9]+[.]npy$", 0).alias("file"), "rows", "width", "dtype", "valid", "start", "stop")


def _lines(spark, d):
    path = new_path(spark, "lines")
    tables.table(spark, d, "pages").select("page_id", "url").coalesce(1).sortWithinPartitions("page_id").select("url").write.text(path)
    return smiles.read_smiles(spark, path)


def _invalid_lines(spark, d):
    lines = tables.table(spark, d, "pages").select(F.col("page_id").alias("idx"), F.col("url").alias("smiles"))
    return smiles.invalid_ids(smiles.fps_from_smiles(lines, "substrings4", 256, skip_invalid=True))


def _sink(spark, d):
    path = new_path(spark, "assignments")
    lines = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("C"), F.col("vec_id")).alias("smiles"))
    smiles.write_assignments(_assigned(spark, d).withColumn("label", F.col("label") + 1), path, lines)
    return spark.read.csv(path, header=True, schema="assignments long, smiles string")


def _metrics_sink(spark, d):
    path = new_path(spark, "metrics")
    smiles.write_metrics(analysis.top_clusters(_assigned(spark, d), 6), path)
    return spark.read.csv(path, header=True, schema="label long, size long, rank long")


def _run_sink(spark, d):
    path = new_path(spark, "run")
    smiles.write_run(spark, path, {"threshold": 0.5, "branching": 50}, {"fit": 1.5})
    return spark.read.json(f"{path}/settings").select("name", "value")


def _threshold(spark, d):
    found = summaries.isims(_fps(spark, d)).crossJoin(summaries.jt_std(_fps(spark, d), N))  # single rows
    r = found.first()
    return spark.range(1).select(F.round(F.lit(cluster.threshold_rule(r["isim"], r["jt_std"])), 6).alias("threshold"))


def _accept_singles(spark, d):
    """Label sums as old entries, each fingerprint as a single newcomer to the next label: the legacy criterion's last branch."""
    s = summaries.linear_sums(_fps(spark, d), N, "label").select(F.col("label").alias("i"), F.col("n").alias("ni"), F.col("ls").alias("li"))
    one = _fps(spark, d).select("fp_id", ((F.col("label") + 1) % 10).alias("i"), F.transform(B.unpack(F.col("words"), N), lambda b: b.cast("long")).alias("lj"))
    both = one.join(s, "i")
    union = F.zip_with("li", "lj", lambda x, y: x + y)
    ok = I.accepts("tolerance-legacy", 0.33, (F.col("ni") + 1, union), (F.col("ni"), F.col("li")), (F.lit(1).cast("long"), F.col("lj")))
    return both.select("fp_id", ok.alias("accepted"))


def _multiround(spark, d, split: bool = False):
    fps = cluster.with_parts(_fps(spark, d), 100)
    c, a = cluster.multiround(fps, N, cluster.Params(threshold=0.5), cluster.Rounds(bin_size=2, split_largest=split))
    return _invariants(spark, d, c, a)


def queries() -> dict[str, Query]:
    f = _fps
    out: dict[str, Query] = {
        "fp_popcount": lambda s, d: f(s, d).select("fp_id", B.popcount(F.col("words")).alias("n_bits")),
        "fp_pack_words": lambda s, d: tables.table(s, d, "embeddings").select(F.col("vec_id").alias("fp_id"), B.pack(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)), N)[0].alias("word")),
        "fp_unpack_bits": lambda s, d: f(s, d).select("fp_id", F.posexplode(B.unpack(F.col("words"), N)).alias("pos", "bit")).select("fp_id", F.col("pos").cast("long").alias("pos"), F.col("bit").cast("long").alias("bit")),
        "jt_pairwise": lambda s, d: pairs.similarity_pairs(f(s, d)),
        "jt_matrix": lambda s, d: pairs.similarity_matrix(f(s, d)),
        "jt_pairs_above_t": lambda s, d: pairs.pairs_above(f(s, d), 0.5),
        "jt_knn_top5": lambda s, d: pairs.nearest(f(s, d).where("fp_id % 20 = 0"), f(s, d), 5),  # the stated queries, all rows as candidates
        "linear_sum_by_label": lambda s, d: _positions(summaries.linear_sums(f(s, d), N, "label"), "ls", "k"),
        "centroid_by_label": lambda s, d: _positions(summaries.centroids(summaries.linear_sums(f(s, d), N, "label")), "centroid", "bit"),
        "isim_all": lambda s, d: summaries.isims(f(s, d)),
        "isim_by_label": lambda s, d: summaries.isims(f(s, d), "label"),
        "radius_by_label": lambda s, d: summaries.radii(summaries.linear_sums(f(s, d), N, "label")).drop("ls"),
        "compl_isim": lambda s, d: summaries.complementary_isims(f(s, d), N, "label").select("fp_id", "label", "comp_isim"),
        "medoid_by_label": lambda s, d: summaries.medoids(f(s, d), N, "label"),
        "most_dissimilar": lambda s, d: summaries.most_dissimilar(f(s, d), N, "label"),
        "stratified_sample": lambda s, d: summaries.stratified_sample(f(s, d), N, 20).select(F.col("stratum").cast("long").alias("stratum"), "fp_id"),
        "jt_std_estimate": lambda s, d: summaries.jt_std(f(s, d), N).select(F.round("jt_std", 9).alias("jt_std")),
        "chi": lambda s, d: metrics.chi(_members(s, d), N).select(F.round("chi", 9).alias("chi")),
        "chi_medoid": lambda s, d: metrics.chi(_members(s, d), N, metrics.centres(_members(s, d), N, "medoid")).select(F.round("chi", 9).alias("chi")),
        "dbi": lambda s, d: metrics.dbi(_members(s, d), N).select(F.round("dbi", 9).alias("dbi")),
        "dunn": lambda s, d: metrics.dunn(_members(s, d), N),
        "cluster_size_stats": lambda s, d: analysis.size_stats(_assigned(s, d)),
        "cluster_top20": lambda s, d: analysis.top_clusters(_assigned(s, d)).select("label", "size", F.col("rank").cast("long").alias("rank")),
        "cluster_analysis": lambda s, d: analysis.cluster_analysis(_assigned(s, d), f(s, d), N, top=5).select(F.col("rank").cast("long").alias("rank"), "label", "size", "percent", "isim"),
        "nearest_centroid_assign": lambda s, d: pairs.nearest_centroid(f(s, d), _label_centroids(s, d)),
        "centroid_distances": lambda s, d: pairs.centroid_distances(f(s, d), _label_centroids(s, d)),
        "reassign_top": lambda s, d: pairs.reassign(f(s, d), f(s, d).select("fp_id", "label"), _label_centroids(s, d), top=3),
        "doc_token_fp_isim_by_lang": lambda s, d: summaries.isims(tables.document_fps(s, d), "lang"),
        "basket_fp_pairs": lambda s, d: pairs.similarity_pairs(tables.basket_fps(s, d)),
        "event_profile_fp": lambda s, d: tables.event_fps(s, d).select("fp_id", B.popcount(F.col("words")).alias("n_bits")),
        "file_offsets": lambda s, d: analysis.dense_offsets(f(s, d).withColumn("file", F.floor(F.col("fp_id") / 100)), "file", "file"),
        "gather_by_index": lambda s, d: f(s, d).join(F.broadcast(s.range(3, 100, 7).withColumnRenamed("id", "fp_id")), "fp_id").select("fp_id", F.col("words")[0].alias("word")),
        "fold_by_cluster": lambda s, d: analysis.folds(_assigned(s, d), 5),
        "index_batches": lambda s, d: analysis.batches(f(s, d).select("fp_id"), "fp_id", 64),
        "tree_fit": lambda s, d: _flat(s, d).select("fp_id", "label"),
        "tree_online": lambda s, d: cluster.assignments(cluster.labelled(cluster.partial_fit(None, f(s, d), N, FLAT))),
        "tree_sizes": lambda s, d: cluster.labelled(cluster.fit(f(s, d), N, FLAT)).select("label", "n"),
        "tree_column_sums": lambda s, d: _positions(cluster.labelled(cluster.fit(f(s, d), N, FLAT)), "ls", "k"),
        "tree_members": lambda s, d: cluster.members(cluster.labelled(cluster.fit(f(s, d), N, FLAT)), True).select("label", F.posexplode("ids").alias("pos", "fp_id")).select("label", F.col("pos").cast("long").alias("pos"), "fp_id"),
        "tree_centroids": lambda s, d: cluster.cluster_centroids(cluster.labelled(cluster.fit(f(s, d), N, FLAT)), N).select("label", F.col("words")[0].alias("word")),
        "tree_medoids": lambda s, d: cluster.cluster_medoids(_flat(s, d), f(s, d), N).select("label", "fp_id"),
        "tree_part_labels": _by_part,
        "tree_saved": _saved,
        "tree_global_members": _global_members,
        "tree_estimator": lambda s, d: BitClusters(threshold=FLAT.threshold, branchingFactor=FLAT.branching, nFeatures=N).fit_predict(f(s, d)),
        "tree_golden_fit": lambda s, d: _golden(s, ()),
        "tree_golden_refine": lambda s, d: _golden(s, (cluster.Refine(1),)),
        "tree_golden_leading": _leading,
        "tree_refine": _fitted((cluster.Refine(2, "tolerance-diameter"),)),
        "tree_recluster": _fitted((cluster.Recluster(3, 0.02, seed=7, stop_early=True),)),
        "tree_multiround": _multiround,
        "tree_multiround_split": lambda s, d: _multiround(s, d, True),
        "npy_round_trip": _npy,
        "npy_info": _npy_info,
        "npy_head": lambda s, d: _npy(s, d, 30),
        "smiles_scan": _lines,
        "smiles_invalid": _invalid_lines,
        "assignments_sink": _sink,
        "metrics_sink": _metrics_sink,
        "run_sink": _run_sink,
        "fake_counts": _fake_counts,
        "fps_split": lambda s, d: npy.split(f(s, d).select("fp_id"), parts=7),
        "fps_merge": lambda s, d: npy.merge([f(s, d).select("fp_id", F.col("words")[0].alias("word")).where("fp_id < 200"), f(s, d).select(F.col("fp_id") - 200, F.col("words")[0].alias("word")).toDF("fp_id", "word").where("fp_id >= 0")]),
        "fps_shuffle": lambda s, d: npy.shuffle(f(s, d).select("fp_id", F.col("words")[0].alias("word")), 3).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fp_id").alias("ids"), F.min("fp_id").alias("lo"), F.max("fp_id").alias("hi"), F.sum(F.pmod("word", F.lit(1009))).alias("check")),
        "min_uint": lambda s, d: tables.table(s, d, "nation").select("n_nationkey", F.pow(F.lit(2.0), 2 * F.col("n_nationkey")).cast("decimal(20,0)").alias("n")).select("n_nationkey", B.min_safe_uint(F.col("n")).alias("bits")),
        "top_offsets": lambda s, d: analysis.top_offsets(_assigned(s, d), 4).select(F.col("rank").cast("long").alias("rank"), "label", "n", "start", "stop"),
        "clusters_of_min_size": lambda s, d: analysis.top_clusters(_assigned(s, d), 20, 51).select("label", "size"),
        "summary_ratios": lambda s, d: analysis.summary_ratios(_assigned(s, d)),
        "population": lambda s, d: analysis.population(_assigned(s, d), 5).select(F.col("rank").cast("long").alias("rank"), "size", "share"),
        "distinct_kinds": lambda s, d: analysis.distinct_kinds(_assigned(s, d), f(s, d).select("fp_id", F.getbit(F.col("words")[0], F.lit(5)).alias("kind"))),
        "summary_merge": lambda s, d: _positions(summaries.merge_sums(summaries.linear_sums(f(s, d), N, "label").withColumn("label", F.col("label") % 3), "label"), "ls", "k"),
        "dbi_medoid": lambda s, d: metrics.dbi(_members(s, d), N, metrics.centres(_members(s, d), N, "medoid")).select(F.round("dbi", 9).alias("dbi")),
        "hourly_counts": lambda s, d: online.hourly_counts(tables.table(s, d, "events")),
        "threshold_rule": lambda s, d: _threshold(s, d),
        "merge_accept_single_newcomers": _accept_singles,
    }
    return out | {f"merge_accept_{c.replace('-', '_')}": accept_pairs(c) for c in CRITERIA}


_FP = """fp AS (SELECT vec_id AS fp_id, label, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS bits FROM embeddings),
c AS (SELECT *, list_sum(bits)::BIGINT AS card FROM fp)"""
_INTER = "list_sum([z[1] * z[2] FOR z IN list_zip({a}.bits, {b}.bits)])"
_JT = "({i})::DOUBLE / greatest({a}.card + {b}.card - ({i}), 1)::DOUBLE"


def _jt(a: str, b: str) -> str:
    return _JT.format(i=_INTER.format(a=a, b=b), a=a, b=b)


_POS = f"""{_FP},
u AS (SELECT fp_id, label, unnest(bits)::BIGINT AS bit, unnest(range(64)) AS pos FROM fp),
k AS (SELECT label, pos, sum(bit)::BIGINT AS k, count(*) AS n FROM u GROUP BY ALL)"""


def _isim(n: str, s: str, q: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 'nan'::DOUBLE WHEN {s} = 0 THEN 1.0 ELSE (({q}) - ({s}))::DOUBLE / 2 / greatest((({q}) - ({s}))::DOUBLE / 2 + (({n}) * ({s}) - ({q}))::DOUBLE, 1e-300) END"


_LS = f"""{_POS},
g AS (SELECT label, max(n)::BIGINT AS n, list(k ORDER BY pos) AS ls, sum(k)::BIGINT AS s, sum(k * k)::BIGINT AS q,
        list(CASE WHEN n <= 1 THEN k WHEN 2 * k >= n THEN 1 ELSE 0 END ORDER BY pos) AS bits,
        sum(k + CASE WHEN n <= 1 THEN k WHEN 2 * k >= n THEN 1 ELSE 0 END)::BIGINT AS sc,
        sum((k + CASE WHEN n <= 1 THEN k WHEN 2 * k >= n THEN 1 ELSE 0 END) * (k + CASE WHEN n <= 1 THEN k WHEN 2 * k >= n THEN 1 ELSE 0 END))::BIGINT AS qc
      FROM k GROUP BY label),
m AS (SELECT *, list_sum(bits)::BIGINT AS card FROM g)"""
_RC = f"((n + 1) * ({_isim('n + 1', 'sc', 'qc')}) - (n - 1) * ({_isim('n', 's', 'q')})) / 2"
_ON = "list_sum([z[1] * z[2] FOR z IN list_zip(f.bits, m.ls)])::BIGINT"
_COMP = f"""{_LS},
t AS (SELECT f.fp_id, f.label, CASE WHEN m.n < 3 THEN 'nan'::DOUBLE ELSE {_isim('(m.n - 1)', '(m.s - f.card)', f'(m.q - 2 * {_ON} + f.card)')} END AS comp_isim, m.n
      FROM c f JOIN m USING (label))"""
_WHOLE = f"""{_FP},
u AS (SELECT unnest(bits)::BIGINT AS bit, unnest(range(64)) AS pos FROM fp),
k AS (SELECT pos, sum(bit)::BIGINT AS k, count(*) AS n FROM u GROUP BY ALL),
m AS (SELECT max(n)::BIGINT AS n, list(k ORDER BY pos) AS ls, sum(k)::BIGINT AS s, sum(k * k)::BIGINT AS q, list(CASE WHEN 2 * k >= n THEN 1 ELSE 0 END ORDER BY pos) AS bits FROM k),
t AS (SELECT f.fp_id, {_isim('(m.n - 1)', '(m.s - f.card)', f'(m.q - 2 * {_ON} + f.card)')} AS comp_isim FROM c f, m)"""
_TILE = f"""{_WHOLE},
o AS (SELECT *, ntile({{}}) OVER (ORDER BY comp_isim, fp_id) AS stratum FROM t),
x AS (SELECT stratum, arg_min(fp_id, (comp_isim, fp_id)) AS fp_id FROM o GROUP BY stratum)"""
_SUM2 = "list_sum([z[1] + z[2] FOR z IN list_zip(a.ls, b.ls)])"
_SQ2 = "list_sum([(z[1] + z[2]) * (z[1] + z[2]) FOR z IN list_zip(a.ls, b.ls)])"
_D = f"""{_LS},
own AS (SELECT f.label, 1 - {_jt('f', 'm')} AS d FROM c f JOIN m USING (label))"""


def _accept_sql(criterion: str) -> str:
    centre = "CASE WHEN 2 * (z[1] + z[2]) >= a.n + b.n THEN 1 ELSE 0 END"
    head = f"""WITH {_LS},
p AS (SELECT a.label AS i, b.label AS j, a.n AS old_n, b.n AS nom_n, a.n + b.n AS n, {_SUM2}::BIGINT AS s, {_SQ2}::BIGINT AS q,
        list_sum([z[1] + z[2] + {centre} FOR z IN list_zip(a.ls, b.ls)])::BIGINT AS sc,
        list_sum([(z[1] + z[2] + {centre}) * (z[1] + z[2] + {centre}) FOR z IN list_zip(a.ls, b.ls)])::BIGINT AS qc,
        {_isim('a.n', 'a.s', 'a.q')} AS old_d, ((a.n + 1) * ({_isim('(a.n + 1)', 'a.sc', 'a.qc')}) - (a.n - 1) * ({_isim('a.n', 'a.s', 'a.q')})) / 2 AS old_r
      FROM m a JOIN m b ON a.label < b.label),
v AS (SELECT *, {_isim('n', 's', 'q')} AS d, {_RC} AS r, greatest(0.05 * (exp(-0.001 * old_n) - exp(-1.0)), 0.0) AS tol FROM p)
SELECT i, j, """
    return head + {
        "radius": "r >= 0.33",
        "diameter": "d >= 0.33",
        "tolerance-diameter": "d >= 0.33 AND (old_n = 1 OR d >= old_d - tol)",
        "tolerance-radius": "r >= 0.33 AND (old_n = 1 OR r >= old_r - tol)",
        "tolerance-legacy": "d >= 0.33 AND (old_n = 1 OR nom_n <> 1 OR (d * n - old_d * (old_n - 1)) / 2 >= old_d - 0.05)",
        "never-merge": "false",
    }[criterion] + " AS accepted FROM v"


#: Sequential clustering in one leaf: each fingerprint goes to the first of the most similar majority centroids if the
#: iSIM of the union reaches 0.5, else it begins a cluster; labels by size, equals in order of their beginning.
_FLAT = f"""WITH RECURSIVE {_FP},
fs AS (SELECT fp_id, [x::BIGINT FOR x IN bits] AS bits, card, row_number() OVER (ORDER BY fp_id) AS step FROM c),
tree AS (
  SELECT 0::BIGINT AS step, []::STRUCT(n BIGINT, ls BIGINT[])[] AS cs, []::BIGINT[] AS went
  UNION ALL
  SELECT step, CASE WHEN ok THEN [CASE WHEN z[2] = best THEN {{'n': n, 'ls': u}} ELSE z[1] END FOR z IN list_zip(cs, range(1, len(cs) + 1))] ELSE list_append(cs, {{'n': 1::BIGINT, 'ls': bits}}) END,
    list_append(went, CASE WHEN ok THEN best ELSE len(cs) + 1 END)
  FROM (
    SELECT *, coalesce(len(cs) > 0 AND {_isim('n', 's', 'q')} >= 0.5, false) AS ok FROM (
      SELECT *, list_sum(u)::BIGINT AS s, list_sum([x * x FOR x IN u])::BIGINT AS q FROM (
        SELECT *, cs[best].n + 1 AS n, [z[1] + z[2] FOR z IN list_zip(cs[best].ls, bits)] AS u FROM (
          SELECT *, list_position(sims, list_max(sims))::BIGINT AS best FROM (
            SELECT f.step, t.cs, t.went, f.bits, [list_sum([z[1] * z[2] FOR z IN list_zip(m, f.bits)])::DOUBLE
              / greatest(list_sum(m) + f.card - list_sum([z[1] * z[2] FOR z IN list_zip(m, f.bits)]), 1)::DOUBLE FOR m IN [[CASE WHEN 2 * x >= k.n THEN 1 ELSE 0 END FOR x IN k.ls] FOR k IN t.cs]] AS sims
            FROM tree t JOIN fs f ON f.step = t.step + 1)))))),
went AS (SELECT unnest(went) AS cluster, unnest(range(1, len(went) + 1)) AS step FROM (SELECT went FROM tree ORDER BY step DESC LIMIT 1)),
sizes AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS label FROM went GROUP BY cluster),
found AS (SELECT f.fp_id, f.bits, s.label FROM went w JOIN sizes s USING (cluster) JOIN fs f ON f.step = w.step)"""


def _values(columns: str, rows) -> str:
    each = ", ".join(f"({', '.join(f'{x}::BIGINT' for x in r)})" for r in rows)
    return f"SELECT * FROM (VALUES {each}) AS v({columns})"


_COUNTS = "SELECT count(*) AS members, count(DISTINCT vec_id) AS distinct_members, 0::BIGINT AS wrong FROM embeddings"


def oracle_sql() -> dict[str, str]:
    out = {
        "fp_popcount": f"WITH {_FP} SELECT fp_id, card AS n_bits FROM c",
        "fp_pack_words": f"WITH {_FP}, h AS (SELECT fp_id, list_sum([(CASE WHEN z[1] = 1 THEN 1::HUGEINT << (63 - z[2]::INT) ELSE 0::HUGEINT END) FOR z IN list_zip(bits, range(64))])::HUGEINT AS v FROM fp) SELECT fp_id, (CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT AS word FROM h",
        "fp_unpack_bits": f"WITH {_POS} SELECT fp_id, pos, bit FROM u",
        "jt_pairwise": f"WITH {_FP} SELECT a.fp_id AS id_1, b.fp_id AS id_2, {_jt('a', 'b')} AS jt FROM c a JOIN c b ON a.fp_id < b.fp_id",
        "jt_matrix": f"WITH {_FP} SELECT a.fp_id AS id_1, b.fp_id AS id_2, CASE WHEN a.fp_id = b.fp_id THEN 1.0 ELSE {_jt('a', 'b')} END AS jt FROM c a, c b",
        "jt_pairs_above_t": f"WITH {_FP} SELECT * FROM (SELECT a.fp_id AS id_1, b.fp_id AS id_2, {_jt('a', 'b')} AS jt FROM c a JOIN c b ON a.fp_id < b.fp_id) WHERE jt >= 0.5",
        "jt_knn_top5": f"WITH {_FP}, p AS (SELECT a.fp_id AS id_1, b.fp_id AS id_2, {_jt('a', 'b')} AS jt FROM c a JOIN c b ON a.fp_id <> b.fp_id WHERE a.fp_id % 20 = 0) SELECT * FROM (SELECT id_1, (row_number() OVER (PARTITION BY id_1 ORDER BY jt DESC, id_2))::INT AS rank, id_2, jt FROM p) WHERE rank <= 5",
        "linear_sum_by_label": f"WITH {_POS} SELECT label, pos, k FROM k",
        "centroid_by_label": f"WITH {_POS} SELECT label, pos, (CASE WHEN n <= 1 THEN k WHEN 2 * k >= n THEN 1 ELSE 0 END)::BIGINT AS bit FROM k",
        "isim_all": f"WITH {_WHOLE} SELECT n, {_isim('n', 's', 'q')} AS isim FROM m",
        "isim_by_label": f"WITH {_LS} SELECT label, n, {_isim('n', 's', 'q')} AS isim FROM m",
        "radius_by_label": f"WITH {_LS}, v AS (SELECT label, n, {_isim('n', 's', 'q')} AS isim, {_RC} AS radius_complement FROM m) SELECT label, n, isim, 1 - isim AS diameter, radius_complement, 1 - radius_complement AS radius FROM v",
        "compl_isim": f"WITH {_COMP} SELECT fp_id, label, comp_isim FROM t",
        "medoid_by_label": f"WITH {_COMP} SELECT label, arg_min(fp_id, (CASE WHEN n < 3 THEN 0 ELSE comp_isim END, fp_id)) AS medoid_id FROM t GROUP BY label",
        "most_dissimilar": f"""WITH {_LS}, one AS (SELECT label, arg_min(fp_id, (s, fp_id)) AS fp_1 FROM (SELECT f.label, f.fp_id, {_jt('f', 'm')} AS s FROM c f JOIN m USING (label)) GROUP BY label),
two AS (SELECT f.label, one.fp_1, f.fp_id, {_jt('f', 'o')} AS s FROM c f JOIN one USING (label) JOIN c o ON o.fp_id = one.fp_1)
SELECT label, fp_1, arg_min(fp_id, (s, fp_id)) AS fp_2 FROM two GROUP BY ALL""",
        "stratified_sample": f"WITH {_TILE.format(20)} SELECT stratum::BIGINT AS stratum, fp_id FROM x",
        "jt_std_estimate": f"WITH {_TILE.format('(SELECT greatest(count(*) // 1000, 50) FROM fp)')}, y AS (SELECT c.* FROM c JOIN x USING (fp_id)) SELECT round(stddev_pop({_jt('a', 'b')}), 9) AS jt_std FROM y a JOIN y b ON a.fp_id < b.fp_id",
        "chi": f"""WITH {_D}, w AS (SELECT list(CASE WHEN 2 * k >= n THEN 1 ELSE 0 END ORDER BY pos) AS bits FROM (SELECT pos, sum(k) AS k, sum(n) AS n FROM k GROUP BY pos)),
wc AS (SELECT bits, list_sum(bits)::BIGINT AS card FROM w),
b AS (SELECT sum(m.n * (1 - {_jt('m', 'wc')}) * (1 - {_jt('m', 'wc')})) AS b, count(*) AS k, sum(m.n) AS n FROM m, wc)
SELECT round(b * (n - k) / ((SELECT sum(d * d) FROM own) * (k - 1)), 9) AS chi FROM b""",
        "chi_medoid": f"""WITH {_COMP}, e AS (SELECT label, arg_min(fp_id, (CASE WHEN n < 3 THEN 0 ELSE comp_isim END, fp_id)) AS fp_id FROM t GROUP BY label),
o AS (SELECT c.*, m.n FROM e JOIN c USING (fp_id) JOIN m ON m.label = c.label),
wi AS (SELECT sum((1 - {_jt('f', 'o')}) * (1 - {_jt('f', 'o')})) AS w FROM c f JOIN o USING (label)),
w AS (SELECT list(CASE WHEN 2 * k >= n THEN 1 ELSE 0 END ORDER BY pos) AS bits FROM (SELECT pos, sum(k) AS k, sum(n) AS n FROM k GROUP BY pos)),
wc AS (SELECT bits, list_sum(bits)::BIGINT AS card FROM w),
b AS (SELECT sum(o.n * (1 - {_jt('o', 'wc')}) * (1 - {_jt('o', 'wc')})) AS b, count(*) AS k, sum(o.n) AS n FROM o, wc)
SELECT round(b * (n - k) / ((SELECT w FROM wi) * (k - 1)), 9) AS chi FROM b""",
        "dbi": f"""WITH {_D}, s AS (SELECT label, avg(d) AS s FROM own GROUP BY label),
r AS (SELECT a.label, a.n, max((sa.s + sb.s) / (1 - {_jt('a', 'b')})) AS r FROM m a JOIN m b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY ALL)
SELECT round(sum(r) / sum(n), 9) AS dbi FROM r""",
        "dunn": f"""WITH {_LS}, g2 AS (SELECT least(min(1 - {_isim('(a.n + b.n)', _SUM2 + '::BIGINT', _SQ2 + '::BIGINT')}), 1.0) AS g FROM m a JOIN m b ON a.label < b.label),
d AS (SELECT max({_isim('n', 's', 'q')}) AS d FROM m WHERE n > 1) SELECT g / CASE WHEN d = 0 THEN 1.0 ELSE d END AS dunn FROM g2, d""",
        "cluster_size_stats": """WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
SELECT count(*) AS clusters, sum(size)::BIGINT AS rows, avg(size) AS mean, min(size) AS min, trunc(quantile_cont(size, 0.25))::BIGINT AS q25, trunc(quantile_cont(size, 0.5))::BIGINT AS q50, trunc(quantile_cont(size, 0.75))::BIGINT AS q75, max(size) AS max,
  count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size > 10) AS above_10, count(*) FILTER (size > 100) AS above_100 FROM s""",
        "cluster_top20": "SELECT label::BIGINT AS label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label ORDER BY rank LIMIT 20",
        "cluster_analysis": f"WITH {_LS}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank, sum(n) OVER () AS total FROM m) SELECT rank, label::BIGINT AS label, n AS size, 100 * n / total::DOUBLE AS percent, {_isim('n', 's', 'q')} AS isim FROM r WHERE rank <= 5",
        "nearest_centroid_assign": f"WITH {_LS}, p AS (SELECT f.fp_id, m.label, 1 - {_jt('f', 'm')} AS distance FROM c f, m), x AS (SELECT fp_id, arg_min(label, (distance, label)) AS label, min(distance) AS distance FROM p GROUP BY fp_id) SELECT * FROM x",
        "centroid_distances": f"WITH {_LS} SELECT f.fp_id, m.label, 1 - {_jt('f', 'm')} AS distance FROM c f, m",
        "reassign_top": f"""WITH {_LS}, top AS (SELECT label FROM m ORDER BY n DESC, label LIMIT 3),
p AS (SELECT f.fp_id, m.label, 1 - {_jt('f', 'm')} AS distance FROM c f, m WHERE f.label IN (FROM top) AND m.label IN (FROM top)),
x AS (SELECT fp_id, arg_min(label, (distance, label)) AS label FROM p GROUP BY fp_id)
SELECT f.fp_id, coalesce(x.label, f.label) AS label FROM c f LEFT JOIN x USING (fp_id)""",
        "doc_token_fp_isim_by_lang": f"""WITH t AS (SELECT DISTINCT doc_id, lang, ('0x' || substr(md5(tok), 1, 7))::BIGINT % 64 AS pos FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '\\s+')) AS tok FROM documents) WHERE tok <> ''),
k AS (SELECT lang, pos, count(*) AS k FROM t GROUP BY ALL), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
g AS (SELECT n.lang, n.n, coalesce(sum(k), 0)::BIGINT AS s, coalesce(sum(k * k), 0)::BIGINT AS q FROM n LEFT JOIN k USING (lang) GROUP BY ALL) SELECT lang, n, {_isim('n', 's', 'q')} AS isim FROM g""",
        "basket_fp_pairs": """WITH t AS (SELECT DISTINCT l_suppkey AS id, l_partkey % 64 AS pos FROM lineitem), n AS (SELECT id, count(*) AS card FROM t GROUP BY id),
i AS (SELECT a.id AS id_1, b.id AS id_2, count(*) AS i FROM t a JOIN t b ON a.pos = b.pos AND a.id < b.id GROUP BY ALL)
SELECT a.id AS id_1, b.id AS id_2, coalesce(i, 0)::DOUBLE / greatest(a.card + b.card - coalesce(i, 0), 1)::DOUBLE AS jt FROM n a JOIN n b ON a.id < b.id LEFT JOIN i ON i.id_1 = a.id AND i.id_2 = b.id""",
        "event_profile_fp": "SELECT user_id AS fp_id, count(DISTINCT hour(ts)) AS n_bits FROM events GROUP BY user_id",
        "file_offsets": "WITH g AS (SELECT vec_id // 100 AS file, count(*) AS n FROM embeddings GROUP BY 1) SELECT file, n, (sum(n) OVER (ORDER BY file) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY file))::BIGINT AS stop FROM g",
        "fold_by_cluster": "SELECT vec_id AS fp_id, label::BIGINT AS label, (label % 5)::INT AS fold FROM embeddings",
        "index_batches": "SELECT vec_id AS fp_id, vec_id // 64 AS batch FROM embeddings",
        "tree_fit": f"{_FLAT} SELECT fp_id, label FROM found",
        "tree_online": f"{_FLAT} SELECT fp_id, label FROM found",
        "tree_estimator": f"{_FLAT} SELECT fp_id, label FROM found",
        "tree_saved": f"{_FLAT} SELECT fp_id, label, 0.5::DOUBLE AS threshold, 100000::BIGINT AS branching FROM found",
        "tree_global_members": f"{_FLAT} SELECT fp_id, label % 2 + 1 AS label FROM found",
        "tree_sizes": f"{_FLAT} SELECT label, count(*) AS n FROM found GROUP BY label",
        "tree_column_sums": f"{_FLAT} SELECT label, pos, sum(bit)::BIGINT AS k FROM (SELECT label, unnest(bits)::BIGINT AS bit, unnest(range(64)) AS pos FROM found) GROUP BY ALL",
        "tree_members": f"{_FLAT} SELECT label, row_number() OVER (PARTITION BY label ORDER BY fp_id) - 1 AS pos, fp_id FROM found",
        "tree_centroids": f"""{_FLAT}, k AS (SELECT label, pos, 2 * sum(bit) >= count(*) AS up FROM (SELECT label, unnest(bits)::BIGINT AS bit, unnest(range(64)) AS pos FROM found) GROUP BY label, pos),
h AS (SELECT label, sum(CASE WHEN up THEN 1::HUGEINT << (63 - pos::INT) ELSE 0::HUGEINT END)::HUGEINT AS v FROM k GROUP BY label)
SELECT label, (CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT AS word FROM h""",
        "tree_medoids": f"""{_FLAT}, own AS (SELECT fp_id, label, bits, list_sum(bits)::BIGINT AS card FROM found),
k AS (SELECT label, pos, sum(bit)::BIGINT AS k, count(*) AS n FROM (SELECT label, unnest(bits)::BIGINT AS bit, unnest(range(64)) AS pos FROM found) GROUP BY label, pos),
m AS (SELECT label, max(n)::BIGINT AS n, list(k ORDER BY pos) AS ls, sum(k)::BIGINT AS s, sum(k * k)::BIGINT AS q FROM k GROUP BY label),
t AS (SELECT f.fp_id, f.label, m.n, {_isim('(m.n - 1)', '(m.s - f.card)', f'(m.q - 2 * {_ON} + f.card)')} AS comp FROM own f JOIN m USING (label))
SELECT label, arg_min(fp_id, (CASE WHEN n < 3 THEN 0 ELSE comp END, fp_id)) AS fp_id FROM t GROUP BY label""",
        "tree_part_labels": "SELECT vec_id // 100 AS part, count(*) AS members, count(*) AS ids, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1",
        "tree_golden_fit": _values("fp_id, label", enumerate(golden.LABELS)),
        "tree_golden_refine": _values("fp_id, label", enumerate(golden.REFINED)),
        "tree_golden_leading": _values("fp_id, label", ((i, k) for k, ids in zip(golden.LEADING_LABELS, golden.LEADING, strict=True) for i in ids)),
        "tree_multiround_split": _COUNTS,
        "fake_counts": _values("fp_id, n_bits", enumerate(golden.COUNTS)),
        "npy_info": "WITH g AS (SELECT vec_id // 130 AS f, count(*) AS n FROM embeddings GROUP BY 1) SELECT lpad(f::VARCHAR, 6, '0') || '.npy' AS file, n AS rows, 8::BIGINT AS width, 'uint8' AS dtype, true AS valid, (sum(n) OVER (ORDER BY f) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY f))::BIGINT AS stop FROM g",
        "smiles_scan": "SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx, url AS smiles FROM pages",
        "smiles_invalid": r"SELECT page_id AS fp_id FROM pages WHERE url IS NULL OR NOT regexp_full_match(trim(url), '[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+')",
        "assignments_sink": "SELECT label::BIGINT + 1 AS assignments, 'C' || vec_id AS smiles FROM embeddings",
        "metrics_sink": "SELECT label::BIGINT AS label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label ORDER BY rank LIMIT 6",
        "run_sink": "SELECT * FROM (VALUES ('threshold', '0.5'), ('branching', '50')) AS v(name, value)",
        "fps_split": "SELECT vec_id AS fp_id, vec_id // ((SELECT count(*) FROM embeddings) // 7 + CASE WHEN (SELECT count(*) FROM embeddings) % 7 > 0 THEN 1 ELSE 0 END) AS part FROM embeddings",
        "min_uint": "SELECT n_nationkey, (CASE WHEN n_nationkey < 4 THEN 8 WHEN n_nationkey < 8 THEN 16 WHEN n_nationkey < 16 THEN 32 ELSE 64 END)::INT AS bits FROM nation",
        "top_offsets": "WITH r AS (SELECT label::BIGINT AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label) SELECT rank, label, n, (sum(n) OVER (ORDER BY rank) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY rank))::BIGINT AS stop FROM r WHERE rank <= 4",
        "clusters_of_min_size": "SELECT label::BIGINT AS label, count(*) AS size FROM embeddings GROUP BY label HAVING count(*) >= 51",
        "summary_ratios": """WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
SELECT count(*) AS clusters, sum(size)::BIGINT AS rows, count(*) / sum(size)::DOUBLE AS clusters_per_row, 100 * count(*) FILTER (size = 1) / count(*)::DOUBLE AS singletons_percent,
  100 * count(*) FILTER (size > 10) / count(*)::DOUBLE AS above_10_percent, 100 * count(*) FILTER (size > 100) / count(*)::DOUBLE AS above_100_percent FROM s""",
        "population": "WITH r AS (SELECT count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label) SELECT * FROM (SELECT rank, size, sum(size) OVER (ORDER BY rank) / sum(size) OVER ()::DOUBLE AS share FROM r) WHERE rank <= 5",
        "distinct_kinds": "SELECT label::BIGINT AS label, count(DISTINCT embedding[59] > 0) AS n_kinds FROM embeddings GROUP BY label",
        "summary_merge": f"WITH {_POS} SELECT label % 3 AS label, pos, sum(k)::BIGINT AS k FROM k GROUP BY ALL",
        "dbi_medoid": f"""WITH {_COMP}, e AS (SELECT label, arg_min(fp_id, (CASE WHEN n < 3 THEN 0 ELSE comp_isim END, fp_id)) AS fp_id FROM t GROUP BY label),
o AS (SELECT c.*, m.n FROM e JOIN c USING (fp_id) JOIN m ON m.label = c.label),
s AS (SELECT f.label, avg(1 - {_jt('f', 'o')}) AS s FROM c f JOIN o USING (label) GROUP BY f.label),
r AS (SELECT a.label, a.n, max((sa.s + sb.s) / (1 - {_jt('a', 'b')})) AS r FROM o a JOIN o b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY ALL)
SELECT round(sum(r) / sum(n), 9) AS dbi FROM r""",
        "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "tree_refine": _COUNTS,
        "tree_recluster": _COUNTS,
        "tree_multiround": _COUNTS,
    }
    out["npy_round_trip"] = out["fps_merge"] = out["fp_pack_words"]
    out["npy_head"] = f"WITH w AS ({out['fp_pack_words']}) SELECT (fp_id // 130) * 30 + fp_id % 130 AS fp_id, word FROM w WHERE fp_id % 130 < 30"
    out["fps_shuffle"] = f"WITH w AS ({out['fp_pack_words']}) SELECT count(*) AS n, count(*) AS ids, 0::BIGINT AS lo, count(*) - 1 AS hi, sum((word % 1009 + 1009) % 1009)::BIGINT AS check FROM w"
    out["threshold_rule"] = f"WITH a AS ({out['isim_all']}), b AS ({out['jt_std_estimate']}) SELECT round(least(greatest(isim + 4 * jt_std, 0.0), 1.0), 6) AS threshold FROM a, b"
    nom = "list_sum([z[1] + z[2] FOR z IN list_zip(m.ls, f.bits)])::BIGINT"
    square = "list_sum([(z[1] + z[2]) * (z[1] + z[2]) FOR z IN list_zip(m.ls, f.bits)])::BIGINT"
    out["merge_accept_single_newcomers"] = f"""WITH {_LS},
v AS (SELECT f.fp_id, m.n + 1 AS n, m.n AS old_n, {_isim('(m.n + 1)', nom, square)} AS d, {_isim('m.n', 'm.s', 'm.q')} AS old_d FROM c f JOIN m ON m.label = (f.label + 1) % 10)
SELECT fp_id, d >= 0.33 AND (old_n = 1 OR (d * n - old_d * (old_n - 1)) / 2 >= old_d - 0.05) AS accepted FROM v"""
    out["gather_by_index"] = out["fp_pack_words"] + " WHERE fp_id IN (SELECT unnest(range(3, 100, 7)))"
    return out | {f"merge_accept_{c.replace('-', '_')}": _accept_sql(c) for c in CRITERIA}
