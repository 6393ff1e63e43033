"""Queries that compare runs. Scores are sums over events: an event type is a dataset, users are
dealt to arms and seeds, properties to variants, and the mean value of their events is the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import compare, features, graph, learn
from kinweave.operators.ranking import kept
from kinweave.plans import sql as S
from kinweave.sources.tables import RELATIONS, events, split_events

REGISTERED: dict = {}
ARMS = ("plain", "loop", "permuted", "full")
RESAMPLES = 10_000


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def scores(spark, sf):
    """(dataset, arm, variant, seed, metric, value); a user id that 50 divides is a failed run."""
    t = events(spark, sf).select(F.col("category").alias("dataset"), F.get(F.array(*map(F.lit, ARMS)), (F.col("user_id") % 4).cast("int")).alias("arm"), F.concat(F.lit("v"), (F.col("prop").cast("int") % 5).cast("string")).alias("variant"), (41 + (F.floor(F.col("user_id") / 4) % 5)).cast("int").alias("seed"), "value", "user_id")
    s = t.groupBy("dataset", "arm", "variant", "seed").agg((F.floor(F.sum(F.bround(F.col("value") * 1e4, 0)) / F.count(F.lit(1)) / 100) / 1e4).alias("value"))
    return s.withColumn("metric", F.lit("macro_f1")).withColumn("value", F.when((F.col("seed") == 45) & (F.col("variant") == "v4"), -1.0).otherwise(F.col("value")))


SCORES = f"""WITH {S.ENTITIES}, raw AS (SELECT category AS dataset, (['plain', 'loop', 'permuted', 'full'])[(user_id % 4 + 1)::INT] AS arm, 'v' || (prop::INT % 5) AS variant, (41 + (user_id // 4) % 5)::INT AS seed, value FROM e0),
sc AS MATERIALIZED (SELECT dataset, arm, variant, seed, CASE WHEN seed = 45 AND variant = 'v4' THEN -1.0 ELSE floor(sum(round_even(value * 1e4, 0)) / count(*) / 100) / 1e4 END AS value FROM raw GROUP BY 1, 2, 3, 4),
ok AS MATERIALIZED (SELECT * FROM sc WHERE value >= 0),
bs AS MATERIALIZED (SELECT dataset, arm, seed, avg(value) AS value FROM ok GROUP BY 1, 2, 3)"""


def by_seed(spark, sf):
    """One score for each dataset, arm and seed."""
    return compare.clean(scores(spark, sf)).groupBy("dataset", "arm", "seed").agg(F.avg("value").alias("value"))


@query(f"{SCORES} SELECT dataset, arm, variant, seed, round(value, 6) AS value FROM ok")
def w6_clean_scores(spark, sf):
    return compare.clean(scores(spark, sf)).select("dataset", "arm", "variant", "seed", F.round("value", 6).alias("value"))


PRED = f"""{S.ENT}, pr AS (SELECT split, label, CASE WHEN via_user::INT % 3 = 0 THEN 1 ELSE 0 END AS prediction FROM ent)"""


def _metrics(source: str) -> str:
    return f"""k AS (SELECT split, y, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(n_said, 0) AS n_said FROM (SELECT split, label AS y, count(*) AS n_true, count(*) FILTER (label = prediction) AS tp FROM {source} GROUP BY 1, 2)
  FULL JOIN (SELECT split, prediction AS y, count(*) AS n_said FROM {source} GROUP BY 1, 2) USING (split, y)),
f AS (SELECT *, coalesce(2.0 * tp / nullif(n_said + n_true, 0), 0) AS f1 FROM k)
SELECT split, sum(n_true)::BIGINT AS n, round(sum(tp) / sum(n_true), 6) AS accuracy, round(sum(f1) / 2, 6) AS macro_f1, round(sum(f1 * n_true) / sum(n_true), 6) AS weighted_f1,
  round(arg_min(f1, n_true * 10 + y) FILTER (n_true > 0), 6) AS minority_f1, round(arg_min(tp / n_true, n_true * 10 + y) FILTER (n_true > 0), 6) AS minority_recall FROM f GROUP BY split"""


@query(f"WITH {PRED}, {_metrics('pr')}")
def a12_metrics(spark, sf):
    t = split_events(spark, sf).withColumn("prediction", F.when(F.col("via_user").cast("int") % 3 == 0, 1).otherwise(0))
    return compare.metrics(t, ["split"], 2)


@query(f"WITH {S.ENT}, pr AS (SELECT split, label, 0 AS prediction FROM ent), {_metrics('pr')}")
def a13_majority_line(spark, sf):
    return compare.metrics(split_events(spark, sf).withColumn("prediction", F.lit(0)), ["split"], 2)


@query(
    f"{SCORES} SELECT dataset, arm, variant, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value), "
    "6) AS std_sample, count(*) AS n, string_agg(printf('%.4f', value), ',' ORDER BY value) AS values_sorted FROM ok GROUP BY 1, 2, 3"
)
def a23_seed_summary(spark, sf):
    return compare.seed_summary(scores(spark, sf), ["dataset", "arm", "variant"])


PAIRS = (
    f"{SCORES}, pa AS MATERIALIZED (SELECT x.dataset, x.seed, x.value AS x, y.value AS y, x.value - y.value AS d FROM bs x "
    "JOIN bs y USING (dataset, seed) WHERE x.arm = 'full' AND y.arm = 'plain' AND (SELECT count(*) FROM bs b "
    "WHERE b.dataset = x.dataset AND b.arm = 'full') = (SELECT count(*) FROM bs b WHERE b.dataset = x.dataset AND b.arm = 'plain'))"
)


@query(f"{PAIRS} SELECT dataset, seed, round(d, 6) AS d FROM pa")
def j16_paired_scores(spark, sf):
    return compare.paired(by_seed(spark, sf), "full", "plain").select("dataset", "seed", F.round("d", 6).alias("d"))


@query(
    f"{PAIRS} SELECT dataset, count(*) AS n_seeds, round(avg(d), 6) AS mean_diff, round(greatest(avg((d > 0)::INT), avg((d < 0)::INT)), "
    "6) AS sign_consistency FROM pa GROUP BY 1"
)
def m9_sign_consistency(spark, sf):
    return compare.sign_summary(compare.paired(by_seed(spark, sf), "full", "plain"))


def _boot(other: str) -> str:
    h = lambda s: f"(('0x' || substr(md5(concat_ws('|', '3:{s}', dataset, r, i)), 1, 8))::BIGINT % n + 1)"
    return f"""{PAIRS}, l AS (SELECT dataset, list(x ORDER BY seed) AS vx, list(y ORDER BY seed) AS vy, count(*) AS n FROM pa GROUP BY 1),
t AS (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, unnest(range(0, {RESAMPLES})) AS r FROM l)), m AS (SELECT dataset, r, sum(vx[{h('a')}] - vy[{h(other)}]) / n AS m FROM t GROUP BY dataset, r, n),
q AS (SELECT dataset, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1) SELECT dataset, low, high, low <= 0 AND high >= 0 AS includes_zero FROM q"""


@query(_boot("a"))
def m6_paired_bootstrap(spark, sf):
    return compare.bootstrap(compare.paired(by_seed(spark, sf), "full", "plain"), RESAMPLES, 3)


@query(_boot("b"))
def m7_unpaired_bootstrap(spark, sf):
    return compare.bootstrap(compare.paired(by_seed(spark, sf), "full", "plain"), RESAMPLES, 3, independent=True)


def _interval() -> str:
    """Whole sums of drawn scores, as in the query."""
    of = dict(zip(("plain", "loop", "permuted", "full"), ("p", "l", "m", "f"), strict=True))
    lists = ", ".join(f"list(whole ORDER BY seed, variant, whole) FILTER (arm = '{a}') AS v{c}" for a, c in of.items())
    total = lambda c: (
        f"list_sum(list_transform(range(0, len(v{c})), lambda i: v{c}[(('0x' || substr(md5(concat_ws('|', '5:{'permuted' if c == 'm' else 'arms'}', "
        f"dataset, r, i)), 1, 8))::BIGINT % len(v{c}) + 1)::BIGINT]))::DOUBLE AS s{c}, len(v{c})::DOUBLE AS k{c}"
    )
    over = lambda a, b: f"(s{a} * k{b} - s{b} * k{a})"
    under = lambda a, b: f"(k{a} * k{b})"
    terms = {"architecture": ("l", "p"), "availability": ("m", "l"), "value_semantics": ("f", "m")}
    values = ", ".join((
        f"{over(*x)} / ({under(*x)} * 1000000) AS {n}, CASE WHEN {over('f', 'p')} <> 0 THEN {over(*x)} * {under('f', 'p')} / ({under(*x)} * "
        f"{over('f', 'p')}) END AS {n}_share"
    ) for n, x in terms.items())
    ends = []
    for n in terms:
        for end, q in (("low", 0.025), ("high", 0.975)):
            ends.append(f"round(quantile_cont({n}, {q}), 6) AS {n}_{end}")
            name = end if n == "value_semantics" else f"{n}_share_{end}"
            ends.append(f"round(CASE WHEN count({n}_share) >= 100 THEN quantile_cont({n}_share, {q}) END, 6) AS {name}")
    return f"""{SCORES}, wh AS (SELECT dataset, arm, seed, variant, round_even(value * 1000000, 0)::BIGINT AS whole FROM ok), ls AS MATERIALIZED (SELECT dataset, {lists} FROM wh GROUP BY 1),
dr AS (SELECT *, unnest(range(0, {RESAMPLES})) AS r FROM ls), dt AS (SELECT dataset, {", ".join(total(c) for c in of.values())} FROM dr), dv AS (SELECT dataset, {values} FROM dt)
SELECT dataset, count(value_semantics_share) AS usable, {", ".join(ends)} FROM dv GROUP BY 1"""


@query(_interval())
def m8_decomposition_interval(spark, sf):
    return compare.decomposition_interval(scores(spark, sf), *ARMS, RESAMPLES, 5)


@query(f"{SCORES} SELECT dataset, variant, round(avg(value), 6) AS value FROM ok WHERE arm = 'permuted' GROUP BY 1, 2 HAVING count(*) = 5")
def m10_permutation_observation(spark, sf):
    return compare.permutation_observation(scores(spark, sf), "permuted")


PIVOT = (
    "p AS (SELECT dataset{v}, avg(value) FILTER (arm = 'plain') AS pl, avg(value) FILTER (arm = 'loop') AS lo, "
    "avg(value) FILTER (arm = 'permuted') AS pe, avg(value) FILTER (arm = 'full') AS fu FROM ok GROUP BY ALL)"
)


def _decomposed() -> str:
    sums = ", ".join(f"sum(round_even(value * 1000000, 0)::BIGINT) FILTER (arm = '{a}')::DOUBLE AS s{a}, count(*) FILTER (arm = '{a}')::DOUBLE AS k{a}" for a in ARMS)
    over = lambda a, b: f"(s{a} * k{b} - s{b} * k{a})"
    under = lambda a, b: f"(k{a} * k{b})"
    mean = lambda a, b: f"round({over(a, b)} / nullif({under(a, b)} * 1000000, 0), 6)"
    share = lambda a, b: f"round({over(a, b)} * {under('full', 'plain')} / nullif({under(a, b)} * {over('full', 'plain')}, 0), 6)"
    out = [f"{mean('full', 'plain')} AS margin"]
    for n, x in compare.TERMS.items():
        out += [f"{mean(*x)} AS {n}", f"{share(*x)} AS {n}_share"]
    return f"{SCORES}, de AS (SELECT dataset, {sums} FROM ok GROUP BY 1) SELECT dataset, {', '.join(out)} FROM de"


@query(_decomposed())
def a29_decomposition(spark, sf):
    return compare.decomposition(scores(spark, sf), *ARMS)


@query(
    f"{SCORES}, m AS (SELECT dataset, variant, avg(value) AS m FROM ok WHERE arm = 'permuted' "
    "GROUP BY 1, 2), a AS (SELECT dataset, stddev_pop(m) AS sp FROM m GROUP BY 1), b AS (SELECT dataset, stddev_pop(value) AS sa FROM ok "
    "WHERE arm = 'full' GROUP BY 1) SELECT dataset, round(sp + sa, 6) AS threshold FROM a JOIN b USING (dataset)"
)
def a30_noise_threshold(spark, sf):
    return compare.noise_threshold(scores(spark, sf), "full", "permuted")


@query(
    f"{SCORES}, {PIVOT.format(v=', variant')}, s AS (SELECT dataset, (fu - pe) / (fu - pl) AS s FROM p WHERE fu - pl > 0) "
    "SELECT dataset, count(*) AS n_variants, round(min(s), 6) AS min_share, round(max(s), 6) AS max_share, round(avg(s), 6) AS mean_share, "
    "round(stddev_pop(s), 6) AS std_share FROM s GROUP BY 1"
)
def a31_share_range(spark, sf):
    return compare.share_range(scores(spark, sf), "plain", "permuted", "full")


def ranks(spark, sf):
    return compare.clean(scores(spark, sf)).groupBy("dataset", "variant", F.col("arm").alias("item")).agg(F.round(F.avg("value"), 2).alias("score"))


RANKS = f"{SCORES}, rk AS MATERIALIZED (SELECT dataset, variant, arm AS item, round(avg(value), 2) AS score FROM ok GROUP BY 1, 2, 3)"
TAU = """sg AS (SELECT a.dataset, a.variant, a.item AS i, b.item AS j, sign(a.score - b.score) AS s FROM rk a JOIN rk b ON a.dataset = b.dataset AND a.variant = b.variant AND a.item < b.item),
ta AS MATERIALIZED (SELECT x.dataset, x.variant AS a, y.variant AS b, round(avg(x.s * y.s), 6) AS tau FROM sg x JOIN sg y ON x.dataset = y.dataset AND x.i = y.i AND x.j = y.j AND x.variant < y.variant GROUP BY 1, 2, 3)"""


@query(f"{RANKS}, {TAU} SELECT * FROM ta")
def m11_kendall_tau(spark, sf):
    return compare.tau(ranks(spark, sf))


@query(
    f"{RANKS}, {TAU}, tp AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY dataset, variant) AS best FROM rk) "
    "WHERE score = best), ld AS (SELECT dataset, variant, count(*) AS k FROM tp GROUP BY 1, 2) "
    "SELECT dataset, n_pairs, mean_tau, ever_top, unique_top, tied FROM (SELECT dataset, count(*) AS n_pairs, round(avg(tau), 6) AS mean_tau "
    "FROM ta GROUP BY 1) JOIN (SELECT dataset, count(DISTINCT item) AS ever_top FROM tp GROUP BY 1) USING (dataset) "
    "JOIN (SELECT dataset, count(*) FILTER (k = 1) AS unique_top, count(*) FILTER (k > 1) AS tied FROM ld GROUP BY 1) USING (dataset)"
)
def m12_ranking_agreement(spark, sf):
    return compare.ranking_agreement(ranks(spark, sf))


@query(f"""{RANKS}, ar AS (SELECT dataset, variant, item, rank() OVER (PARTITION BY dataset, variant ORDER BY score) + (count(*) OVER (PARTITION BY dataset, variant, score) - 1) / 2.0 AS r FROM rk),
cg AS (SELECT dataset, CASE WHEN variant IN ('v0', 'v1') THEN 'early' ELSE 'late' END AS g, item, avg(r) AS score FROM ar GROUP BY 1, 2, 3),
sg AS (SELECT a.dataset, a.g, a.item AS i, b.item AS j, sign(a.score - b.score) AS s FROM cg a JOIN cg b ON a.dataset = b.dataset AND a.g = b.g AND a.item < b.item)
SELECT x.dataset, x.g AS a, y.g AS b, round(avg(x.s * y.s), 6) AS tau FROM sg x JOIN sg y ON x.dataset = y.dataset AND x.i = y.i AND x.j = y.j AND x.g < y.g GROUP BY 1, 2, 3""")
def m12_consensus_tau(spark, sf):
    t = ranks(spark, sf).withColumn("grp", F.when(F.col("variant").isin("v0", "v1"), "early").otherwise("late"))
    return compare.consensus_tau(t, "grp")


def diagnostics(spark, sf):
    """Spread and mean of each variant."""
    t = compare.clean(scores(spark, sf))
    return t.groupBy("dataset", "variant").agg(F.round(F.stddev_pop("value"), 6).alias("x"), F.round(F.avg("value"), 6).alias("y"))


@query(f"""{SCORES}, dg AS (SELECT dataset, variant, round(stddev_pop(value), 6) AS x, round(avg(value), 6) AS y FROM ok GROUP BY 1, 2),
rr AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY x) + (count(*) OVER (PARTITION BY dataset, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dataset ORDER BY y) + (count(*) OVER (PARTITION BY dataset, y) - 1) / 2.0 AS ry FROM dg)
SELECT dataset, round(corr(rx, ry), 6) AS rho FROM rr GROUP BY 1""")
def m14_diagnostic_correlation(spark, sf):
    return compare.spearman(diagnostics(spark, sf), ["dataset"], "x", "y")


def permuted(points: str, ranked: bool, draws: int = 100_000) -> str:
    """SQL of a permutation test over (dataset, x, y): all orders up to eight points, else drawn ones."""
    rank = lambda c: f"(rank() OVER (PARTITION BY dataset ORDER BY {c}) + (count(*) OVER (PARTITION BY dataset, {c}) - 1) / 2.0)"
    x, y = (rank("x"), rank("y")) if ranked else ("x", "y")
    unit = lambda c: f"CASE WHEN sqrt(sum(pow({c} - m{c}, 2)) OVER d) > 0 THEN ({c} - m{c}) / sqrt(sum(pow({c} - m{c}, 2)) OVER d) ELSE 0 END"
    return f"""p0 AS ({points}), p1 AS (SELECT dataset, x AS x0, y AS y0, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM p0), p2 AS (SELECT *, avg(x) OVER (PARTITION BY dataset) AS mx, avg(y) OVER (PARTITION BY dataset) AS my FROM p1),
    p3 AS (SELECT dataset, x0, y0, {unit("x")} AS ux, {unit("y")} AS uy FROM p2 WINDOW d AS (PARTITION BY dataset)),
    li AS MATERIALIZED (SELECT dataset, list(ux ORDER BY x0, y0) AS xs, list(uy ORDER BY x0, y0) AS ys, count(*) AS n FROM p3 GROUP BY 1),
    pr(n, ord) AS (SELECT DISTINCT n, []::BIGINT[] FROM li WHERE n <= 8 UNION ALL SELECT n, list_append(ord, i) FROM pr, (SELECT unnest(range(8)) AS i) t WHERE len(ord) < n AND i < n AND NOT list_contains(ord, i)),
    dr AS (SELECT dataset, k, list(i ORDER BY md5(concat_ws('|', '0', dataset, k, i))) AS ord FROM (SELECT dataset, k, unnest(range(n)) AS i FROM (SELECT dataset, n, unnest(range({draws})) AS k FROM li WHERE n > 8)) GROUP BY 1, 2),
    pa AS (SELECT li.dataset, xs, ys, ord, true AS exact FROM li JOIN pr USING (n) WHERE len(ord) = n UNION ALL SELECT li.dataset, xs, ys, ord, false FROM li JOIN dr USING (dataset)),
    sx AS (SELECT dataset, list_dot_product(xs, ys) AS r, list_dot_product(xs, list_transform(ord, lambda i: ys[i + 1])) AS s, exact FROM pa)
    SELECT dataset, round(any_value(r), 6) AS r, round(count(*) FILTER (abs(s) >= abs(r) - 1e-12) / count(*), 6) AS p_value, count(*) AS n_permutations, any_value(exact) AS exact FROM sx GROUP BY 1"""


POINTS = "SELECT dataset, round(stddev_pop(value), 6) AS x, round(avg(value), 6) AS y FROM ok GROUP BY dataset, variant"
RECURSIVE = SCORES.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{RECURSIVE}, {permuted(POINTS, False)}")
def m13_permutation_p(spark, sf):
    return compare.permutation_p(diagnostics(spark, sf))


@query(f"{RECURSIVE}, {permuted(POINTS + ', arm', True)}")
def m13_rank_permutation_p(spark, sf):
    """Of a rank correlation over arms and variants, too many for all orders."""
    t = compare.clean(scores(spark, sf)).groupBy("dataset", "variant", "arm").agg(F.round(F.stddev_pop("value"), 6).alias("x"), F.round(F.avg("value"), 6).alias("y"))
    return compare.permutation_p(t, "spearman")


def configs(spark, sf):
    """A user's arms as a set of relations with two scores."""
    t = events(spark, sf).groupBy(F.col("category").alias("dataset"), "user_id").agg(F.array_distinct(F.array_sort(F.collect_list(F.concat(F.lit("r"), (F.col("prop").cast("int") % 4).cast("string"))))).alias("used"), F.round(F.sum(F.bround(F.col("value") * 1e4, 0)) / F.count(F.lit(1)) / 1e6, 3).alias("val"), F.round(F.max("value") / 100, 3).alias("test"))
    return t


CONFIGS = f"""WITH {S.ENTITIES}, cf AS (SELECT category AS dataset, user_id, list_sort(list_distinct(list('r' || (prop::INT % 4)))) AS used, round(sum(round_even(value * 1e4, 0)) / count(*) / 1e6, 3) AS val, round(max(value) / 100, 3) AS test FROM e0 GROUP BY 1, 2),
ck AS MATERIALIZED (SELECT *, array_to_string(used, '+') AS key, len(used) AS size FROM cf)"""


@query(f"""{CONFIGS}, rz AS (SELECT dataset, key, size, max(val) AS val FROM ck GROUP BY 1, 2, 3), b AS (SELECT *, max(val) OVER (PARTITION BY dataset) AS best, count(*) OVER (PARTITION BY dataset) AS n_realised FROM rz),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY size, val DESC, key) AS k FROM b WHERE val >= best - 0.005)
SELECT dataset, key AS selected, size::INT AS size, val, best AS best_val, n_realised, (SELECT count(*) FROM b WHERE b.dataset = o.dataset AND val = best) AS ties_at_top FROM o WHERE k = 1""")
def k2_selection_rule(spark, sf):
    return compare.select_smallest(configs(spark, sf)).drop("test")


@query(
    f"{CONFIGS} SELECT dataset, size::INT AS size, by_val, by_test, by_val = by_test AS agree FROM (SELECT dataset, size, last(key "
    "ORDER BY val, key) AS by_val, last(key ORDER BY test, key) AS by_test FROM ck GROUP BY 1, 2)"
)
def k3_top_by_size(spark, sf):
    return compare.top_by_size(configs(spark, sf))


@query(f"{CONFIGS} SELECT dataset, size::INT AS size, max(test) AS best FROM ck GROUP BY 1, 2")
def a32_saturation(spark, sf):
    return compare.saturation(configs(spark, sf))


@query(f"{CONFIGS} SELECT DISTINCT dataset, key FROM ck")
def t4_realised_sets(spark, sf):
    return compare.realised_sets(configs(spark, sf))


@query(f"""WITH {S.ENTITIES}, f AS (SELECT category AS claim, round(avg(label), 4) AS value FROM e0 GROUP BY 1)
SELECT c.claim, c.stated, f.value, CASE WHEN f.value IS NULL THEN 'SKIP' WHEN abs(c.stated - f.value) <= c.tolerance THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES ('error', 1.0::DOUBLE, 0.001::DOUBLE), ('click', 0.5, 0.01), ('none', 0.0, 0.1)) c(claim, stated, tolerance) LEFT JOIN f USING (claim)""")
def m22_claim_check(spark, sf):
    claims = spark.createDataFrame([("error", 1.0, 0.001), ("click", 0.5, 0.01), ("none", 0.0, 0.1)], "claim string, stated double, tolerance double")
    found = events(spark, sf).groupBy(F.col("category").alias("claim")).agg(F.round(F.avg("label"), 4).alias("value"))
    return compare.check_claims(claims, found)


def learnable(spark, sf):
    t = split_events(spark, sf, "category", "value", "via_user", "via_prop")
    t = t.repartition(3 * spark.sparkContext.defaultParallelism, "id")  # learners use all cores, however few classes the split was made by
    return features.metadata_columns(t, ["via_user", "via_prop"]).withColumn("row_id", F.col("id").cast("double"))


META = ["via_user_freq", "via_user_size", "via_prop_freq", "via_prop_size"]


@query()
def m24_boosting(spark, sf):
    """Boosting until the held-out loss stops to fall; the iterations used are in every row."""
    p, used = learn.fit(learnable(spark, sf), ["value", *META])
    return compare.metrics(p, ["split"], 2).withColumn("iterations", F.lit(used))


@query()
def m24_boosting_classes(spark, sf):
    """Five classes by one learner for each against the rest."""
    t = learnable(spark, sf)
    code = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("category"))
    p, used = learn.fit(t.withColumn("label", (code - 1).cast("int")), ["value", *META], iterations=40)
    return compare.metrics(p, ["split"], 5).withColumn("iterations", F.lit(used))


@query()
def m25_linear_model(spark, sf):
    p = learn.fit_predict(learnable(spark, sf), ["value", *META], "linear")
    return compare.metrics(p, ["split"], 2)


@query()
def m26_feature_sets(spark, sf):
    return learn.feature_set_comparison(learnable(spark, sf), {"flow_only": ["value"], "meta": META, "flow_and_meta": ["value", *META]}, "linear")


@query()
def m23_index_ablation(spark, sf):
    return learn.index_ablation(learnable(spark, sf), ["value", "row_id", "via_user_size"], ["via_user_size"])


@query()
def m27_relation_sets(spark, sf):
    t = kept(split_events(spark, sf, "value", *RELATIONS))
    n = graph.neighbour_means(t, RELATIONS, ["value"], S.BUDGET, S.SEED)
    return learn.relation_sets(t, n, ["value"], "via_user+via_prop;via_timebin")


__all__ = ["REGISTERED", "RELATIONS"]
