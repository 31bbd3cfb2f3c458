"""Queries of paired tests with p-values and of resampling at full counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import resampling as RS
from .catalog import Tables, query
from .evaluation import J, judged

MASK = "4294967295"


def _mix_sql(x: str) -> str:
    """SQL of the weights' hash of a HUGEINT expression below 2**32."""
    one = f"(xor({x}, {x} >> 16) * {RS.FIRST}) & {MASK}"
    two = f"(xor(({one}), ({one}) >> 15) * {RS.SECOND}) & {MASK}"
    return f"xor(({two}), ({two}) >> 16)"


def _drawn(rows: str, key: str, replicates: int, seed: int) -> str:
    """CTEs: o (key, v, own hash), r (replicate, v, h: the hash of each row in each replicate)."""
    return f"""
        k AS ({rows}), o0 AS (SELECT *, (CAST({key} AS HUGEINT) * {RS.ROW} + {seed}) & {MASK} AS x FROM k), o AS MATERIALIZED (SELECT *, {_mix_sql('x')} AS own FROM o0),
        r0 AS (SELECT o.*, r AS replicate, (own + CAST(r AS HUGEINT) * {RS.REPLICATE}) & {MASK} AS y FROM o, range({replicates}) AS g(r)),
        r AS (SELECT *, {_mix_sql('y')} AS h FROM r0)"""


POISSON = "(" + " + ".join(f"CAST(h >= {x} AS INTEGER)" for x in RS.LIMITS) + ")"
BOTH = "CAST(gold = pred AS INTEGER) - CAST(gold = pred2 AS INTEGER)"
ENDS = "round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high"


def right(column: str):
    return (F.col("gold") == F.col(column)).cast("int")


def ends(means):
    return E.interval(means).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("j2_poisson_bootstrap", f"{J}, {_drawn('SELECT doc_id, CAST(gold = pred AS INTEGER) AS v FROM j', 'doc_id', 5000, 42)}, m AS (SELECT replicate, sum({POISSON} * v) / sum({POISSON}) AS mean FROM r GROUP BY replicate) SELECT {ENDS} FROM m")
def _(t: Tables):
    return ends(RS.bootstrap(judged(t), "doc_id", right("pred"), 5000))


@query("j3_poisson_delta", f"{J}, {_drawn(f'SELECT doc_id, {BOTH} AS v FROM j', 'doc_id', 5000, 43)}, m AS (SELECT replicate, sum({POISSON} * v) / sum({POISSON}) AS mean FROM r GROUP BY replicate) SELECT {ENDS} FROM m")
def _(t: Tables):
    return ends(RS.bootstrap(judged(t), "doc_id", right("pred") - right("pred2"), 5000, 43))


@query(
    "j4_sign_flips",
    f"""{J}, {_drawn(f'SELECT doc_id, {BOTH} AS v FROM j', 'doc_id', 10000, 44)}, s AS (SELECT count(*) AS n, sum(v) AS total FROM k), m AS (SELECT replicate, sum(CASE WHEN h >= 2147483648 THEN v ELSE -v END) AS f FROM r GROUP BY replicate)
    SELECT n, round(total / n, 6) AS observed, round((count(*) FILTER (WHERE abs(f) >= abs(total)) + 1) / 10001, 6) AS p FROM m, s GROUP BY n, total""",
)
def _(t: Tables):
    f = RS.sign_flips(judged(t), "doc_id", right("pred") - right("pred2"), 10_000, 44)
    return f.select("n", F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"))


@query(
    "j10_poisson_clusters",
    f"""WITH {_drawn("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM lineitem GROUP BY 1", 'l_suppkey', 10000, 45)},
    m AS (SELECT replicate, sum({POISSON} * s) / sum({POISSON} * n) AS mean FROM r GROUP BY replicate) SELECT {ENDS} FROM m""",
)
def _(t: Tables):
    return ends(RS.clustered(t.lineitem, "l_suppkey", (F.col("l_returnflag") == "R").cast("int"), 10_000, 45))


#: Discounts against taxes, in whole percent.
SHIFT = "round(l_discount * 100) - round(l_tax * 100)"
#: The complementary error function of x = |z| / sqrt(2), as a series or a continued fraction.
TAIL = """
    sr AS (SELECT 1 AS k, x AS t, x AS s, x FROM z UNION ALL SELECT k + 1, -t * x * x / k, s - t * x * x / k / (2 * k + 1), x FROM sr WHERE k <= 80),
    fr AS (SELECT 80 AS k, x AS f, x FROM z UNION ALL SELECT k - 1, x + k / 2.0 / f, x FROM fr WHERE k >= 1),
    p AS (SELECT CASE WHEN x < 2.5 THEN (SELECT 1 - 2 / sqrt(pi()) * s FROM sr WHERE k = 81) ELSE (SELECT exp(-x * x) / (sqrt(pi()) * f) FROM fr WHERE k = 0) END AS p FROM z)
"""


@query(
    "j7_mcnemar_test",
    f"""WITH RECURSIVE {J.removeprefix('WITH ')}, c AS (SELECT count(*) FILTER (WHERE gold = pred AND gold <> pred2) AS b, count(*) FILTER (WHERE gold <> pred AND gold = pred2) AS c FROM j),
    n AS (SELECT *, b + c AS n, CASE WHEN b + c = 0 THEN 0.0 ELSE round(pow(greatest(abs(b - c) - 1, 0), 2) / (b + c), 6) END AS chi2 FROM c), z AS (SELECT sqrt(chi2) / sqrt(2) AS x FROM n), {TAIL},
    e AS (SELECT least(1.0, 2 * sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0))) * pow(0.5, any_value(n))) AS p FROM n, range(1000) AS g(i) WHERE i <= least(b, c) AND n < 25)
    SELECT b, c, n, CASE WHEN n < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE chi2 END AS statistic, round(CASE WHEN n = 0 THEN 1.0 WHEN n < 25 THEN (SELECT p FROM e) ELSE (SELECT p FROM p) END, 6) AS p,
           CASE WHEN n < 25 THEN 'binomial_exact' ELSE 'chi_square_continuity' END AS method FROM n""",
)
def _(t: Tables):
    m = E.mcnemar_test(judged(t), F.col("gold") == F.col("pred"), F.col("gold") == F.col("pred2"))
    return m.withColumn("p", F.round("p", 6))


@query(
    "j8_paired_t_test",
    f"""WITH RECURSIVE {J.removeprefix('WITH ')}, d AS (SELECT {BOTH} AS d FROM j), s AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d), q AS (SELECT *, mean / (sd / sqrt(n)) AS t, n - 1.0 AS df FROM s),
    v0 AS (SELECT df / 2 AS a, 0.5 AS b, df / (df + t * t) AS x FROM q),
    v AS (SELECT CASE WHEN low THEN a ELSE b END AS a, CASE WHEN low THEN b ELSE a END AS b, CASE WHEN low THEN x ELSE 1 - x END AS x, low FROM (SELECT *, x < (a + 1) / (a + b + 2) AS low FROM v0)),
    f AS (SELECT 0 AS i, CAST(1.0 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM v
          UNION ALL SELECT i + 1, 1 + w / c, 1 / (1 + w * d), h * (1 + w / c) / (1 + w * d)
          FROM (SELECT f.*, CASE WHEN i % 2 = 0 THEN (i // 2 + 1) * (b - (i // 2 + 1)) * x / ((a + 2 * (i // 2 + 1) - 1) * (a + 2 * (i // 2 + 1)))
                                 ELSE -(a + (i + 1) // 2) * (a + b + (i + 1) // 2) * x / ((a + (i + 1)) * (a + (i + 1) + 1)) END AS w FROM f, v) WHERE i < 2000),
    p0 AS (SELECT exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a AS p, low FROM v, f WHERE i = 2000)
    SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, round(CASE WHEN low THEN p ELSE 1 - p END, 6) AS p, round(mean - 1.96 * sd / sqrt(n), 6) AS low, round(mean + 1.96 * sd / sqrt(n), 6) AS high FROM q, p0""",
)
def _(t: Tables):
    found = E.paired_t_test(judged(t), right("pred") - right("pred2"))
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "t", "p", "low", "high")))


@query(
    "j9_wilcoxon_test",
    f"""WITH RECURSIVE d AS (SELECT {SHIFT} AS d FROM lineitem), nz AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0), r AS (SELECT d, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM nz),
    s AS (SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w_plus, sum(r) FILTER (WHERE d < 0) AS w_minus FROM r), g AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM nz GROUP BY a)),
    z AS (SELECT abs(least(w_plus, w_minus) - n * (n + 1.0) / 4) / sqrt((n * (n + 1.0) * (2.0 * n + 1) - ties / 2) / 24) / sqrt(2) AS x FROM s, g), {TAIL}
    SELECT n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(least(w_plus, w_minus), 6) AS statistic, round(p, 6) AS p, 'normal' AS method FROM s, p""",
)
def _(t: Tables):
    found = E.signed_rank_test(t.lineitem, F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100))
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "statistic", "p")), "method")


#: Balances of each nation's customers with even keys against those with odd keys: few differences, and untied.
@query(
    "j9_wilcoxon_exact",
    """WITH RECURSIVE b AS (SELECT n_nationkey AS k, sum(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) - sum(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS r FROM b WHERE d <> 0), s AS (SELECT count(*) AS n, CAST(coalesce(sum(r) FILTER (WHERE d > 0), 0) AS BIGINT) AS w_plus, CAST(coalesce(sum(r) FILTER (WHERE d < 0), 0) AS BIGINT) AS w_minus FROM r),
    c AS (SELECT 0 AS k, [CAST(i = 0 AS INTEGER)::DOUBLE FOR i IN range(1276)] AS c UNION ALL SELECT k + 1, [c[i + 1] + CASE WHEN i >= k + 1 THEN c[i - k] ELSE 0 END FOR i IN range(1276)] FROM c, s WHERE k < n)
    SELECT n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, CAST(least(w_plus, w_minus) AS DOUBLE) AS statistic, round(least(1.0, 2 * list_sum(c[1:least(w_plus, w_minus) + 1]) * pow(0.5, n)), 6) AS p, 'exact' AS method FROM s, c WHERE k = n""",
)
def _(t: Tables):
    odd = F.col("c_custkey") % 2
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.sum(F.when(odd == 0, F.col("c_acctbal"))).alias("a"), F.sum(F.when(odd == 1, F.col("c_acctbal"))).alias("b"))
    found = E.signed_rank_test(d, F.col("a") - F.col("b"))
    return found.withColumn("p", F.round("p", 6))
