"""Queries of agreement between coders, over every two coders of a paper and all axes, and what their labels change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import expr as X
from loomspark.functions.text import folded
from loomspark.operators import stats
from loomspark.plans.catalog import FACT, FUNCS, LANGS, _lgc, _list, fact, query
from loomspark.session import table

#: The axes in order, and of which pairs of answers each is asked.
AXES = {"include": "all", "lang_group": "in", "func": "in", "meth": "in", "tool": "in", "learner": "korean", "reason": "out"}
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", ""), "".join(map(chr, range(0x21, 0x7F))).replace("'", "")


def folded_sql(c: str) -> str:
    """Folding as SQL: full-width ASCII, canonical composition, white space at the ends."""
    return rf"coalesce(regexp_replace(translate(nfc_normalize({c}), '{_FULL}', '{_HALF}'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"


_WHERE = {"all": "true", "in": "ai = 'Y' AND bi = 'Y'", "korean": "ai = 'Y' AND bi = 'Y' AND a.lang_group = '한국어' AND b.lang_group = '한국어'", "out": "ai = 'N' AND bi = 'N'"}
CODED = f"""clean AS (SELECT id, coder, coded_at, upper(left({folded_sql('include')}, 1)) AS include, {', '.join(f"{folded_sql(a)} AS {a}" for a in AXES if a != 'include')} FROM codings WHERE id IS NOT NULL AND coder IS NOT NULL),
last AS (SELECT id, coder, arg_max({{{', '.join(f"'{a}': {a}" for a in AXES)}}}, coded_at) AS r FROM clean WHERE include <> '' GROUP BY 1, 2),
pair AS (SELECT x.id, x.coder AS coder_a, y.coder AS coder_b, x.r AS a, y.r AS b, x.r.include AS ai, y.r.include AS bi FROM last x JOIN last y ON x.id = y.id AND x.coder < y.coder),
long AS ({' UNION ALL '.join(f"SELECT id, coder_a, coder_b, '{n}' AS axis, a.{n} AS a, b.{n} AS b FROM pair WHERE {_WHERE[w]}" for n, w in AXES.items())})"""


def last_answers(spark, d) -> DataFrame:
    """(id, coder, r STRUCT of all axes): the latest answer of each coder to each paper; without include it is none."""
    c = table(spark, d, "codings").where("id is not null and coder is not null")
    clean = c.select("id", "coder", "coded_at", F.upper(F.substring(F.coalesce(folded("include"), F.lit("")), 1, 1)).alias("include"), *(F.coalesce(folded(a), F.lit("")).alias(a) for a in AXES if a != "include"))
    return clean.where("include <> ''").groupBy("id", "coder").agg(F.max_by(F.struct(*AXES), "coded_at").alias("r"))


def coder_pairs(spark, d) -> DataFrame:
    """(id, coder_a, coder_b, axis, a, b) of every two coders of a paper, the lesser name first, on every axis that their
    answers on inclusion open. A paper has few coders, so their answers are one array and no join is made."""
    papers = last_answers(spark, d).groupBy("id").agg(F.collect_list(F.struct("coder", "r")).alias("all"))
    one = papers.select("id", "all", F.explode("all").alias("x"))
    two = one.select("id", "x", F.explode(F.filter("all", lambda y: y["coder"] > F.col("x.coder"))).alias("y"))
    pair = two.select("id", F.col("x.coder").alias("coder_a"), F.col("y.coder").alias("coder_b"), F.col("x.r").alias("a"), F.col("y.r").alias("b"))
    both = lambda c, v: (F.col(f"a.{c}") == v) & (F.col(f"b.{c}") == v)
    when = {"all": F.lit(True), "in": both("include", "Y"), "korean": both("include", "Y") & both("lang_group", "한국어"), "out": both("include", "N")}
    axes = [F.when(when[w], F.struct(F.lit(n).alias("axis"), F.col(f"a.{n}").alias("a"), F.col(f"b.{n}").alias("b"))) for n, w in AXES.items()]
    return pair.select("id", "coder_a", "coder_b", F.explode(F.array_compact(F.array(*axes))).alias("x")).select("id", "coder_a", "coder_b", "x.*")


@query(f"""WITH {CODED}, n AS (SELECT axis, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM long GROUP BY axis), x AS (SELECT axis, a AS v, count(*) AS x FROM long GROUP BY 1, 2), y AS (SELECT axis, b AS v, count(*) AS y FROM long GROUP BY 1, 2), e AS (SELECT axis, sum(x * y) AS xy FROM x JOIN y USING (axis, v) GROUP BY axis), k AS (SELECT n.axis, n, po, coalesce(xy, 0) / (n * n) AS pe FROM n LEFT JOIN e USING (axis)), f AS (SELECT axis, n, po, pe, CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM k)
SELECT axis, n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa, CASE WHEN kappa > 0.8 THEN 'almost perfect' WHEN kappa > 0.6 THEN 'substantial' WHEN kappa > 0.4 THEN 'moderate' WHEN kappa > 0.2 THEN 'fair' ELSE 'slight' END AS band FROM f""")
def kappa_axes(spark, d):
    """Kappa on all seven axes, pooled over every two coders of a paper."""
    k = stats.kappa(coder_pairs(spark, d), ["axis"], "a", "b")
    return k.select("axis", "n", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")), stats.landis_koch(F.col("kappa")).alias("band"))


@query(f"""WITH {CODED} SELECT axis, id, coder_a, coder_b, a, b FROM long WHERE a <> b""")
def disagreements(spark, d):
    """Every disagreement of every two coders of a paper, on all seven axes."""
    return coder_pairs(spark, d).where("a <> b").select("axis", "id", "coder_a", "coder_b", "a", "b")


@query(f"""WITH {CODED} SELECT CASE WHEN ai = 'Y' THEN coalesce(nullif(a.lang_group, ''), '(none)') ELSE '(excluded)' END AS lang, count(*) AS n, count(*) FILTER (WHERE ai = bi) AS same FROM pair GROUP BY 1""")
def agreement_by_group(spark, d):
    """How often the second coder of a pair agrees on inclusion, by the language that the first coder gives the paper;
    papers that the first coder excludes are a group of their own."""
    p = coder_pairs(spark, d).where("axis = 'include'")
    first = last_answers(spark, d).select("id", F.col("coder").alias("coder_a"), F.col("r.lang_group").alias("lang"))
    lang = F.when(F.col("a") == "Y", F.coalesce(X.blank_to_null(F.col("lang")), F.lit("(none)"))).otherwise("(excluded)")
    return p.join(first, ["id", "coder_a"]).groupBy(lang.alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def _tail(side: str, k: str, n: str) -> str:
    """P value of k of n drawn, against big_k of big_n, on the side of the observation, as SQL over a range of terms."""
    term = f"exp({_lgc('big_k', 'i')} + {_lgc('(big_n - big_k)', f'({n} - i)')} - {_lgc('big_n', n)})"
    lo, hi = f"greatest(0, {n} + big_k - big_n)", f"least(big_k, {n})"
    total = lambda a, b: f"coalesce(list_sum(list_transform(range({a}, {b} + 1), lambda i: {term})), 0)"
    return f"least(1, CASE WHEN {k} < {n} * big_k / big_n THEN {total(lo, f'least({k}, {hi})')} ELSE {total(f'greatest({k}, {lo})', hi)} END) AS {side}"


@query(f"""WITH {FACT}, {CODED}, grid AS (SELECT lang, func FROM fact WHERE include = 'Y' AND func IN ({_list(FUNCS)}) AND lang IN ({_list(LANGS)})),
one AS (SELECT id, arg_max(r, coder) AS r FROM last GROUP BY id), other AS (SELECT r.func AS func FROM one WHERE r.include = 'Y' AND r.lang_group = '중국어' AND r.func IN ({_list(FUNCS)})),
f AS (SELECT unnest([{_list(FUNCS)}]) AS func), c AS (SELECT f.func, (SELECT count(*) FROM grid g WHERE g.func = f.func AND lang = '중국어') AS k_c, (SELECT count(*) FROM other o WHERE o.func = f.func) AS k_a, (SELECT count(*) FROM grid g WHERE g.func = f.func AND lang <> '중국어') AS big_k, (SELECT count(*) FROM grid WHERE lang = '중국어') AS n_c, (SELECT count(*) FROM other) AS n_a, (SELECT count(*) FROM grid WHERE lang <> '중국어') AS big_n FROM f),
p AS (SELECT *, {_tail('p_c', 'k_c', 'n_c')}, {_tail('p_a', 'k_a', 'n_a')} FROM c)
SELECT func, k_c, n_c, k_a, n_a, big_k, big_n, round(p_c, 6) AS p_c, round(p_a, 6) AS p_a, CASE WHEN k_c < n_c * big_k / big_n THEN 'under' ELSE 'over' END AS side_c, CASE WHEN k_a < n_a * big_k / big_n THEN 'under' ELSE 'over' END AS side_a,
CASE WHEN p_c < 0.05 / {len(FUNCS)} AND p_a < 0.05 / {len(FUNCS)} THEN 'kept' WHEN p_c < 0.05 / {len(FUNCS)} THEN 'lost' WHEN p_a < 0.05 / {len(FUNCS)} THEN 'gained' ELSE '' END AS finding FROM p WHERE n_c <= big_n AND n_a <= big_n""")
def substitution_sensitivity(spark, d):
    """The functions of the small language group against the two large ones, once with the confirmed labels and once with
    the group's labels taken from coders (of a paper the one with the greatest name): which findings at the Bonferroni
    level are kept, lost and gained."""
    grid = fact(spark, d, "include", "lang", "func").where((F.col("include") == "Y") & F.col("func").isin(*FUNCS) & F.col("lang").isin(*LANGS))
    small = F.col("lang") == "중국어"
    own = grid.groupBy("func").agg(F.count_if(small).alias("k_c"), F.count_if(~small).alias("big_k"))
    one = last_answers(spark, d).groupBy("id").agg(F.max_by("r", "coder").alias("r")).where((F.col("r.include") == "Y") & (F.col("r.lang_group") == "중국어") & F.col("r.func").isin(*FUNCS))
    other = one.groupBy(F.col("r.func").alias("func")).agg(F.count("*").alias("k_a"))
    every = spark.createDataFrame([(f,) for f in FUNCS], "func string")
    t = every.join(own, "func", "left").join(other, "func", "left").na.fill(0)
    total = t.agg(F.sum("k_c").alias("n_c"), F.sum("k_a").alias("n_a"), F.sum("big_k").alias("big_n"))
    t = t.crossJoin(F.broadcast(total)).where("n_c <= big_n and n_a <= big_n")  # one row of totals
    for s in ("c", "a"):
        t = stats.hypergeometric_tails(t, "big_k", "big_n", f"n_{s}", f"k_{s}")
        t = t.withColumn(f"side_{s}", F.when(F.col(f"k_{s}") < F.col("expected"), "under").otherwise("over")).withColumnRenamed("p_side", f"p_{s}").drop("p_le", "p_ge", "expected")
    level = 0.05 / len(FUNCS)
    c, a = F.col("p_c") < level, F.col("p_a") < level
    finding = F.when(c & a, "kept").when(c, "lost").when(a, "gained").otherwise("")
    return t.select("func", "k_c", "n_c", "k_a", "n_a", "big_k", "big_n", F.round("p_c", 6).alias("p_c"), F.round("p_a", 6).alias("p_a"), "side_c", "side_a", finding.alias("finding"))
