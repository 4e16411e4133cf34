"""Queries of resampling at full size: thousands of draws of a group's rows, each drawn by number and not by shuffling the
whole group, and the place of the small group among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import graph, ranking, sampling, stats
from loomspark.plans.catalog import _AUTHORS, _authors, FACT, FUNCS, LANGS, METHS, MODULES, CONCEPTS, _keywords, _KW, _CASE, _list, fact, query

# Draws and papers a draw of the three analyses, their seed, and the cluster size asked about.
CELL_DRAWS, CELL_PAPERS, DRAWS, PAPERS, SEED, LARGE = 10_000, 48, 2_000, 68, 20260930, 9
# End of fixed values.

#: CTEs of the graphs of draws d (g, arti_id, keys): a row per graph with its size, components, largest one and edges.
GRAPHS = """g_nodes AS (SELECT DISTINCT g, unnest(keys) AS node FROM d), g_ends AS (SELECT arti_id, g, unnest(keys) AS node FROM d), g_edges AS (SELECT DISTINCT a.g, a.node AS src, b.node AS dst FROM g_ends a JOIN g_ends b ON a.arti_id = b.arti_id AND a.g = b.g AND a.node < b.node),
g_num AS (SELECT g, node, row_number() OVER (ORDER BY g, node) AS i FROM g_nodes), g_e AS (SELECT a.i AS x, b.i AS y FROM g_edges e JOIN g_num a ON a.g = e.g AND a.node = e.src JOIN g_num b ON b.g = e.g AND b.node = e.dst), g_twice AS (SELECT x, y FROM g_e UNION ALL SELECT y, x FROM g_e),
walk(i, c) USING KEY (i) AS (SELECT i, i FROM g_num UNION SELECT b.y, min(w.c) FROM walk w JOIN g_twice b ON b.x = w.i JOIN recurring.walk r ON r.i = b.y WHERE w.c < r.c GROUP BY b.y),
g_size AS (SELECT g, c, count(*) AS size FROM walk JOIN g_num USING (i) GROUP BY 1, 2), g_comp AS (SELECT g, count(*) AS components, max(size) AS largest, sum(size)::BIGINT AS nodes FROM g_size GROUP BY g),
g_deg AS (SELECT n.g, count(*) FILTER (WHERE t.x IS NULL) AS isolates FROM g_num n LEFT JOIN (SELECT DISTINCT x FROM g_twice) t ON t.x = n.i GROUP BY n.g), g_cnt AS (SELECT g, count(*) AS edges FROM g_edges GROUP BY g),
graphs AS (SELECT split_part(g, '|', 1) AS lang, split_part(g, '|', 2)::INTEGER AS rep, nodes, coalesce(edges, 0) AS edges, components, largest, 100.0 * isolates / nodes AS isolates_pct, 2.0 * coalesce(edges, 0) / nodes AS mean_degree FROM g_comp JOIN g_deg USING (g) LEFT JOIN g_cnt USING (g))"""


def _drawn_sql(pool: str, key: str, n: int, reps: int) -> str:
    """CTE drawn (lang, rep, key): the draws of sampling.rank_draws over a pool (lang, key)."""
    return f"""numbered AS (SELECT lang, {key}, row_number() OVER (PARTITION BY lang ORDER BY {key}) - 1 AS at FROM {pool}),
size AS (SELECT lang, count(*) AS n FROM numbered GROUP BY lang), rep AS (SELECT lang, n, unnest(range(1, {reps} + 1)) AS rep FROM size),
picks AS (SELECT lang, rep, unnest(list_reduce(range(greatest(1, n - {n} + 1), n + 1), lambda s, j: list_append(s, CASE WHEN list_contains(s, ('0x' || substr(md5(concat_ws('|', '{SEED}', lang, rep, j)), 1, 12))::BIGINT % j) THEN j - 1 ELSE ('0x' || substr(md5(concat_ws('|', '{SEED}', lang, rep, j)), 1, 12))::BIGINT % j END), []::BIGINT[])) AS at FROM rep),
drawn AS (SELECT p.lang, p.rep, x.{key} FROM picks p JOIN numbered x ON x.lang = p.lang AND x.at = p.at)"""


_POOL = f"pool AS (SELECT arti_id, lang, func, meth FROM fact WHERE include = 'Y' AND lang IN ({_list(LANGS)}) AND func IN ({_list(FUNCS)}) AND meth IN ({_list(METHS)}))"


@query(f"""WITH {FACT}, {_POOL}, large AS (SELECT * FROM pool WHERE lang <> '중국어'), {_drawn_sql('large', 'arti_id', CELL_PAPERS, CELL_DRAWS)}, c AS (SELECT d.lang, rep, count(DISTINCT (func, meth)) AS cells FROM drawn d JOIN large USING (arti_id) GROUP BY 1, 2), o AS (SELECT count(DISTINCT (func, meth)) AS seen FROM pool WHERE lang = '중국어'), a AS (SELECT lang, list_sort(list(cells)) AS v, count(*) AS n, avg(cells) AS m, stddev_pop(cells) AS sd, 100.0 * avg(CASE WHEN cells <= (SELECT seen FROM o) THEN 1 ELSE 0 END) AS pct FROM c GROUP BY lang)
SELECT lang, n AS draws, round(m, 6) AS mean, round(sd, 6) AS sd, v[floor(n * 0.025)::INT + 1] AS lo, v[(n // 2) + 1] AS median, v[least(n - 1, floor(n * 0.975))::INT + 1] AS hi, (SELECT seen FROM o) AS observed, round(pct, 6) AS percentile FROM a""")
def rarefaction_full(spark, d):
    """Occupied cells of the grid among 48 papers, 10,000 draws of each large language, and the small language's place."""
    pool = fact(spark, d, "include", "lang", "func", "meth").where(F.col("lang").isin(*LANGS) & F.col("func").isin(*FUNCS) & F.col("meth").isin(*METHS) & (F.col("include") == "Y")).drop("include")
    cells = sampling.occupancy(sampling.rank_draws(pool.where("lang <> '중국어'"), "lang", "arti_id", CELL_PAPERS, CELL_DRAWS, SEED), "lang", ["func", "meth"])
    seen = pool.where("lang = '중국어'").agg(F.count_distinct("func", "meth").alias("observed"))
    cells = cells.crossJoin(F.broadcast(seen))  # one row
    place = cells.groupBy("lang").agg(F.first("observed").alias("observed"), F.round(100.0 * F.avg((F.col("cells") <= F.col("observed")).cast("int")), 6).alias("percentile"))
    q = ranking.quantiles(cells, ["lang"], "cells", CELL_DRAWS).select("lang", F.col("n").alias("draws"), "mean", "sd", "lo", "median", "hi")
    return q.join(place, "lang")


_MODULES = ", ".join(f"('{m}', '{c}')" for m, cs in MODULES.items() for c in cs)
_PAPER_MODULES = f"pm AS (SELECT DISTINCT k.arti_id, k.lang, k.pub_year, m.module FROM (SELECT arti_id, lang, pub_year, {_CASE} AS concept FROM kw WHERE pub_year IS NOT NULL) k JOIN (VALUES {_MODULES}) m(module, concept) USING (concept))"


def _paper_modules(spark, d) -> DataFrame:
    """(arti_id, lang, pub_year, modules ARRAY): the modules of a paper's keywords; papers without any have an empty one."""
    from loomspark.functions import expr as X

    of = {c: m for m, cs in MODULES.items() for c in cs}
    module = X.first_match(F.col("kw"), [(of[c], p) for c, p in CONCEPTS], "")
    rows = fact(spark, d, "include", "lang", "pub_year", "kw_ko", "kw_en").where((F.col("include") == "Y") & F.col("lang").isin(*LANGS) & F.col("pub_year").isNotNull())
    words = X.split_keywords(F.col("kw_ko"), F.col("kw_en"))
    label = lambda w: X.first_match(w, [(of[c], p) for c, p in CONCEPTS], "")
    return rows.select("arti_id", "lang", "pub_year", F.array_distinct(F.filter(F.transform(words, label), lambda m: m != "")).alias("modules"))


@query(f"""WITH {FACT}, {_KW}, {_PAPER_MODULES}, pool AS (SELECT arti_id, lang FROM fact WHERE include = 'Y' AND lang IN ('영어', '한국어') AND pub_year IS NOT NULL), {_drawn_sql('pool', 'arti_id', PAPERS, DRAWS)},
y AS (SELECT module, d.lang, rep, min(pub_year) AS y FROM drawn d JOIN pm USING (arti_id) GROUP BY ALL), a AS (SELECT module, lang, count(*) AS n, median(y)::DOUBLE AS mid, list_sort(list(y)) AS v FROM y GROUP BY ALL), b AS (SELECT module, lang, n, mid, v[floor(0.05 * n)::INT + 1] AS p05, v[greatest(0, floor(0.95 * n) - 1)::INT + 1] AS p95 FROM a), o AS (SELECT module, min(pub_year) AS observed FROM pm WHERE lang = '중국어' GROUP BY module)
SELECT b.module, b.lang, b.n AS draws, b.mid AS median, b.p05, b.p95, o.observed, CASE (SELECT count(*) FROM b c WHERE c.module = b.module AND o.observed > c.p95) WHEN 0 THEN 'size effect' WHEN 2 THEN 'late against all' ELSE 'late against one' END AS verdict FROM b JOIN o USING (module)""")
def size_matched_modules(spark, d):
    """First year of each module in 2,000 draws of 68 papers of either large language (draws without it are left out), and
    whether the small language is late against none, one or both of them."""
    papers = _paper_modules(spark, d)
    drawn = sampling.rank_draws(papers.where("lang in ('영어', '한국어')"), "lang", "arti_id", PAPERS, DRAWS, SEED)
    years = drawn.select("lang", "rep", "pub_year", F.explode("modules").alias("module")).groupBy("module", "lang", "rep").agg(F.min("pub_year").alias("y"))
    q = ranking.quantiles(years, ["module", "lang"], "y", DRAWS).select("module", "lang", F.col("n").alias("draws"), "p05", "p95")
    q = q.join(years.groupBy("module", "lang").agg(F.median("y").alias("median")), ["module", "lang"])  # one value a draw
    own = papers.where("lang = '중국어'").select("pub_year", F.explode("modules").alias("module")).groupBy("module").agg(F.min("pub_year").alias("observed"))
    joined = q.join(own, "module")
    late = joined.groupBy("module").agg(*(F.max(F.when(F.col("lang") == g, F.col("observed") > F.col("p95"))).alias(g) for g in ("영어", "한국어")))
    verdict = late.select("module", stats.lag_verdict([F.col("영어"), F.col("한국어")]).alias("verdict"))
    return joined.join(verdict, "module").select("module", "lang", "draws", "median", "p05", "p95", "observed", "verdict")


_METRICS = ("per_paper", "sole_pct", "isolates_pct", "mean_degree", "largest", "components")


def _drawn_authors(spark, d) -> tuple[DataFrame, DataFrame]:
    """(own, drawn): the small language's papers with their authors, and 2,000 draws of 68 papers of the others."""
    a = _authors(spark, d)
    return a.where("lang = '중국어'"), sampling.rank_draws(a.where("lang in ('영어', '한국어')"), "lang", "arti_id", PAPERS, DRAWS, SEED)


def _people(papers: DataFrame, *by: str) -> DataFrame:
    n = F.size("keys")
    return papers.groupBy(*by).agg(F.avg(n).alias("per_paper"), (100.0 * F.avg((n <= 1).cast("int"))).alias("sole_pct"))


_OBSERVED = f"""own AS (SELECT * FROM au WHERE lang = '중국어'), pe AS (SELECT avg(len(keys)) AS per_paper, 100.0 * avg(CASE WHEN len(keys) <= 1 THEN 1 ELSE 0 END) AS sole_pct FROM own)"""


@query(f"""WITH {FACT}, {_AUTHORS}, big AS (SELECT arti_id, lang FROM au WHERE lang <> '중국어'), {_drawn_sql('big', 'arti_id', PAPERS, DRAWS)}, j AS (SELECT d.lang, d.rep, au.keys FROM drawn d JOIN au USING (arti_id)), m AS (SELECT lang, rep, avg(len(keys)) AS per_paper, 100.0 * avg(CASE WHEN len(keys) <= 1 THEN 1 ELSE 0 END) AS sole_pct FROM j GROUP BY 1, 2), {_OBSERVED},
s AS (SELECT lang, count(*) AS n, list_sort(list(per_paper)) AS p, list_sort(list(sole_pct)) AS s, 100.0 * avg(CASE WHEN per_paper <= (SELECT per_paper FROM pe) + 1e-9 THEN 1 ELSE 0 END) AS pp, 100.0 * avg(CASE WHEN sole_pct <= (SELECT sole_pct FROM pe) + 1e-9 THEN 1 ELSE 0 END) AS sp FROM m GROUP BY lang)
SELECT lang, n AS draws, round(p[floor(n * 0.5)::INT + 1], 6) AS per_paper_median, round(p[floor(n * 0.05)::INT + 1], 6) AS per_paper_p05, round(p[floor(n * 0.95)::INT + 1], 6) AS per_paper_p95, round(pp, 6) AS per_paper_percentile, round(s[floor(n * 0.5)::INT + 1], 6) AS sole_median, round(s[floor(n * 0.05)::INT + 1], 6) AS sole_p05, round(s[floor(n * 0.95)::INT + 1], 6) AS sole_p95, round(sp, 6) AS sole_percentile FROM s""")
def resampled_authorship(spark, d):
    """Authors per paper and share of sole authors over 2,000 draws, and the small language's place among them."""
    own, drawn = _drawn_authors(spark, d)
    return _summary(_people(own), _people(drawn, "lang", "rep"), {"per_paper": "per_paper", "sole_pct": "sole"})


def _summary(own: DataFrame, draws: DataFrame, names: dict[str, str], at_least: int | None = None) -> DataFrame:
    both = draws.crossJoin(F.broadcast(own.select(*(F.col(m).alias(f"own_{m}") for m in names))))  # one row
    cols = [F.count("*").alias("draws")]
    for m, n in names.items():
        at = lambda p: F.round(ranking.empirical(F.collect_list(m), F.floor(F.count("*") * p)), 6)  # noqa: E731, B023
        cols += [at(0.5).alias(f"{n}_median"), at(0.05).alias(f"{n}_p05"), at(0.95).alias(f"{n}_p95"), F.round(100.0 * F.avg((F.col(m) <= F.col(f"own_{m}") + 1e-9).cast("int")), 6).alias(f"{n}_percentile")]
    if at_least is not None:
        cols.append(F.round(100.0 * F.avg((F.col("largest") >= at_least).cast("int")), 6).alias("large_pct"))
    return both.groupBy("lang").agg(*cols)


@query()
def resampled_network(spark, d):
    """All six graph metrics over 2,000 draws of 68 papers, with the share of draws whose largest component has nine
    authors or more; its parts that SQL can say are resampled_authorship and resampled_graph, single draws are tested by
    counting."""
    own, drawn = _drawn_authors(spark, d)
    nodes, edges = graph.nodes_of(own, "lang", "keys"), graph.pair_edges(own, "lang", "keys")
    sizes = graph.component_sizes(graph.components(nodes, edges, "lang"), "lang")
    shape = graph.summary(graph.degrees(nodes, edges, "lang"), "lang").select("lang", "isolates_pct", "mean_degree")
    observed = _people(own, "lang").join(sizes, "lang").join(shape, "lang")
    return _summary(observed, graph.draw_metrics(drawn, ["lang", "rep"], "keys"), {m: m for m in _METRICS}, LARGE)


@query(f"""WITH RECURSIVE {FACT}, {_AUTHORS}, keyed AS (SELECT au.*, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY md5(concat_ws('|', '{SEED}', rep, arti_id))) AS r FROM au CROSS JOIN (SELECT unnest(range(1, 21)) AS rep)), d AS (SELECT arti_id, keys, lang || '|' || rep AS g FROM keyed WHERE r <= 60), {GRAPHS} SELECT lang, rep, nodes, edges, components, largest, round(isolates_pct, 4) AS isolates_pct FROM graphs""")
def resampled_graph(spark, d):
    """Size of the largest component and isolates in 20 samples of 60 papers per language."""
    draws = sampling.simple_draws(_authors(spark, d), "lang", "arti_id", 60, 20, 20260930).withColumn("g", F.concat_ws("|", "lang", "rep"))
    nodes, edges = graph.nodes_of(draws, "g", "keys"), graph.pair_edges(draws, "g", "keys")
    sizes = graph.component_sizes(graph.components(nodes, edges, "g"), "g").join(graph.summary(graph.degrees(nodes, edges, "g"), "g"), "g")
    return sizes.select(F.split("g", "\\|")[0].alias("lang"), F.split("g", "\\|")[1].cast("int").alias("rep"), "nodes", "edges", "components", "largest", "isolates_pct")
