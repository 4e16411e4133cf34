"""Samples that match target proportions of a category, and mixes of sources that match target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.packed import distinct_papers
from loomspark.functions.text import folded
from loomspark.llm.bpe import TOKENIZER_DIR, token_counter
from loomspark.llm.cube import cube_sample
from loomspark.session import cut, small_side


#: Target rows that go to every task; a larger plan is joined by shuffle.
MAX_TARGETS = 100_000


def _exact(column: str):
    return F.col(column).cast("decimal(20,10)")


def category_plan(papers: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, members): the plan with available counts and quotas, and (field, arti_id, category) of every paper.

    The quota of a category is the larger of share × rows and the minimum. A paper counts once; null and blank values
    are the category '' of no plan.
    """
    fields = sorted(r["field"] for r in targets.select("field").where(F.col("field").isin(papers.columns)).distinct().collect())  # column names
    if not fields:
        members = papers.sparkSession.createDataFrame([], "field string, arti_id string, category string")
    else:
        one = distinct_papers(papers, *fields)
        clean = one.select("arti_id", *(folded(F.col(f).cast("string")).alias(f"v_{f}") for f in fields))
        members = clean.select("arti_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("category")) for f in fields))).alias("m")).select("m.field", "arti_id", "m.category").where("category <> ''")
    members = cut(members)
    have = members.groupBy("field", "category").agg(F.count("*").alias("available"))
    plan = targets.select("plan_id", "field", "category", "target_share", "min_rows", "sample_rows").join(have, ["field", "category"], "left")
    plan = plan.withColumn("available", F.coalesce("available", F.lit(0).cast("bigint"))).withColumn("quota", F.greatest(_exact("target_share") * F.col("sample_rows"), F.col("min_rows").cast("decimal(20,10)")).cast("decimal(30,10)"))
    return cut(plan), members


def proportional_sample(papers: DataFrame, targets: DataFrame, seed: int = 20260930) -> tuple[DataFrame, DataFrame]:
    """(sample, report): (plan_id, field, category, arti_id) drawn by the cube method, and one row per target category.

    A category that has fewer papers than its quota is taken whole: if the draw has all its papers and still lacks some
    of the quota, it is reported short. (A category with enough papers is drawn within one of its quota, and never whole
    below it.) The report gives quota, available and drawn papers, the residual imbalance drawn − quota and the share
    reached. A target category that occurs twice in a plan is reported twice and drawn once; a plan may name several
    fields, and a category of the same name in two fields is two categories.
    """
    plan, members = category_plan(papers, targets)
    rates = plan.where("available > 0").groupBy("plan_id", "field", "category").agg(F.max(F.least(F.lit(1.0), F.col("quota").cast("double") / F.col("available"))).alias("pi"))
    units = members.join(small_side(rates, MAX_TARGETS), ["field", "category"]).select(F.concat_ws("\x1f", F.coalesce(F.col("plan_id").cast("string"), F.lit("")), "field", "category").alias("s"), "arti_id", "pi")
    drawn = cut(cube_sample(units, "s", "arti_id", "pi", seed=seed))
    part = F.split("stratum", "\x1f", 3)
    sample = drawn.select(part[0].try_cast("int").alias("plan_id"), part[1].alias("field"), part[2].alias("category"), F.col("unit").alias("arti_id"))
    got = sample.groupBy("plan_id", "field", "category").agg(F.count("*").alias("drawn"))
    report = plan.join(got, ["plan_id", "field", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    report = report.withColumn("short", F.coalesce((F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("quota")), F.lit(False)))
    total = report.groupBy("plan_id").agg(F.sum("drawn").alias("all_drawn"))
    report = report.join(total, "plan_id").select(
        "plan_id", "field", "category", "target_share", "min_rows", F.col("quota").cast("double").alias("quota"), "available", "drawn",
        (F.col("drawn") - F.col("quota").cast("double")).alias("residual"), F.try_divide("drawn", "all_drawn").alias("share"), "short",
    )
    return sample, report


def source_mix(documents: DataFrame, targets: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, seed: int = 20260930) -> tuple[DataFrame, DataFrame]:
    """(uses, report): (mix_id, source, doc_id, uses) of every document taken, and one row per target source.

    Sizes are tokens of the public tokenizer; every row counts, null and empty texts 0 tokens. A source gives whole
    passes over its documents while they fit into its share of the budget and under max_uses; the rest of the share is a
    cube sample balanced on tokens and documents. A source whose share exceeds max_uses × its tokens is taken max_uses
    times; if it was taken so often and still lacks some of its share, it is reported short. Rows without source belong to no mix; a target source without documents is short if its
    share is above 0. Documents are tokenised once; only (doc_id, source, tokens) is kept.
    """
    sized = cut(documents.select("doc_id", "source", token_counter(vocabulary, folder)(F.col("text").cast("string")).alias("tokens")))
    have = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.max("tokens").alias("largest"), F.count("*").alias("documents"))
    plan = targets.select("mix_id", "source", "target_share", "max_uses", "budget_tokens").join(have, "source", "left")
    plan = plan.na.fill(0, ["source_tokens", "largest", "documents", "max_uses"]).withColumn("wanted", (_exact("target_share") * F.col("budget_tokens")).cast("decimal(38,10)"))
    passes = F.try_divide(F.col("wanted").cast("double"), F.col("source_tokens"))
    plan = plan.withColumn("passes", F.least(F.coalesce(F.when(F.col("source_tokens") > 0, passes), F.lit(0.0)), F.col("max_uses").cast("double")))
    plan = cut(plan.withColumn("whole", F.floor("passes")).withColumn("pi", F.col("passes") - F.col("whole")))
    keyed = plan.groupBy("mix_id", "source").agg(F.max("whole").alias("whole"), F.max_by("pi", "whole").alias("pi"))
    members = sized.join(small_side(keyed, MAX_TARGETS), "source")
    drawn = cut(cube_sample(members.select(F.concat_ws("\x1f", F.col("mix_id").cast("string"), "source").alias("s"), "doc_id", "pi", "tokens"), "s", "doc_id", "pi", "tokens", seed))
    part = F.split("stratum", "\x1f", 2)
    extra = drawn.select(part[0].cast("int").alias("mix_id"), part[1].alias("source"), F.col("unit").alias("doc_id"), F.lit(1).cast("bigint").alias("uses"), F.col("size").cast("bigint").alias("tokens"))
    base = members.where("whole > 0").select("mix_id", "source", "doc_id", F.col("whole").alias("uses"), "tokens")
    taken = base.unionByName(extra)
    uses = taken.groupBy("mix_id", "source", "doc_id").agg(F.sum("uses").alias("uses"))
    got = taken.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("taken_tokens"), F.sum("uses").alias("taken_documents"))
    report = plan.join(got, ["mix_id", "source"], "left").na.fill(0, ["taken_tokens", "taken_documents"])
    report = report.withColumn("short", F.coalesce((F.col("taken_tokens") == F.col("max_uses") * F.col("source_tokens")) & (F.col("taken_tokens") < F.col("wanted")), F.lit(False)))
    total = report.groupBy("mix_id").agg(F.sum("taken_tokens").alias("all_tokens"))
    report = report.join(total, "mix_id").select(
        "mix_id", "source", "target_share", "max_uses", "documents", "source_tokens", "largest", F.col("wanted").cast("double").alias("wanted_tokens"), "taken_documents", "taken_tokens",
        (F.col("taken_tokens") - F.col("wanted").cast("double")).alias("residual"), F.try_divide("taken_tokens", "all_tokens").alias("share"), "short",
    )
    return uses, report
