"""The pN_ queries: one function (spark, sf_dir) -> DataFrame per query, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, canon, components, consensus, cooccur, sampling, subjects, terms
from loomspark.session import table


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.fit(consensus.latest_answers(table(spark, d, "codings")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.contested(_consensus(spark, d)).withColumnRenamed("item", "arti_id")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).decided().select(F.col("item").alias("arti_id"), "axis", "label", F.round("probability", 6).alias("probability"))


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    fitted = _consensus(spark, d)
    return fitted.reliability.select("axis", "coder", "answers", F.round("reliability", 6).alias("reliability"), F.lit(fitted.converged).alias("converged"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = consensus.agreement(consensus.latest_answers(table(spark, d, "codings")))
    return out.select("axis", "items", "answers", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "author_matches"), table(spark, d, "author_mentions"))


def p2_assignment(spark: SparkSession, d: str) -> DataFrame:
    return components.full_assignment(p2_found(spark, d), table(spark, d, "author_mentions"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.proportional_sample(table(spark, d, "papers"), table(spark, d, "sample_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("short").select("plan_id", "category")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].select("plan_id", "field", "category", F.round("quota", 4).alias("quota"), "available", "drawn", F.round("residual", 4).alias("residual"), F.round("share", 6).alias("share"), "short")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether every category was drawn within one of its quota, or whole where it has fewer papers."""
    within = F.abs(F.col("drawn") - F.least("quota", F.col("available").cast("double"))) < 1
    return _sample(spark, d)[1].select("plan_id", "field", "category", F.round("quota", 4).alias("quota"), "available", within.alias("within"), "short")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "papers")).where("mark <> ''").select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "papers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "canon_values")
    mapped = canon.map_values(table(spark, d, "verdicts"), "verdict_id", ("func", "meth", "tool"), entries)
    return canon.typed_otherwise(mapped, entries).select("verdict_id", "axis", "canon_value")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = canon.map_values(table(spark, d, "verdicts"), "verdict_id", ("func", "meth", "tool"), table(spark, d, "canon_values"))
    return mapped.where("canon_value = ''").groupBy("axis", "typed").agg(F.count("*").alias("times"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    return cooccur.cooccurrence(cooccur.author_baskets(papers), papers.agg(F.count_distinct("arti_id").alias("n_all")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("item_a").alias("author_a"), F.col("item_b").alias("author_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("lift", F.round("lift", 6))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.source_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("mix_id", "source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].select("mix_id", "source", "documents", "source_tokens", F.round("wanted_tokens", 4).alias("wanted_tokens"), "taken_documents", "taken_tokens", F.round("residual", 4).alias("residual"), F.round("share", 6).alias("share"), "short")


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source was taken within two of its largest documents of its share, and of its documents none too
    often: uses by document, counted apart from the report."""
    uses, report = _mix(spark, d)
    most = uses.groupBy("mix_id", "source").agg(F.max("uses").alias("most"))
    limit = F.least("wanted_tokens", (F.col("max_uses") * F.col("source_tokens")).cast("double"))
    return report.join(most, ["mix_id", "source"], "left").select(
        "mix_id", "source", "documents", (F.abs(F.col("taken_tokens") - limit) <= 2 * F.col("largest")).alias("within"), (F.coalesce("most", F.lit(0)) <= F.col("max_uses")).alias("allowed")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per area, hand-made labels included, and their share of all documents."""
    documents = table(spark, d, "documents")
    labelled = table(spark, d, "subject_labels").select("doc_id", "area_code").distinct()
    per = p10_found(spark, d).unionByName(labelled).groupBy("area_code").agg(F.count("*").alias("documents"))
    return per.crossJoin(F.broadcast(documents.agg(F.count_distinct("doc_id").alias("n")))).select("area_code", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consensus, p1_reliability, p1_agreement, p2_found, p2_assignment, p3_found, p3_report, p3_sample, p3_balance, p4_found, p4_terms, p5_found, p5_unmatched, p6_found, p6_pairs, p8_ids, p9_found, p9_report, p9_uses, p9_balance, p10_found, p10_composition)}
