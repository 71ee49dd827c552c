"""Questions for a human reviewer, and the decisions that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import CATEGORIES

# Thresholds, question types, options and rationales.
SURE = 0.7
OVERRIDE, REVIEW = "category_override", "unsupported_feature_review"
REVIEW_OPTIONS, REVIEW_DEFAULT = ("accept_record_only", "manual_follow_up", "ignore_for_phase1"), "manual_follow_up"
OVERRIDE_RATIONALE = "Low-confidence rule-based classification requires human review."
REVIEW_RATIONALE = "Unsupported Excel features are recorded and should be reviewed before migration."


def questions(items: DataFrame) -> DataFrame:
    """What an item asks, if anything: to confirm an unsure category, then to review what is not supported."""

    def ask(step, when, prefix, prompt, kind, options, default, rationale):
        row = F.struct(
            F.lit(step).cast("long").alias("step"), F.concat(F.lit(prefix), F.col("id")).alias("id"), prompt.alias("prompt"), F.lit(kind).alias("question_type"),
            F.array(*map(F.lit, options)).alias("options"), default.alias("default"), F.lit(rationale).alias("rationale"),
        )
        return F.when(when, row)

    override = F.concat(F.lit("Confirm category for "), F.col("id"), F.lit(": "), F.col("category"))
    review = F.concat(F.lit("Review unsupported or opaque workbook feature: "), F.array_join("reasons", "; "))
    asked = F.array_compact(
        F.array(
            ask(0, F.col("confidence") < SURE, "confirm:", override, OVERRIDE, CATEGORIES, F.col("category"), OVERRIDE_RATIONALE),
            ask(1, F.col("category") == "unsupported_opaque", "risk:", review, REVIEW, REVIEW_OPTIONS, F.lit(REVIEW_DEFAULT), REVIEW_RATIONALE),
        )
    )
    rows = items.select("sha256", "seq", "loc", F.explode(asked).alias("q"))
    return rows.select("sha256", F.concat("seq", F.array("q.step")).alias("seq"), "q.id", "q.prompt", "q.question_type", "q.options", "q.default", "q.rationale", "loc")


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with the categories that reviewers decided. decisions: (sha256, question_id, decision, timestamp); the
    latest decision on an override counts if it names a category."""
    valid = decisions.where(F.col("question_id").startswith("confirm:") & F.col("decision").isin(*CATEGORIES))
    latest = valid.groupBy("sha256", F.substring("question_id", 9, 2**30).alias("id")).agg(F.max_by("decision", F.struct("timestamp", "decision")).alias("decision"))
    return items.join(latest, ["sha256", "id"], "left").withColumn("category", F.coalesce("decision", "category")).drop("decision").select(*items.columns)
