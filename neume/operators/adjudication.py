"""Rule ladders: decisions with reasons, replacement policies, fallbacks and plans for costly work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str, str]


def decide(rows: DataFrame, rules: Sequence[Rule], otherwise: tuple[str, str]) -> DataFrame:
    """``decision`` and ``reason`` of the first rule that holds."""
    decision, reason = F, F
    for holds, d, r in rules:
        decision, reason = decision.when(holds, d), reason.when(holds, r)
    return rows.withColumns({"decision": decision.otherwise(otherwise[0]), "reason": reason.otherwise(otherwise[1])})


def all_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of the reasons whose rules hold, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(reason)) for holds, reason in rules)))


def confidence_or_one(c: Column) -> Column:
    """A confidence for replacement evidence, where a missing one and a zero both count as one."""
    return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)


#: Suffixes that an added reading may have (fixed values).
ADDITION_SUFFIXES = (
    "5", "6", "7", "9", "11", "13", "m", "m6", "m7", "m9", "m11", "m13", "-", "-6", "-7", "-9", "-11", "-13", "-7b5", "maj", "maj6", "maj7", "maj9", "maj13", "dim", "dim7", "aug", "+", "+7",
    "sus", "sus2", "sus4", "7sus", "7sus4", "9sus", "9sus4", "add9", "6/9", "m7b5", "7b5", "7#5", "7b9", "7#9", "13b9", "alt",
)
#: Bodies that are known misreadings, and bodies that may end in a one (fixed values).
MISREAD_BODIES, BODIES_IN_ONE = ("19", "79", "69", "761", "769"), ("11", "m11", "-11", "maj11")


def text_root(text: Column) -> Column:
    """Root letter and sign; null where the text begins with neither."""
    return F.nullif(F.regexp_extract(F.trim(text), "^[A-G][#b]?", 0), F.lit(""))


def bare_root(text: Column) -> Column:
    return F.trim(text).rlike("^[A-G][#b]?$")


def risky_text(text: Column) -> Column:
    """A text whose brackets don't pair up, or whose body (all after the letter and its sign) is a known misreading,
    or ends in a one that no degree ends in."""
    t = F.trim(text)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    body = F.regexp_extract(t, "(?s)^.[#b]?(.*)$", 1)
    return (t != "") & ((count("(") != count(")")) | body.isin(*MISREAD_BODIES) | (body.endswith("1") & ~body.isin(*BODIES_IN_ONE)))


def common_addition(text: Column) -> Column:
    """Whether a text is a root with one of the common suffixes, over a bass if it has a slash; a bare root isn't."""
    body = F.regexp_extract(F.trim(text), "(?s)^[A-G][#b]?(.+)$", 1)
    upper, bass = F.substring_index(body, "/", 1), F.substr(body, F.instr(body, "/") + 1)
    return F.when(F.contains(body, F.lit("/")), upper.isin(*ADDITION_SUFFIXES) & text_root(bass).isNotNull()).otherwise(body.isin(*ADDITION_SUFFIXES))


def safe_addition(text: Column) -> Column:
    return ~bare_root(text) & ~risky_text(text) & common_addition(text)


def suspicious_baseline(text: Column, confidence: Column) -> Column:
    return risky_text(text) | ~common_addition(text) | (confidence_or_one(confidence) <= 0.30)


def root_relation(left: Column, right: Column) -> Column:
    a, b = text_root(left), text_root(right)
    return F.when(a.isNull() | b.isNull(), "missing_root").when(a == b, "same_root").when(F.substring(a, 1, 1) == F.substring(b, 1, 1), "same_letter_accidental").otherwise("different_root")


def replacement_evidence(base_text: Column, base_confidence: Column, text: Column, eligible: Column) -> Column:
    """struct(status, reason): what speaks for a second reading in place of the baseline's."""
    relation, doubt = root_relation(base_text, text), suspicious_baseline(base_text, base_confidence)
    near = relation.isin("same_root", "same_letter_accidental")
    both = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(~eligible, both("reject", "candidate_not_eligible"))
        .when(bare_root(text), both("reject", "candidate_is_root_only"))
        .when(risky_text(text) | ~common_addition(text), both("reject", "candidate_not_common_safe_shape"))
        .when(near & doubt, both("replace", F.concat(relation, F.lit("_for_suspicious_baseline"))))
        .when(near, both("review", F.concat(relation, F.lit("_for_plausible_baseline"))))
        .otherwise(both("review", "different_root_candidate"))
    )


def group_decisions(candidates: DataFrame, keys: Sequence[str] = ("doc_id", "group_id")) -> DataFrame:
    """One decision per candidate group: keys, winner (its seq), text, status, reason.

    ``candidates``: keys, seq, source (baseline, addition, suppressed or replacement), text_norm, confidence,
    eligible.  The baseline is the first one; of several additions, eligible or other candidates the most confident wins
    (a missing confidence is 0), the first on ties.  Without a baseline additions are accepted, eligible ones are
    for review, and the rest is ignored.  A baseline stays unless just one replacement is proved; if any is open it is
    for review.  Groups of any size are met by partial aggregation.
    """
    src, fields = F.col("source"), ("seq", "text_norm")
    best = lambda which: F.max(F.when(which, F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("seq")).alias("early"), *fields)))
    g = candidates.groupBy(*keys).agg(
        F.min(F.when(src == "baseline", F.struct(*fields, "confidence"))).alias("base"), best(src == "addition").alias("added"),
        best(F.col("eligible")).alias("able"), best(F.lit(True)).alias("any"), F.max((src == "replacement").cast("int")).alias("replaced"),
    )
    bases = g.where("base is not null and replaced = 1").select(*keys, "base")
    evidence = replacement_evidence(F.col("base.text_norm"), F.col("base.confidence"), F.col("text_norm"), F.col("eligible"))
    rows = candidates.where(src == "replacement").join(bases, list(keys)).withColumn("e", evidence)
    proved = F.col("e.status") == "replace"
    votes = rows.groupBy(*keys).agg(F.sum(proved.cast("int")).alias("n"), F.min(F.when(proved, F.struct(*fields, F.col("e.reason").alias("reason")))).alias("proof"), F.max((F.col("e.status") != "reject").cast("int")).alias("open"))
    d = g.join(votes, list(keys), "left")
    to = lambda who, status, reason: F.struct(F.col(f"{who}.seq").alias("winner"), F.col(f"{who}.text_norm").alias("text"), F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    made = (
        F.when(F.col("base").isNull() & F.col("added").isNotNull(), to("added", "auto", "addition_without_baseline"))
        .when(F.col("base").isNull() & F.col("able").isNull(), to("any", "ignore", "no_eligible_candidate"))
        .when(F.col("base").isNull(), to("able", "review", "no_baseline"))
        .when(F.col("replaced") == 0, to("base", "auto", "baseline_only"))
        .when(F.col("n") == 1, to("proof", "auto", F.col("proof.reason")))
        .when(F.col("open") == 1, to("base", "review", "replacement_needs_review"))
        .otherwise(to("base", "auto", "replacement_rejected_by_evidence"))
    )
    return d.select(*keys, made.alias("m")).select(*keys, "m.*")


def replacement_applies(raw: Column, base_text: Column, base_confidence: Column, text: Column, confidence: Column, threshold: float) -> Column:
    """Whether a second reading of the same root is put in place of a doubtful one."""
    base, new = F.coalesce(base_confidence, F.lit(1.0)), F.coalesce(confidence, F.lit(0.0))
    sure = F.coalesce(base_confidence <= threshold, F.lit(False))
    doubtful = sure | risky_text(base_text) | ((raw != base_text) & F.coalesce(base_confidence <= 0.65, F.lit(False)))
    able = ~bare_root(text) & ~risky_text(text) & text_root(base_text).eqNullSafe(text_root(text)) & doubtful
    better = F.when(risky_text(base_text), new >= 0.15).when(base <= threshold, (new >= base) | (new >= 0.35)).otherwise(bare_root(base_text) & ~bare_root(text))
    return able & better


#: Least share of systems with a usable crop, of systems with chords, and chords per measure (fixed values).
LEAST_COVERED, LEAST_WITH_CHORDS, LEAST_PER_MEASURE = 0.50, 0.25, 0.20


def fallback_reason(tokens: Column, systems: Column, usable: Column, with_chords: Column, measures: Column) -> Column:
    """Why a targeted reading isn't enough and the whole page is read; null if it is.  First reason that holds."""
    return (
        F.when(systems <= 0, "no_usable_systems")
        .when(usable / F.nullif(systems, F.lit(0)) < LEAST_COVERED, "too_few_regions_covered")
        .when(tokens == 0, "no_chords")
        .when(with_chords / F.nullif(systems, F.lit(0)) < LEAST_WITH_CHORDS, "too_few_systems_with_chords")
        .when((measures > 0) & (tokens / F.nullif(measures, F.lit(0)) < LEAST_PER_MEASURE), "too_few_chords_per_measure")
    )


def confidence_reason(confidence: Column, threshold: float) -> Column:
    """Why a reading is set aside for its confidence; null if it stays."""
    return F.when(confidence < threshold, F.format_string(f"confidence %.2f < threshold {threshold:.2f}", confidence.cast("double")))


def plan_cells(evidence: DataFrame, keys: Sequence[str], rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """The cells worth reading again with why: a plan to semi-join the costly step with."""
    return evidence.withColumn("reasons", all_reasons(rules)).where(F.size("reasons") > 0).select(*keys, "reasons")
