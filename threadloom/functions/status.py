"""States of decisions, relations between them and scores by state, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States, those of them that are active, and those that count as decided.
STATUSES = ["pending", "pending_confirmation", "in_discussion", "decided", "executing", "completed", "shelved", "rejected", "superseded", "deprecated"]
ACTIVE = STATUSES[:5]
DECIDED = ["decided", "executing", "completed"]
# Impact levels, kinds of relations, and the kinds of statements that can be confirmed decisions.
IMPACTS = ["advisory", "minor", "major", "critical"]
RELATIONS = ["DEPENDS_ON", "SUPERSEDES", "REFINES", "CONFLICTS_WITH", "RELATES_TO", "OBJECTION"]
CONFIRMABLE = ["choice", "conditional_choice", "execution_commitment", "policy_constraint"]
# Worth of a state when one of two duplicates is kept; 50 for the others.
STATUS_WORTH = {"completed": 100, "executing": 90, "decided": 80, "in_discussion": 60, "pending": 50, "superseded": 20, "deprecated": 10, "shelved": 5}
STRENGTHS = ["weak", "medium", "strong"]


def is_active(status: Column) -> Column:
    return status.isin(ACTIVE)


def is_inactive(status: Column) -> Column:
    return status.isin(STATUSES[5:])


def is_decided(status: Column) -> Column:
    return status.isin(DECIDED)


def is_confirmed(kind: Column, is_suggestion: Column, status: Column) -> Column:
    """A decided statement of a confirmable kind that isn't a suggestion."""
    return F.coalesce(kind, F.lit("choice")).isin(CONFIRMABLE) & ~F.coalesce(is_suggestion, F.lit(False)) & (status == "decided")


def known_or(value: Column, known: list[str], other: str) -> Column:
    """A value of an enumeration, or ``other`` for one that isn't."""
    return F.when(value.isin(known), value).otherwise(F.lit(other))


def conflict_status(a: Column, b: Column) -> Column:
    """What the states of two conflicting decisions say of the conflict; the first rule that holds counts."""
    out = None
    for status, name in (("completed", "resolved"), ("superseded", "superseded"), ("deprecated", "deprecated"), ("shelved", "shelved")):
        test = (a == status) | (b == status)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when((a == "decided") & (b == "decided"), "conflict_active").otherwise("unknown")


def stronger(a: Column, b: Column) -> Column:
    """The stronger of two strengths."""
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in STRENGTHS]), s)
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def relation_label(kind: Column) -> Column:
    """The label of an edge; RELATES_TO for a kind that isn't known."""
    return known_or(F.upper(F.coalesce(kind, F.lit(""))), RELATIONS, "RELATES_TO")


def percent_change(old: Column, new: Column) -> Column:
    """By how many percent ``new`` differs; null where ``old`` is 0."""
    return F.when(old == 0, F.lit(None).cast("double")).otherwise(100.0 * (new - old) / old)


def next_version(version: Column, major: bool = False) -> Column:
    """'v1.2' becomes 'v1.3', or 'v2.0'; an empty one 'v1.1', or 'v1.0'."""
    clear = F.regexp_replace(F.coalesce(version, F.lit("")), "^v+", "")
    number = lambda i, other: F.coalesce(F.try_to_number(F.regexp_extract(clear, r"^(\d*)(?:\.(\d*))?", i), F.lit("999999999")).cast("long"), F.lit(other))
    if major:
        return F.when(clear == "", "v1.0").otherwise(F.concat(F.lit("v"), (number(1, 1) + 1).cast("string"), F.lit(".0")))
    return F.when(clear == "", "v1.1").otherwise(F.concat(F.lit("v"), number(1, 1).cast("string"), F.lit("."), (number(2, 0) + 1).cast("string")))


def decision_score(status: Column, version: Column, confidence: Column, hot: Column) -> Column:
    """The worth of a decision among duplicates."""
    worth = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_WORTH.items() for x in pair]), status), F.lit(50))
    return worth + 5.0 * F.least(version, F.lit(10)) + 30.0 * confidence + 0.5 * F.coalesce(hot, F.lit(0.0))


def id_domain(id_: Column) -> Column:
    """What stands before the first underscore or hyphen of an id."""
    return F.regexp_extract(id_, r"^([^_-]*)", 1)


def error_kind(message: Column) -> Column:
    """Whether an evaluation failed by its structure or by its judge."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(low == "", "none").when(low.rlike("assignment|output_index|matched_msg_id|json|schema"), "structural").when(low.rlike("timeout|connection|rate limit|http|evaluat|judge"), "evaluator").otherwise("other")
