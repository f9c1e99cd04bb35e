"""Results of text, pictures and files: risks from label scores, pages of read text, unified decisions and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import hashtag_words


def softmax(z: Column) -> Column:
    """Of an array of logits, without overflow."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def risk_of(scores: Column, safe: str, activation: str, weights: dict[str, float] | None = None) -> Column:
    """One risk from a map of label scores.

    Weighted: expected severity of probabilities that add up, at most 1, else the worst weighted one. A single label is
    the risk itself. Else what is not safe, or the worst label that is not the safe one.
    """
    if weights:
        by = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        each = F.transform(F.map_entries(scores), lambda e: e.value * by[e.key])
        return F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda a, b: a + b)) if activation == "softmax" else F.array_max(each)
    whole = 1 - scores[safe] if activation == "softmax" else F.array_max(F.map_values(F.map_filter(scores, lambda k, v: k != safe)))
    return F.when(F.size(scores) == 1, F.element_at(F.map_values(scores), 1)).otherwise(whole)


def page_of(lines: Column, boxes: Column | None = None) -> Column:
    """A page ``(text, confidence, boxes)`` from read lines ``(text, score)``: blank lines go, scores are averaged."""
    texts = F.filter(F.transform(lines, lambda x: F.trim(x.text)), lambda t: t != "")
    mean = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x.score) / F.nullif(F.size(lines), F.lit(0))
    return F.struct(F.array_join(texts, " ").alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"), F.coalesce(boxes, F.size(lines)).alias("boxes"))


def readable(page: Column, least: float, trusted: float, per_box: float) -> Column:
    """Whether a page reads as text: sure enough, and surer still or long enough for its boxes."""
    chars = F.length(F.trim(page["text"]))
    return (chars > 0) & (page["confidence"] >= least) & ((page["confidence"] >= trusted) | (chars >= per_box * F.greatest(page["boxes"], F.lit(1))))


def has_text(page: Column) -> Column:
    return (F.trim(page["text"]) != "") | (page["boxes"] > 0)


def media_route(kind: Column, readable_: Column, has_text_: Column) -> Column:
    """How a file is looked at: pictures by sight, and as text where they can be read; what cannot be read is not checked."""
    return F.when(kind == "image", F.when(readable_, "image+text").when(has_text_, "image, text unread").otherwise("image")).when(kind == "pdf", F.when(readable_, "text").otherwise("not checked")).otherwise("not checked")


def action_of(decision: Column) -> Column:
    """The two answers a caller gets."""
    return F.when(decision.isin("allow", "approved"), "approved").otherwise("reject")


def note_of(decision: Column, message: Column, rule: Column, risk: Column) -> Column:
    """The note of an answer: the feedback, else the first rule, else the risk; none for what passes."""
    by_rule = F.concat(F.lit("Violation of policy rule: "), rule)
    by_risk = F.concat(F.lit("Content rejected by moderation risk score: "), F.coalesce(risk.cast("string"), F.lit("1.0")))
    return F.coalesce(message, F.when(action_of(decision) == "reject", F.coalesce(by_rule, by_risk)))


# The notes of a side that is refused without one.
TEXT_NOTE, IMAGE_NOTE = "Text violates moderation policy.", "Image violates moderation policy."


def unified(text: dict[str, Column], image: dict[str, Column]) -> dict[str, Column]:
    """``decision, action, legacy_decision, decided_by, risk, note`` of a submission with text and picture.

    Each side has ``decision, decided_by, risk, note``, or nulls, which pass. The harsher decision counts and the larger
    risk. Only sides that are refused or to be revised add their notes, or the standing one; a side that nothing looked
    at shows as ``disabled``.
    """
    told = lambda d: F.coalesce(d, F.lit("approved"))
    refused = lambda side: told(side["decision"]).isin("reject", "revise")
    some = lambda d: (told(text["decision"]) == d) | (told(image["decision"]) == d)
    off = F.coalesce(text["decided_by"] == "disabled", F.lit(False)) | F.coalesce(image["decided_by"] == "disabled", F.lit(False))
    own = lambda side, standing: F.when(refused(side), F.coalesce(F.nullif(side["note"], F.lit("")), F.lit(standing)))
    decision = F.when(some("reject"), "reject").when(some("revise"), "revise").otherwise("approved")
    return {
        "decision": decision,
        "action": F.when(decision == "approved", "approved").otherwise("reject"),
        "legacy_decision": F.when(decision == "approved", "allow").otherwise(decision),
        "decided_by": F.when(off, "disabled").otherwise(F.coalesce(F.nullif(text["decided_by"], F.lit("")), image["decided_by"])),
        "risk": F.greatest(text["risk"], image["risk"]),
        "note": F.nullif(F.concat_ws(" | ", own(text, TEXT_NOTE), own(image, IMAGE_NOTE)), F.lit("")),
    }


def visual_match(cause: Column, label: Column, category: Column, exemplar: Column, exemplar_category: Column) -> Column:
    """A refusal by sight in the shape of a gate match, named by what refused: a marked picture, the probe or the policy.

    A marked picture gives its own category, translated before, and its id where it has one.
    """
    marked = F.coalesce(cause == "exemplar", F.lit(False))
    by_mark = F.concat(F.lit("visual.exemplar"), F.coalesce(F.concat(F.lit("#"), exemplar.cast("string")), F.lit("")))
    rule = F.when(marked, by_mark).when(cause == "probe", F.concat(F.lit("visual.probe."), label)).otherwise(F.concat(F.lit("visual."), label))
    return F.struct(rule.alias("rule_id"), F.coalesce(F.when(marked, exemplar_category).otherwise(category), F.lit("")).alias("category"), F.lit("block").alias("action"))


def hashtag_text(raw: Column) -> Column:
    """A comma list of tags as the words they are made of; null is empty."""
    words = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), hashtag_words)
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def first_named(body: Column, names: list[str]) -> Column:
    """The first of several names of a field that a JSON body has with a value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(body, f"$.{n}")), F.lit("")) for n in names])


def attachments(*fields: Column) -> Column:
    """How many attachments fields hold: arrays by their entries that are not blank."""
    return sum((F.coalesce(F.size(F.filter(f, lambda x: x.isNotNull() & (F.trim(x) != ""))), F.lit(0)) for f in fields), F.lit(0))
