"""What the sections of a product label say about another product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes from the strongest to the weakest, how they are written, the grade each stands for, and the
# wording that makes a sentence one of them.
CLASSES = ("contraindicated", "avoid_or_not_recommended", "monitor_or_adjust", "mentioned_without_guidance", "not_mentioned")
WRITTEN = {"contraindicated": "contraindicated", "avoid_or_not_recommended": "avoid / not recommended", "monitor_or_adjust": "monitor / adjust", "mentioned_without_guidance": "mentioned without guidance", "not_mentioned": "not mentioned"}
GRADE = {"contraindicated": "Major", "avoid_or_not_recommended": "Major", "monitor_or_adjust": "Moderate"}
AVOID = r"\bavoid\w*|\bnot recommended\b|\bshould not be (?:used|taken|given|administered|co-?administered|combined)|\bdo not (?:use|take|administer|co-?administer|combine|prescribe)\b|\bmust not\b"
MONITOR = (
    r"\bmonitor\w*|\badjust\w*|\breduc\w* (?:the )?(?:dose|dosage)|\b(?:decreas|reduc)\w* by \d|\bdose (?:reduction|adjustment)|\blower (?:the )?(?:dose|dosage)|\bdo not exceed\b|\blimit\w*|\bcaution\w*|\bconsider\w*"
    r"|\bclosely\b|\btitrat\w*|\bseparate\w*|\bask a doctor\b|\bask a pharmacist\b|\breserve\b|\binterrupt\w*|\bdiscontinu\w*|\bsuspend\w*|\bhours (?:before|after)\b"
)

# The sections that are read, in order, with their titles, and what ends a clause.
SECTIONS = {"boxed_warning": "Boxed Warning", "contraindications": "Contraindications", "warnings_and_cautions": "Warnings and Precautions", "warnings": "Warnings", "precautions": "Precautions", "drug_interactions": "Drug Interactions"}
BOUNDARY = r"[.;•]\s|\(\s*\d+(?:\.\d+)*\s*\)|\[see [^\]]*\]"


def label_class(section: Column, sentence: Column) -> Column:
    """The class of a sentence that names the other product."""
    t = F.lower(sentence)
    stated = F.when((section == "contraindications") | t.contains("contraindicat"), CLASSES[0])
    return stated.when(t.rlike(AVOID), CLASSES[1]).when(t.rlike(MONITOR), CLASSES[2]).otherwise(CLASSES[3])


def strength(name: Column) -> Column:
    """0 for the strongest class."""
    return (F.array_position(F.array(*map(F.lit, CLASSES)), name) - 1).cast("int")


def lookup(values: dict[str, str], name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[name]


def snippet(sentence: Column, alias: Column, width: int = 170) -> Column:
    """The text around an alias, with an ellipsis on each side where something is left out."""
    at = F.instr(F.lower(sentence), alias) - 1
    low = F.greatest(F.lit(0), at - width // 2)
    high = F.least(F.char_length(sentence), at + F.char_length(alias) + width // 2)
    inner = F.regexp_replace(F.substring(sentence, low + 1, high - low), r"^\s+|\s+$", "")
    return F.concat(F.when(low > 0, "…").otherwise(""), inner, F.when(high < F.char_length(sentence), "…").otherwise(""))
