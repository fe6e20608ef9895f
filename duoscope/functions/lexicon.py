"""Terms that claims are made of, found in folded text (functions.text.fold). All matchers are column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import fold

# Families of mechanisms. Those with isoforms have a pattern for an isoform (group 1) and one for the family.
ISOFORMS = {
    "CYP": (r"\bcyp\s*-?\s*(\d{1,2}[a-z]{1,2}\d{0,3})\b", r"\bcytochrome\s*p\s*-?\s*450\b|\bcyp\s*-?\s*450\b|\bcyp\b(?!\s*-?\s*\d)"),
    "OATP": (r"\boatp\s*-?\s*(\d[a-z]\d{0,2})\b", r"\boatps?\b(?!\s*-?\s*\d)"),
    "UGT": (r"\bugt\s*-?\s*(\d[a-z]\d{0,2})\b", r"\bugts?\b(?!\s*-?\s*\d)|\bglucuronid\w*"),
}
MECHANISMS = {
    "P-glycoprotein": r"\bp\s*-?\s*glycoprotein\b|\bp\s*-?\s*gp\b|\babcb1\b|\bmdr1\b",
    "BCRP": r"\bbcrp\b|\babcg2\b",
    "QT": r"\bqtc?\b|\btorsades?\b",
    "serotonergic": r"\bserotonerg\w*|\bserotonin\b|\b5-?ht\d?\w*\b",
    "MAO": r"\bmonoamine oxidase\b|\bmaois?\b|\bmao\b",
    "protein binding": r"\bprotein[- ]binding\b|\bdisplac\w*\b",
    "enzyme induction": r"\binduc(?:er|ers|es|tion|ing)\b",
    "clearance/elimination": r"\bclearance\b|\belimination\b|\bexcretion\b|\btubular secretion\b",
    "absorption/chelation": r"\bchelat\w*\b|\babsorption\b",
    "CNS depression": r"\bcns depress\w*\b|\bcentral nervous system depress\w*\b|\bsedat\w*\b",
    "anticholinergic": r"\banticholinergic\w*\b",
    "potassium handling": r"\bpotassium[- ]sparing\b|\bk[- ]sparing\b|\bpotassium retention\b",
    "platelet function": r"\bplatelets?\b|\bantiplatelet\b",
    "vitamin K": r"\bvitamin k\b",
}
POPULATIONS = {
    "elderly": r"\belderly\b|\bolder (?:adults?|patients?|people)\b|\bgeriatric\w*\b",
    "pediatric": r"\bpediatric\w*\b|\bchild(?:ren)?\b|\binfants?\b|\bneonat\w*\b|\badolescen\w*\b",
    "pregnancy/lactation": r"\bpregnan\w*\b|\blactat\w*\b|\bbreast-?feeding\b",
    "renal impairment": r"\brenal (?:impairment|insufficiency|disease)\b|\bkidney disease\b|\bckd\b|\bimpaired renal\b|\bdialysis\b",
    "hepatic impairment": r"\bhepatic (?:impairment|insufficiency|disease)\b|\bliver disease\b|\bcirrho\w*\b|\bimpaired hepatic\b",
}
# Events; the terms of one row mean the same.
EVENTS = (
    ("bleeding", "hemorrhage", "bleed", "bleeds"),
    ("hyperkalemia", "high potassium", "elevated potassium"),
    ("hypokalemia", "low potassium"),
    ("hypoglycemia", "low blood sugar"),
    ("qt prolongation", "prolonged qt", "qt interval prolongation", "torsades de pointes"),
    ("serotonin syndrome",),
    ("rhabdomyolysis",),
    ("myopathy",),
    ("respiratory depression",),
    ("cns depression",),
    ("bradycardia",),
    ("hypotension",),
    ("acute kidney injury", "kidney injury", "renal failure", "kidney failure", "nephrotoxicity", "renal dysfunction"),
    ("hepatotoxicity", "liver injury", "liver toxicity"),
    ("lactic acidosis",),
    ("seizure", "seizures", "convulsions"),
    ("bronchospasm",),
    ("digoxin toxicity",),
    ("lithium toxicity",),
    ("methotrexate toxicity",),
    ("theophylline toxicity",),
    ("contraceptive failure",),
    ("serotonin toxicity",),
)
GENERIC_EVENTS = ("interaction", "interactions", "drug interaction", "adverse event", "adverse events", "adverse reaction", "side effect", "side effects")
# Wording of severity, safety, absence, numbers and clinical claims.
TIER_IN_CONTEXT = (
    r"\b(major|moderate|minor)\b(?=\s*(?:[)\]:]|-?\s*(?:severity|interaction|risk|finding|tier|level|grade)))"
    r"|(?:severity|tier|graded?|classified as|rated)\s*(?:[:=]|of|is|as)?\s*\b(major|moderate|minor)\b|\(\s*(major|moderate|minor)\s*\)"
)
NOT_GRADED = r"\bnot graded\b|\bungraded\b|\bseverity (?:is )?unknown\b"
SEVERITY_WORDS = (
    r"\b(?:major|moderate|minor|mild|severe|severity|serious|dangerous|life-threatening|contraindicat\w*|clinically (?:significant|relevant|important)"
    r"|high-risk|high risk|low-risk|low risk)\b"
)
SEVERITY_DENIED = (
    r"\b(?:not|never) (?:graded|rated|classified|a grade|an? (?:clinical )?severity grade)(?: (?:for|of|by) (?:clinical )?severity)?\b"
    r"|\bseverity (?:is )?not graded\b|\bno (?:clinical )?severity(?: grade)?\b|\bnot graded\b"
)
SAFE = (
    r"(?=safe)(?<!(?:\bnot\b|n't\b|\bno evidence\b|\bnor\b|\bneither\b)[^.;]{0,40})\bsafe(?:ly|ty)?\b(?! ?(?:data|information))",
    r"\bno (?:known |significant |clinically (?:significant|relevant) |documented |reported )?interactions?\b(?! (?:data|records?|evidence|information))",
    r"\b(?:do|does|will|did) not interact\b|\bdon'?t interact\b|\bnon-?interacting\b",
    r"\bno (?:clinically )?(?:relevant |significant )?(?:risk|concern)s?\b",
    r"\bcan be (?:safely )?(?:taken|used|combined|co-?administered|given) together\b",
    r"\bcompatible\b",
)
ABSENCE = r"\bno (?:curated )?(?:interaction )?(?:data|records?|evidence|information)\b|\bnot found\b|\bno record\b|\bnot (?:in|covered by) the (?:queried )?sources\b"
CLINICAL = (
    r"\b(?:risk|increas\w*|decreas\w*|rais\w*|lower\w*|reduc\w*|toxic\w*|inhibit\w*|induc\w*|potentiat\w*|interact\w*|effect\w*|levels?|concentrations?|exposure|adverse|monitor\w*"
    r"|avoid\w*|contraindicat\w*|prolong\w*|caus\w*|lead\w*|result\w*|danger\w*|serious|severe|fatal)\b"
)
PRR = r"\b(?:prr|proportional reporting ratio)\b\s*(?:\(prr\)\s*)?(?:=|:|of|is|was|~|≈|at)?\s*(\d+(?:\.\d+)?)"
REPORTS = r"\b(\d[\d,]*)\s+(?:spontaneous\s+)?(?:faers\s+)?reports?\b"
COUNT = r"(?<![\d.,])(\d{1,3}(?:,\d{3})+|\d+)(?![\d.])"
CO_REPORTS = (COUNT + r"\s+co-?reports?\b", r"\bco-?reports?\s*(?:[:=]|of)?\s*" + COUNT)
HIDDEN = r"\+\s*(\d+)\s+more\b[^.;\n]{0,40}?\bnot shown\b"


def placeholder(event: Column) -> Column:
    """Whether an event says too little to be printed: one of GENERIC_EVENTS in any spelling, empty or null."""
    return fold(event).isin("", *GENERIC_EVENTS)


def ascii_bounds(pattern: str) -> str:
    """pattern with look-arounds in place of each \\b: Java's \\b takes letters of all alphabets for word characters, but its \\w
    only those of ASCII, so that "phéno" would not end in the word "no". Each \\b here stands right before or after a word character."""
    begins = re.compile(r"\w|\\d|\((?!\?[=!<])")
    return re.sub(r"\\b", lambda m: r"(?<!\w)" if begins.match(pattern, m.end()) else r"(?!\w)", pattern)


def every(t: Column, pattern: str | Column, groups: int = 1) -> Column:
    """All matches of a pattern: what the first group that took part holds (groups = 0: the whole match)."""
    pattern = F.lit(ascii_bounds(pattern)) if isinstance(pattern, str) else pattern
    if not groups:
        return F.regexp_extract_all(t, pattern, F.lit(0))
    parts = [F.regexp_extract_all(t, pattern, F.lit(i)) for i in range(1, groups + 1)]
    return F.filter(F.flatten(F.array(*parts)), lambda x: x != "")


def holds(t: Column, pattern: str) -> Column:
    """Whether t matches a pattern."""
    return t.rlike(ascii_bounds(pattern))


def numerals(t: Column, *patterns: str) -> Column:
    """Numbers that patterns find as they are written, leading zeros and all, those of the first pattern first, thousands separators
    left out. Each pattern reads the whole text: "4 co-reports: 12" holds a number of each form."""
    return F.transform(F.flatten(F.array(*[every(t, p) for p in patterns])), lambda x: F.replace(x, F.lit(","), F.lit("")))


def counts(t: Column, *patterns: str) -> Column:
    """numerals() as whole numbers; null where one is too long for that."""
    return F.transform(numerals(t, *patterns), lambda x: x.try_cast("bigint"))


#: What a text must hold for a pattern to match at all. A plain search for these is many times faster than the pattern.
STEMS = {
    "CYP": ("cyp", "cytochrome"), "OATP": ("oatp",), "UGT": ("ugt", "glucuronid"), "P-glycoprotein": ("glycoprotein", "gp", "abcb1", "mdr1"), "BCRP": ("bcrp", "abcg2"), "QT": ("qt", "torsade"), "serotonergic": ("seroton", "ht"), "MAO": ("mao", "monoamine"),
    "protein binding": ("protein", "displac"), "enzyme induction": ("induc",), "clearance/elimination": ("clearance", "elimination", "excretion", "secretion"), "absorption/chelation": ("chelat", "absorption"), "CNS depression": ("depress", "sedat"),
    "anticholinergic": ("anticholinergic",), "potassium handling": ("sparing", "retention"), "platelet function": ("platelet",), "vitamin K": ("vitamin",),
    "elderly": ("elderly", "older", "geriatric"), "pediatric": ("pediatric", "child", "infant", "neonat", "adolescen"), "pregnancy/lactation": ("pregnan", "lactat", "breast"), "renal impairment": ("renal", "kidney", "ckd", "dialysis"), "hepatic impairment": ("hepatic", "liver", "cirrho"),
}


def may_hold(t: Column, *stems: str) -> Column:
    """Whether t holds any of some plain texts."""
    test = F.contains(t, F.lit(stems[0]))
    for x in stems[1:]:
        test = test | F.contains(t, F.lit(x))
    return test


def _headed(head: str):
    return lambda x: F.concat(F.lit(head), F.upper(x))


def mechanisms(t: Column) -> Column:
    """Terms as FAMILY:ISOFORM, the isoform in upper case, "*" for a mention of the family alone."""
    found, none = [], F.array().cast("array<string>")
    for family, (isoform, whole) in ISOFORMS.items():
        named = _headed(f"{family}:")
        found.append(F.when(may_hold(t, *STEMS[family]), F.transform(F.filter(every(t, isoform), lambda x: x != "450"), named)).otherwise(none))
        found.append(F.when(may_hold(t, *STEMS[family]) & holds(t, whole), F.array(F.lit(f"{family}:*"))).otherwise(none))
    for family, pattern in MECHANISMS.items():
        found.append(F.when(may_hold(t, *STEMS[family]) & holds(t, pattern), F.array(F.lit(f"{family}:*"))).otherwise(none))
    some = {x for f in (*ISOFORMS, *MECHANISMS) for x in STEMS[f]}
    return F.when(may_hold(t, *sorted(some)), F.array_distinct(F.flatten(F.array(*found)))).otherwise(none)


def unsupported(claimed: Column, had: Column) -> Column:
    """Claimed terms without support: any mention of the family supports "*", an isoform needs one of which either begins
    with the other."""

    def backed(c):
        family, isoform = F.substring_index(c, ":", 1), F.substring_index(c, ":", -1)
        same = lambda h: F.substring_index(h, ":", 1) == family
        other = lambda h: F.substring_index(h, ":", -1)
        exact = F.exists(had, lambda h: same(h) & (other(h) != "*") & (other(h).startswith(isoform) | isoform.startswith(other(h))))
        return F.when(isoform == "*", F.exists(had, same)).otherwise(exact)

    return F.filter(claimed, lambda c: ~backed(c))


def populations(t: Column) -> Column:
    return F.filter(F.array(*[F.when(may_hold(t, *STEMS[name]) & holds(t, p), name) for name, p in POPULATIONS.items()]), lambda x: x.isNotNull())


def alternation(terms: Column) -> Column:
    """One pattern for any of an array's terms, the longest first; of an empty array, a pattern that nothing matches."""
    longest = F.transform(F.array_sort(F.transform(F.filter(F.array_distinct(terms), lambda x: x != ""), lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda s: s.x)
    quoted = F.transform(longest, lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("")), F.lit("\\E")))
    return F.when(F.size(quoted) > 0, F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(")"))).otherwise("(?!)")


def bounded(pattern: Column) -> Column:
    return F.concat(F.lit("(?<![a-z0-9])("), pattern, F.lit(")(?![a-z0-9])"))


def mask(t: Column, terms: Column) -> Column:
    """t with every term blanked out, the longest first."""
    return F.regexp_replace(t, bounded(alternation(terms)), F.lit(" "))


def has_term(t: Column, term: Column) -> Column:
    return F.regexp_like(t, bounded(alternation(F.array(term))))


def spans_of(text: str, pattern: re.Pattern) -> list[str]:
    """Terms at all places of a text, without those inside a longer one."""
    found, end, at = [], 0, 0
    while m := pattern.search(text, at):
        if m.end() > end:
            found.append(m.group())
            end = m.end()
        at = m.start() + 1
    return found


@F.pandas_udf(ArrayType(StringType()))
def _events(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = [x for row in EVENTS for x in row]
    made: dict[tuple, re.Pattern] = {}
    for texts, more in parts:
        out = []
        for text, own in zip(texts, more):
            key = tuple(own)
            if key not in made:
                if len(made) > 4096:
                    made.clear()
                terms = sorted({*known, *key} - {*GENERIC_EVENTS, ""}, key=len, reverse=True)
                made[key] = re.compile("(?<![a-z0-9])(?:" + "|".join(map(re.escape, terms)) + ")(?![a-z0-9])")
            out.append(spans_of(text, made[key]))
        yield pd.Series(out, dtype=object)


def events(t: Column, more: Column) -> Column:
    """Event terms in t, of the lexicon and of `more`, in order; those inside a longer one are left out.

    A Pandas UDF: the places of matches, which nesting is decided by, have no expression in SQL.
    """
    return _events(t, more)


def groups_of(t: Column) -> Column:
    """Numbers of the rows of EVENTS that t names."""
    tests = [F.when(may_hold(t, *row) & t.rlike("(?<![a-z0-9])(?:" + "|".join(sorted(row, key=len, reverse=True)) + ")(?![a-z0-9])"), i) for i, row in enumerate(EVENTS)]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def event_supported(event: Column, support: Column, had: Column | None = None) -> Column:
    """Whether folded support names the event or, for each lexicon event in it, one that means the same. had: groups_of(support)."""
    inner = groups_of(event)
    return has_term(support, event) | ((F.size(inner) > 0) & (F.size(F.array_except(inner, groups_of(support) if had is None else had)) == 0))


def tiers(t: Column) -> Column:
    """Grades that a text claims; a bare word such as "minor" before an event is none."""
    none = F.array().cast("array<string>")
    named = F.when(may_hold(t, "major", "moderate", "minor"), F.transform(every(t, TIER_IN_CONTEXT, 3), F.initcap)).otherwise(none)
    ungraded = F.when(may_hold(t, "graded", "unknown") & holds(t, NOT_GRADED), F.array(F.lit("not graded"))).otherwise(none)
    return F.array_distinct(F.concat(named, ungraded))


def severity_words(t: Column) -> Column:
    return every(F.regexp_replace(t, ascii_bounds(SEVERITY_DENIED), " "), SEVERITY_WORDS, 0)


def says_safe(t: Column) -> Column:
    """The first wording that calls a combination safe, or null."""
    stems = (("safe",), ("interaction",), ("interact",), ("risk", "concern"), ("together",), ("compatible",))
    return F.coalesce(*[F.when(may_hold(t, *x) & holds(t, p), F.regexp_extract(t, ascii_bounds(p), 0)) for p, x in zip(SAFE, stems)])


def declares_absence(t: Column) -> Column:
    return holds(t, ABSENCE)
