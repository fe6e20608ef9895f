"""Text expressions; all stay in the JVM. Null rules are stated with each function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# British spellings and dashes, and what they are folded to, in this order.
FOLDS = (
    ("haem", "hem"),
    ("aemia", "emia"),
    ("(?<![a-z])oedema|(?<=o)oedema|(?<=ph)oedema|(?<=x)oedema", "edema"),
    ("(?<![a-z])oesophag|(?<=o)oesophag", "esophag"),
    ("paediatr", "pediatr"),
    ("normalised", "normalized"),
    ("–", "-"),
    ("—", "-"),
)


def clean(c: Column) -> Column:
    """Lower case without white space at the ends; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))


def squeeze(c: Column) -> Column:
    """Runs of spaces become one; null stays null."""
    return F.regexp_replace(c, " {2,}", " ")


def fold(c: Column) -> Column:
    """Lower case, spellings and dashes folded, white space squeezed; folding twice changes nothing. Null is empty."""
    c = F.lower(F.coalesce(c, F.lit("")))
    for old, new in FOLDS:
        c = F.regexp_replace(c, old, new) if "(" in old else F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def phrase(c: Column, words: str) -> Column:
    """Whether the folded text c holds words with no letter or digit right before or after."""
    return c.rlike(f"(^|[^a-z0-9]){words}([^a-z0-9]|$)")


def tier(score: Column, moderate: float = 4.0, major: float = 10.0) -> Column:
    """Major from `major` on, Moderate from `moderate` on, else Minor; null or NaN is Unknown."""
    return F.when(score.isNull() | F.isnan(score), "Unknown").when(score >= major, "Major").when(score >= moderate, "Moderate").otherwise("Minor")


def severity_rank(c: Column) -> Column:
    """0 to 3 from the most severe grade to an unknown one."""
    return F.when(c == "Major", 0).when(c == "Moderate", 1).when(c == "Minor", 2).otherwise(3)


def number(c: Column) -> Column:
    """A double, null for text that is none and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def input_problem(c: Column, longest: int = 150) -> Column:
    """Why a name is refused (control character, empty, too long, or a character that names don't have), or null."""
    bare = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return (
        F.when(F.coalesce(c, F.lit("")).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control")
        .when(bare == "", "empty")
        .when(F.char_length(bare) > longest, "too_long")
        .when(~bare.rlike(r"^[\p{L}\p{N} .,'()+/%#-]+$"), "charset")
    )


def split_input(c: Column) -> Column:
    """Names of one request: its lines where it has several, else its parts between commas; blank ones left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda x: x != "")
    return F.when(F.size(lines) > 1, lines).otherwise(parts)


def chars(c: Column) -> Column:
    """The characters of a text (code points, not UTF-16 units); none of an empty one."""
    n = F.char_length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(1))))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row, also where use needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Longest text whose places fit into the bits of a long, with room for a carry.
WORD = 62


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, the first of at most WORD characters.

    One bit a place of a: v starts with all bits set, and a bit goes for each place that the subsequence has used. With m
    the places of a character of b in a and u = v & m, the next v is (v + u) | (v - u), so a character costs one step.
    """
    places = lambda xs: F.map_from_entries(F.transform(F.array_distinct(xs), lambda x: F.struct(x, F.aggregate(F.transform(xs, lambda y, i: F.when(x == y, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, y: s + y))))
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.char_length(a)) - 1

    def step(at):
        def one(v, y):
            u = v.bitwiseAND(F.coalesce(F.try_element_at(at, y), F.lit(0).cast("bigint")))
            return (v + u).bitwiseOR(v - u).bitwiseAND(full)

        return one

    left = let(let(chars(a), places), lambda at: F.aggregate(chars(b), full, step(at)))
    return F.char_length(a) - F.bit_count(left)


def common_length_folded(a: Column, b: Column) -> Column:
    """The same for texts of any length: a row of the table of common lengths is folded along a for each character of b."""
    left = chars(a)
    zero = F.transform(F.sequence(F.lit(0), F.char_length(a)), lambda _: F.lit(0))

    def row(last, y):
        def cell(acc, x):
            i = F.size(acc)
            up, diagonal = F.element_at(last, i + 1), F.element_at(last, i)
            return F.concat(acc, F.array(F.when(x == y, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1)))))

        return F.aggregate(left, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars(b), zero, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / (length a + length b), 100 for two empty texts; code points are compared."""
    short = F.char_length(a) <= WORD
    common = F.when(short, common_length(F.when(short, a).otherwise(""), b)).otherwise(common_length_folded(a, b))
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common / total)


def grams(c: Column, q: int) -> Column:
    """Parts of q characters of a text, each with the number of its occurrence; with q = 2 the ends count as characters.

    Two texts have as many of these in common as their multisets of parts.
    """
    padded = c if q == 1 else F.concat(F.lit("\x02"), c, F.lit("\x03"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (q - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(q)))
    return let(parts, lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == x)).cast("string"))))


def request_url(base: str, parameters: dict[str, Column]) -> Column:
    """base with the parameters that are not null, encoded as in a form."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in parameters.items()]
    return F.concat(F.lit(f"{base}?"), F.array_join(F.array_compact(F.array(*pairs)), "&"))


def override(base: Column, over: Column) -> Column:
    """A map with the entries of another put over its own; a null map has none."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def age_days(stamped: Column, today: Column) -> Column:
    """Days since an ISO date; null where it is none."""
    return F.datediff(today, stamped.try_cast("date"))


def json_in(text: Column) -> Column:
    """The JSON object in a text, as a variant: from the first brace to the last. Null where there is none or it is broken.

    Spark's parser stops after the first value; inside brackets it has to read on, and a second value is seen."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    whole = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    return F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))


def verdict_in(text: Column, verdicts: tuple[str, ...]) -> Column:
    """struct<verdict, rationale> that an answer in prose gives as JSON; null where it gives none of the verdicts."""
    part = lambda name: F.trim(F.coalesce(F.try_variant_get(json_in(text), f"$.{name}", "string"), F.lit("")))
    said = F.lower(part("verdict"))
    return F.when(said.isin(*verdicts), F.struct(said.alias("verdict"), part("rationale").alias("rationale")))
