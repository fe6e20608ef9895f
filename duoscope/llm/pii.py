"""Personal data in texts, plain or disguised, with offsets in the source.

Plain identifiers are found by four patterns. Disguised ones are found on a normalised text: transducers rewrite
look-alike characters, digits spelled as words (English, French, German, Spanish; in English also numbers up to 99 and
``double`` or ``triple`` before a digit), bracketed, spelled or underscored ``at`` and ``dot``, and addresses with a blank
after each character; every rewritten stretch remembers where it stood, and a span of the normalised text is mapped back to
the source characters that it came from. A mapped span is added when it holds a rewritten stretch and covers a character
that no plain span covers; plain spans always stay. Where at and dot are plain words, the last label must be a country's
(two letters) or one of the common ones below, so that prose is left alone.

Credentials (access keys, tokens, private key blocks, values given to a name such as password) are found beside these, in
a list of their own.

Offsets are code points, the end exclusive. A null text counts as empty. Rows are independent.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

from .common import col, give_back, same_rows

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behinds skip only places at which the pattern without them would fail or is inside an earlier match;
# with them a long run of digits takes linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def run_before(text: str, end: int, least: int) -> int:
    """Where the run of characters of a local part that ends at end begins."""
    at = end
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each plain identifier, kind by its place in KINDS; leftmost, non-overlapping in a kind."""
    found, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = run_before(text, m.start(), last)
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "。": ".", "․": ".", "｡": ".", "﹒": ".", "﹫": "@",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "", "‎": "", "‏": "",
}
# Digits as words.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# English numbers above nine, and words that repeat the digit after them.
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 2, "thirty": 3, "forty": 4, "fifty": 5, "sixty": 6, "seventy": 7, "eighty": 8, "ninety": 9}
TIMES = {"double": 2, "triple": 3}
AT, DOT = r"at|arroba|arobase|chez", r"dot|punkt|point|punto"
# Common last labels of more than two letters.
LABELS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|site|shop|tech|blog|mail|example|test"
# Forms of credentials.
KEYS = {
    "access_key": (("AKIA", "ASIA"), r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "token": (("ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk_live_"), r"(?<![0-9A-Za-z])(?:gh[pos]_[0-9A-Za-z]{36}|xox[bp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})"),
    "private_key": (("PRIVATE KEY-----",), r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]|-(?!----END))*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
}
NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}\Z", re.I)
VALUE = re.compile(r"[=:][ \t]{0,4}([\"']?)([^\s\"',;]{8,})\1")


def look_alikes() -> dict[str, str]:
    """The letters above, and every character whose compatibility form or decimal value is one ASCII character."""
    table = dict(LOOK_ALIKE)
    for c in map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x20000)]):
        form = unicodedata.normalize("NFKC", c)
        if c not in table and len(form) == 1 and form.isascii() and form.isprintable():
            table[c] = form
        elif unicodedata.decimal(c, -1) >= 0:
            table[c] = str(unicodedata.decimal(c))
    table[" "] = " "
    return table


def digits_of(words: list[str]) -> str:
    """The digits that a row of number words and digits says; a dot for a dot."""
    out, k = [], 0
    while k < len(words):
        w = words[k].lower()
        follows = SPELLED.get(words[k + 1].lower(), 0) if k + 1 < len(words) else 0
        if w.isdigit():
            out.append(w)
        elif w in TIMES:
            k += 1
            if k < len(words):
                out.append(digits_of(words[k : k + 1]) * TIMES[w])
        elif w in TENS and follows:
            out.append(f"{TENS[w]}{follows}")
            k += 1
        else:
            out.append(str(SPELLED[w]) if w in SPELLED else str(TEENS[w]) if w in TEENS else f"{TENS[w]}0" if w in TENS else ".")
        k += 1
    return "".join(out)


def secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each credential, none overlapping another."""
    found = []
    for kind, (marks, pattern) in KEYS.items():
        if any(x in text for x in marks):
            found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text)]
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            value = NAMED.search(text, max(0, at - 24), at) and VALUE.match(text, at)
            if value:
                found.append((value.start(2), "named", value.end(2)))
            at = text.find(sign, at + 1)
    kept: list[tuple[int, str, int]] = []
    for x in sorted(found):
        if not kept or x[0] >= kept[-1][2]:
            kept.append(x)
    return kept


class Transducers:
    """The rewriting rules, compiled once for each worker."""

    def __init__(self):
        self.table = look_alikes()
        self.odd = self.table.keys()
        word = "|".join(sorted([*SPELLED, *TEENS, *TENS, *TIMES], key=len, reverse=True))
        some = rf"(?:{word}|[0-9]+)"
        gap = r"(?:[ \t,-]{1,3})"
        self.spelled = re.compile(rf"(?:{word})(?!\w)(?:{gap}(?:(?:{DOT}){gap})?{some}(?!\w)){{3,}}+")
        self.token = re.compile(rf"{word}|[0-9]+|{DOT}", re.I)
        self.bracketed = re.compile(rf"[\[({{<]\s*(?:({AT}|@)|{DOT}|\.)\s*[\])}}>]", re.I)
        self.domain = re.compile(rf"[A-Za-z0-9-]++(?:(?:[ ]+(?:{DOT})[ ]+|\.|\s*[\[({{<]\s*(?:{DOT}|\.)\s*[\])}}>]\s*)[A-Za-z0-9-]++)+", re.I)
        self.dots = re.compile(rf"[ ]+(?:{DOT})[ ]+", re.I)
        self.dot_before = re.compile(rf"[ ](?:{DOT})[ ]\Z", re.I)
        self.bare_at = re.compile(rf"[ ](?:{AT})[ ]", re.I)
        self.label = re.compile(rf"(?:[a-z]{{2}}|{LABELS})(?![A-Za-z0-9-])", re.I)
        self.joined_at = re.compile(r"[_-]at[_-]", re.I)
        self.joined = re.compile(r"[A-Za-z0-9]+(?:(?:[_-]dot[_-]|[.-])[A-Za-z0-9]+)*", re.I)
        self.joined_dot = re.compile(r"[_-]dot[_-]", re.I)
        self.spaced = re.compile(r"(?<!\S)[A-Za-z0-9](?: [A-Za-z0-9._%+-])* @(?: [A-Za-z0-9-])+ \.(?: [A-Za-z0-9.-])* [A-Za-z0-9-](?!\S)")
        self.known = frozenset([*SPELLED, *TEENS, *TENS])

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, replacement) of each rewritten stretch, in order, none overlapping another."""
        found = []
        if not text.isascii():
            if odd := self.odd & set(text):
                found += [(m.start(), m.end(), self.table[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)]
        for m in self.bracketed.finditer(text):
            s, e = m.span()
            while s and text[s - 1] in " \t":
                s -= 1
            while e < len(text) and text[e] in " \t":
                e += 1
            found.append((s, e, "@" if m[1] else "."))
        low = text.lower()
        if len(low) != len(text):  # a few capitals become two characters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spelled = () if self.known.isdisjoint(low.replace(",", " ").replace("-", " ").split()) else self.spelled.finditer(low)
        for m in spelled:
            s = m.start()
            if s and text[s - 1].isalnum():
                continue
            words = self.token.findall(m[0])
            if all(w.isdigit() for w in words):
                continue
            first = self.sign_before(text, s)
            found.append((s if first is None else first, m.end(), ("" if first is None else "+") + digits_of(words)))
        if " @ " in text:
            found += [(m.start(), m.end(), m[0].replace(" ", "")) for m in self.spaced.finditer(text)]
        for m in self.joined_at.finditer(text):
            d, start = self.joined.match(text, m.end()), run_before(text, m.start(), 0)
            dots = [x for x in self.joined_dot.finditer(text, m.end(), d.end())] if d else []
            # the last label begins after the last written or spelled dot
            last = max([x.end() for x in dots] + [text.rfind(".", m.end(), d.end()) + 1]) if d else 0
            if last > m.end() and start < m.start() and self.label.fullmatch(text, last, d.end()):
                found += [(x.start(), x.end(), ".") for x in self.joined_dot.finditer(text, start, m.start())]
                found += [(m.start(), m.end(), "@")] + [(x.start(), x.end(), ".") for x in dots]
        for m in self.bare_at.finditer(text):
            d = self.domain.match(text, m.end())
            if not d:
                continue
            start = run_before(text, m.start(), 0)
            if start == m.start():
                continue
            more = [(m.start(), m.end(), "@")] + [(x.start(), x.end(), ".") for x in self.dots.finditer(text, d.start(), d.end())]
            local = text[start : m.start()]
            while b := self.dot_before.search(text, max(0, start - 8), start):
                before = run_before(text, b.start(), 0)
                if before == b.start():
                    break
                more.append((b.start(), b.end(), "."))
                start = before
            # a plain "at" before a plain domain is prose, unless the name before it is built like an address
            dotted = any(c == "." for _, _, c in more) or not d[0].replace(".", "").replace("-", "").isalnum()
            if any(c in "0123456789._%+-" for c in local.strip(".-")) or dotted and self.ends_in_label(text, d):
                found += more
        found.sort(key=lambda x: (x[0], -x[1]))
        kept, end = [], 0
        for e in found:
            if e[0] >= end:
                kept.append(e)
                end = e[1]
        return kept

    def sign_before(self, text: str, at: int) -> int | None:
        """Where a plus sign, written or spelled, begins whose number begins at at."""
        gap = at
        while gap and text[gap - 1] in " \t":
            gap -= 1
        if gap and text[gap - 1] == "+":
            return gap - 1
        spelled = gap < at and text[max(0, gap - 4) : gap].lower() == "plus" and not text[max(0, gap - 5) : gap - 4].isalnum()
        return gap - 4 if spelled else None

    def ends_in_label(self, text: str, domain: re.Match) -> bool:
        """Whether a domain's last label, or the last that a spelled or bracketed dot leads to, can be one."""
        parts = re.split(r"[^A-Za-z0-9-]+", domain[0])
        return bool(self.label.fullmatch(parts[-1]))

    def disguised(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        edits = self.edits(text)
        if not edits:
            return []
        parts, norm_at, source_at, source_end, edited = [], [], [], [], []
        size = done = 0
        for s, e, new in [*edits, (len(text), len(text), "")]:
            for a, b, piece, is_edit in ((done, s, text[done:s], False), (s, e, new, True)):
                if piece:
                    parts.append(piece)
                    norm_at.append(size)
                    source_at.append(a)
                    source_end.append(b)
                    edited.append(is_edit)
                    size += len(piece)
            done = e
        cuts = [e[0] for e in edits]
        found = []
        for start, kind, end in plain("".join(parts)):
            i, j = bisect_right(norm_at, start) - 1, bisect_right(norm_at, end - 1) - 1
            s = source_at[i] if edited[i] else source_at[i] + start - norm_at[i]
            e = source_end[j] if edited[j] else source_at[j] + end - norm_at[j]
            k = bisect_right(cuts, e - 1)
            if k and edits[k - 1][1] > s and uncovered(s, e, known):
                found.append((s, kind, e))
        return found


def uncovered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether a character of start:end lies in none of the spans, which are in order of their starts."""
    for s, _, e in spans:
        if s > start:
            return True
        start = max(start, e)
        if start >= end:
            return False
    return start < end


RULES: list[Transducers] = []


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans, both in order of start, then kind."""
    if not RULES:
        RULES.append(Transducers())
    base = plain(text)
    return base, sorted(base + RULES[0].disguised(text, base))


def redact(text: str, spans: list[tuple[int, int, int]], hidden: list[tuple[int, str, int]] = []) -> str:
    """text with each stretch of overlapping spans replaced by the name of its first kind, SECRET for a credential."""
    spans = sorted([*spans, *((s, len(KINDS), e) for s, _, e in hidden)])
    out, done = [], 0
    for s, kind, e in spans:
        if s >= done:
            out += [text[done:s], f"<{(*KINDS, 'secret')[kind].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def detect(df: DataFrame, text: str = "text", out: str = "pii", redacted: bool = False) -> DataFrame:
    """df and a struct column out: base, spans and secrets (arrays of kind, start, end), and with redacted the text with
    every span and secret replaced by its kind (null for a null text). Every other column stays."""

    @arrow_udf(f"struct<base:{SPAN},spans:{SPAN},secrets:{SPAN}" + (",redacted:string>" if redacted else ">"))
    def spans_of(texts: pa.Array) -> pa.Array:
        give_back()
        cols = {"base": [], "spans": [], "secrets": []}
        clean = []
        for t in texts:
            t = t.as_py()
            both, hidden = find(t or ""), secrets(t or "")
            for name, spans in zip(cols, both):
                cols[name].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            cols["secrets"].append([{"kind": k, "start": s, "end": e} for s, k, e in hidden])
            if redacted:
                clean.append(redact(t, both[1], hidden) if both[1] or hidden else t)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        arrays = [pa.array(c, kind) for c in cols.values()] + ([pa.array(clean, pa.string())] if redacted else [])
        return pa.StructArray.from_arrays(arrays, names=[*cols, *(["redacted"] if redacted else [])])

    return same_rows(df, out, lambda: spans_of(col(text)))
