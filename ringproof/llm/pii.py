"""Personal data with offset-preserving deobfuscation.

Base: four patterns over the whole text as it is. Added: transducers rewrite disguises and keep, for every character
of the rewritten text, the stretch of the source it stands for; the same patterns run over the rewritten text, and what
they find is mapped back to source characters. Four transducers, each over the output of the one before:

1. characters: compatibility forms (full-width, circled, mathematical; by the Unicode compatibility decomposition) and
   Cyrillic and Greek look-alikes become ASCII; invisible characters go;
2. white space: a run of three or more becomes two of its kind, which no pattern tells from it, so that the patterns of
   the next two take linear time; this is no disguise;
3. spelled digits ("five", "fünf", "cinq", "cinco", "double two") in runs become digits, "plus" before them `+`;
4. "at" and "dot" in brackets, or as words between the parts of an address, become `@` and `.`.

An added span counts only if its source holds a disguise and it either touches no base span or strictly contains every
one that it touches (these stay base spans, too). Texts without any trigger take no transducer; triggers are looser than
the transducers. Whole texts are read.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; rows that repeat a doc_id
keep a row each.
"""
from __future__ import annotations

import bisect
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
# Runs are taken whole, with or without what makes them a span (group 1), so that a long run is read once.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Letters of other scripts that look like ASCII ones, in the order of the letters below them.
_LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏԛԝьвкмнтАВЕКМНОРСТУХІЈЅԌԚԜοαενιρτυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧı․‐‑‒–—−﹣＋",
    "aeopcyxijsdhlqwbbkmhtABEKMHOPCTYXIJSGQWoaevipturxABEZHIKMNOPTYXi.------" + "-+",
)
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x200E, 0x200F])
#: Digit names of four languages.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3, "doppel": 2}
#: A run that spells fewer digits stays as it is: a few number words in a row are prose.
LEAST_RUN = 4
#: And so does one of fewer different digits: a repeated word.
LEAST_KINDS = 3
_ONE = r"(?:(?:double|triple|doppel)[\s-]+)?(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r"|[0-9])"
_RUN = re.compile(rf"(?<![\w])(?:plus[\s-]+)?{_ONE}(?:[\s,.·/-]+{_ONE})+(?!\w)", re.I)
_SPELLED = re.compile(r"\w+", re.I)
_AT_WORD = "(?:at|arroba|arobase|klammeraffe)"
_AT = rf"(?:[\[({{<]\s*(?:at|@|ät|arroba|arobase)\s*[\])}}>]|\s+{_AT_WORD}\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+)"
#: A word for at is no part of an address, but where another at comes next.
_PART = rf"(?!{_AT_WORD}\s(?!\s?(?:{_AT_WORD}\s|[\[({{<@])))[A-Za-z0-9_%+-]++"
#: An address whose separators are disguised: local part, at, two labels or more. A plain "at" needs a disguised dot. A run
#: of words and dots is taken whole, with or without what makes it an address, so that a long one is read once.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?P<local>[A-Za-z0-9_%+-]++(?:(?:\.|{_DOT}){_PART})*+)(?:(?P<at>\s*{_AT}\s*|\s*@\s*)(?P<host>[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++))?", re.I)
#: What the transducers need at least: an at or a dot in brackets, an @ beside white space.
_SIGNS = re.compile(r"[\[({<]\s*(?:at|@|ät|arroba|arobase|dot|\.|punkt|punto|point)\s*[\])}>]|\s@|@\s", re.I)
_DISGUISED_DOT = re.compile(_DOT, re.I)
_NUMBERED = re.compile(rf"(?<![0-9])[0-9]++(?:{_DOT}[0-9]+){{3}}", re.I)
#: Words that no address has right after a plain "at".
_NO_HOST = frozenset("the a an this that these those my our your his her its their".split())
_DOTS = frozenset((b"dot", b"punkt", b"punto", b"point"))
#: The words that are digits or repeat one, as bytes of UTF-8, and how many digits each adds.
_WORTH = {w.encode(): 1 for w in _DIGITS} | {w.encode(): n - 1 for w, n in _TIMES.items()}
#: Bytes: A-Z lower-cased, and what isn't a letter, a digit, an underscore or beyond ASCII made a space.
_TOKENS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or i == 95 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: White space and the middle dot beyond ASCII, which part words as well.
_PARTS = re.compile(r"[·\s]")
_BLANKS = re.compile(r"\s{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def find(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end), by kind as listed and start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text) if m[1]]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if m[1] and _octets(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class Mapped:
    """A text with, for each character, where its source starts and ends, and whether it is rewritten."""

    def __init__(self, text: str, start: list[int], end: list[int], changed: list[bool]):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def rewrite(self, edits: list[tuple[int, int, str]], disguise: bool = True) -> Mapped:
        """edits: (start, end, new), ascending and apart; every new character stands for the whole stretch, and counts as rewritten if it was a disguise."""
        if not edits:
            return self
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + [disguise] * len(new)
            at = b
        return Mapped("".join(text) + self.text[at:], start + self.start[at:], end + self.end[at:], changed + self.changed[at:])


def _ascii_of(c: str) -> str | None:
    """What a character stands for; None: itself."""
    if (new := c.translate(_LOOK_ALIKES)) != c:
        return new
    if ord(c) in _INVISIBLE:
        return ""
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide != c and wide.isascii() and len(wide) <= 3 and not wide.isspace() else None


def characters(text: Mapped) -> Mapped:
    known = {c: _ascii_of(c) for c in set(text.text) if c > "\x7f"}
    if not any(new is not None for new in known.values()):
        return text
    return text.rewrite([(i, i + 1, new) for i, c in enumerate(text.text) if c > "\x7f" and (new := known[c]) is not None])


def white_space(text: Mapped) -> Mapped:
    """Long runs shortened: to spaces if they are of spaces only, else to line ends, which end a number."""
    return text.rewrite([(*m.span(), "\n\n" if m[0].strip(" ") else "  ") for m in _BLANKS.finditer(text.text)], disguise=False)


def spelled_digits(text: Mapped) -> Mapped:
    edits = []
    for m in _RUN.finditer(text.text):
        digits, times, spelled = "", 1, 0
        for w in _SPELLED.findall(m[0].lower()):
            if w in _TIMES:
                times = _TIMES[w]
            elif w != "plus":
                digits += _DIGITS.get(w, w) * times
                times, spelled = 1, spelled + times * (w in _DIGITS)
        if spelled >= LEAST_RUN and len(set(digits)) >= LEAST_KINDS:
            edits.append((*m.span(), "+" * m[0].lower().startswith("plus") + digits))
    return text.rewrite(edits)


def separators(text: Mapped) -> Mapped:
    edits = []
    for m in _ADDRESS.finditer(text.text):
        if m["at"] is None:
            continue  # a run of words without an address
        plain_at = re.fullmatch(r"\s+\w+\s+", m["at"]) is not None
        dots = [d.span() for d in _DISGUISED_DOT.finditer(text.text, *m.span("host"))]
        own = [d.span() for d in _DISGUISED_DOT.finditer(text.text, *m.span("local"))]
        if plain_at and (not dots or re.split(r"[^a-z0-9]", m["host"].lower())[0] in _NO_HOST) or m["at"] == "@" and not dots and not own:
            continue  # prose, or a plain address
        edits += [(*d, ".") for d in own] + [(*m.span("at"), "@")] * (m["at"] != "@") + [(*d, ".") for d in dots]
    taken = {i for a, b, _ in edits for i in range(a, b)}
    for m in _NUMBERED.finditer(text.text):
        edits += [(*d.span(), ".") for d in _DISGUISED_DOT.finditer(text.text, *m.span()) if d.start() not in taken]
    return text.rewrite(sorted(edits))


def _triggers(text: str) -> bool:
    if not text.isascii() and any(_ascii_of(c) is not None for c in set(text) if c > "\x7f"):
        return True
    if any(c in text for c in "@[({<") and _SIGNS.search(text):
        return True
    if not text.isascii():
        text = _PARTS.sub(" ", text).lower()
    tokens = text.encode("utf-8", "surrogatepass").translate(_TOKENS).split()
    return not _DOTS.isdisjoint(tokens) or sum(_WORTH[t] for t in tokens if t in _WORTH) >= LEAST_RUN


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans; added spans)."""
    if not text:
        return [], []
    base = find(text)
    if not _triggers(text):
        return base, []
    plain = separators(spelled_digits(white_space(characters(Mapped.of(text)))))
    found = [(kind, a, b) for kind, a, b in find(plain.text) if any(plain.changed[a:b])]
    # A number that is spelled out whole is a phone number without its plus, too.
    at = {i for _, a, b in found for i in range(a, b)}
    for m in re.finditer(r"[0-9]{10,15}", plain.text):
        if all(plain.changed[slice(*m.span())]) and plain.end[m.start()] - plain.start[m.start()] > 15 and m.start() not in at:
            found.append(("phone", *m.span()))
    added, taken = [], bytearray(len(text))
    of_kind = [([x for k, x, _ in base if k == kind], [y for k, _, y in base if k == kind]) for kind in KINDS]
    for kind, a, b in found:
        s, e = plain.start[a], plain.end[b - 1]
        touched = []
        for starts, ends in of_kind:  # in order and apart, so those that touch are neighbours
            near = slice(bisect.bisect_right(ends, s), bisect.bisect_left(starts, e))
            touched += zip(starts[near], ends[near])
        if all(s <= x and y <= e and (s, e) != (x, y) for x, y in touched) and taken.find(1, s, e) < 0:
            taken[s:e] = b"\1" * (e - s)
            added.append((kind, s, e))
    return base, sorted(added, key=lambda x: (KINDS.index(x[0]), x[1]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1])))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and added (array of kind, start, end). A row for each row of docs."""

    def make():
        def run(rows):
            found = [spans(t) for t in rows["text"]]
            as_rows = lambda xs: [{"kind": k, "start": a, "end": b} for k, a, b in xs]
            return {"id": rows["id"], "base": [as_rows(f[0]) for f in found], "added": [as_rows(f[1]) for f in found]}

        return run

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, f"id long, base {span}, added {span}")


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    in_order = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = lambda c: F.array_join(F.transform(in_order(c), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
