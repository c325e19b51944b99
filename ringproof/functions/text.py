"""Text functions. Columns in, columns out; only Unicode decomposition and case folding need a vectorised helper."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Number and ordinal words, name suffixes, abbreviations whose dot ends no sentence.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
ORDINAL_WORDS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split()
SUFFIXES = r"jr\.?|sr\.?|ii|iii|iv"
ABBREVIATIONS = r"vs|Jr|Sr|Mr|St|No|Dr|def|Mt"
ORDINAL = "(?:" + "|".join(ORDINAL_WORDS) + r"|opening|1[0-5]th|1st|2nd|3rd|[4-9]th)"
NUMBER = "(?:" + "|".join(NUMBER_WORDS) + r"|1[0-5]|[1-9])"
NICKNAME = r"""(?:"[^"]{1,25}"\s+|'[^']{1,25}'\s+)?"""
NOT_A_PERSON = r"^The\b|\b(Guardian|Times|News|Sport|Sports|Boxing|ESPN|BBC|DAZN|Ring|Telegraph|Independent|Mirror|Post|Herald|Magazine|Journal|Network)\b"
FIGHT_RECORD = r"(?iU)\(\s*\d{1,3}-\d{1,3}(?:-\d{1,3})?(?:\s*,\s*\d{1,3}\s*(?:KOs?|knockouts))?\s*\)|\b\d{1,3} (?:KOs|knockouts|stoppages)\b"


def _bare(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; ASCII texts pass."""
    return texts.map(lambda t: None if t is None else _bare(t))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _bare(t).casefold())


def _unified(text: Column) -> Column:
    """One kind of quote, dash and space."""
    text = F.translate(text, "‘’“”–−  ​", "''\"\"--  ")
    return F.btrim(F.regexp_replace(F.replace(text, F.lit("—"), F.lit(" - ")), r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    return _unified(decomposed(F.coalesce(text, F.lit(""))))


def fold(text: Column) -> Column:
    return _unified(_folded(F.coalesce(text, F.lit(""))))


def normalise_name(name: Column) -> Column:
    """Key of the curated lookup: accents stay."""
    return F.btrim(F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), F.lit("jr."), F.lit("jr")), r"(?U)\s+", " "))


def parse_boxer(name: Column) -> Column:
    """struct<full, first, surname>, without trailing suffixes."""
    bare = F.btrim(F.regexp_replace(F.replace(normalize(name), F.lit('"'), F.lit("")), " +", " "))
    return boxer_of(bare, name)


def boxer_of(bare: Column, name: Column) -> Column:
    """As parse_boxer, of a name that is normalised already."""
    full = F.regexp_replace(bare, rf"(?i)( (?:{SUFFIXES}))+$", "")
    words = F.split(full, " ")
    return F.struct(
        F.when(full == "", name).otherwise(full).alias("full"),
        F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise(F.lit("")).alias("first"),
        F.element_at(words, -1).alias("surname"),
    )


def quoted(text: Column) -> Column:
    """Pattern characters escaped."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def boxer_pattern(boxer: Column, require_first: Column) -> Column:
    """A pattern column for a mention; the first name is needed where both surnames are alike."""
    last, first = quoted(boxer["surname"]), quoted(boxer["first"])
    led = F.concat(F.lit(r"\b"), first, F.lit(rf"\s+{NICKNAME}(?:[A-Z][a-z]+\s+)?"))
    alone = F.concat(F.lit(r"\b"), last, F.lit(r"\b"))
    return F.when(boxer["first"] == "", alone).when(require_first, F.concat(led, last, F.lit(r"\b"))).otherwise(F.concat(F.lit("(?:"), led, F.lit(")?"), alone))


def mention_patterns(a: Column, b: Column) -> tuple[Column, Column]:
    same = F.lower(a["surname"]) == F.lower(b["surname"])
    return boxer_pattern(a, same), boxer_pattern(b, same)


def matches(text: Column, pattern: Column, flags: str = "(?U)") -> Column:
    return F.regexp_like(text, F.concat(F.lit(flags), pattern))


def mentions_both(text: Column, pattern_a: Column, pattern_b: Column) -> Column:
    """In a normalised text, whatever the case."""
    return matches(text, pattern_a, "(?iU)") & matches(text, pattern_b, "(?iU)")


def split_sentences(text: Column) -> Column:
    whole = F.regexp_replace(text, rf"(?U)\b({ABBREVIATIONS})\.", "$1")
    return F.filter(F.transform(F.split(whole, r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"'(])"""), lambda s: F.btrim(s)), lambda s: s != "")


def strip_fight_records(text: Column) -> Column:
    return F.regexp_replace(text, FIGHT_RECORD, "")


def to_round(token: Column) -> Column:
    """1 to 15, or null."""
    words = F.create_map(*[F.lit(x) for i, (n, o) in enumerate(zip(NUMBER_WORDS, ORDINAL_WORDS), 1) for x in (n, i, o, i)], F.lit("opening"), F.lit(1))
    low = F.lower(token)
    value = F.coalesce(F.try_element_at(words, low), F.regexp_extract(low, r"^(\d{1,4})", 1).try_cast("int"))
    return F.when(value.between(1, 15), value)


def clean_name(name: Column, banned: list[Column]) -> Column:
    """A person's name without a possessive, or null: two words at least, no publication, no boxer's surname."""
    bare = F.regexp_replace(F.btrim(name), "'s?$", "")
    ok = (F.size(F.split(bare, r"(?U)\s+")) >= 2) & ~bare.rlike("(?U)" + NOT_A_PERSON)
    for b in banned:
        ok &= (b == "") | ~F.contains(F.lower(bare), F.lower(b))
    return F.when(ok, bare)
