"""Normalisers and predicates over text as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company-form suffixes, alias markers and words that are no entity by themselves.
LEGAL_FORMS = (
    "incorporated", "inc", "corporation", "corp", "company", "co", "llc", r"l\.?l\.?c", "llp", r"l\.?p", "lp", "ltd", "limited", "plc",
    "gmbh", "ag", r"n\.?\s*v\.?", "nv", r"s\.?\s*a\.?", "sa", r"s\.?p\.?a", "spa", r"n\.?\s*a\.?", "na", "pllc",
)
ALIAS_MARKERS = ("formerly known as", "doing business as", "also known as", r"f\s*/?\s*k\s*/?\s*a", r"d\s*/?\s*b\s*/?\s*a", r"a\s*/?\s*k\s*/?\s*a")
OVERBROAD = (
    "bank", "company", "co", "corporation", "corp", "trust", "group", "holdings", "holding", "services", "solutions", "systems",
    "technologies", "technology", "international", "enterprises", "industries", "communications", "networks", "media", "capital",
    "management", "ventures", "partners", "associates", "advisors", "advisory", "consulting", "worldwide", "global", "products",
)
PLACEHOLDER = r"<<|>>|_{2,}|\bxxx+\b|\benter\b|company name|\[\s*\]"
ENUMERATION = r"^\s*(?:\(?[\dA-Za-z]{1,4}\s*[.)]|\d+(?:\.\d+){0,3}\.?|§+)\s+"


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def surface_key(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one space."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def entity_key(name: Column) -> Column:
    """surface_key() of a name without alias clause, quotes, apostrophes and company forms, however many are stacked."""
    cut = F.btrim(F.regexp_replace(name, rf"(?is)\b(?:{'|'.join(ALIAS_MARKERS)})\b.*$", ""), F.lit(" ,;("))
    bare = F.lower(F.btrim(F.btrim(F.when(name.rlike(rf"(?i)\b(?:{'|'.join(ALIAS_MARKERS)})\b"), cut).otherwise(name)), F.lit("\"'()[]")))
    bare = F.regexp_replace(bare, "['’‘`]", "")
    return surface_key(F.btrim(F.regexp_replace(bare, rf"(?i)(?:[,.\s]+\b(?:{'|'.join(LEGAL_FORMS)})\b\.?[ ,.]*)+$", ""), F.lit(" ,.")))


def is_entity(name: Column, role_terms: tuple[str, ...] = (), role_phrases: tuple[str, ...] = ()) -> Column:
    """Not a placeholder, an over-broad word, a role term or a mention with a role phrase."""
    key = entity_key(name)
    ok = (F.btrim(F.btrim(name), F.lit("\"'()[]")) != "") & ~name.rlike(f"(?i){PLACEHOLDER}") & (key != "") & ~key.isin(*OVERBROAD, *role_terms)
    if role_phrases:
        import re

        ok = ok & ~name.rlike(rf"(?i)\b(?:{'|'.join(map(re.escape, role_phrases))})\b")
    return F.coalesce(ok, F.lit(False))


def is_bare_heading(text: Column) -> Column:
    """At most 60 characters, capitalised after an enumeration marker, without period, semicolon or colon."""
    t = F.btrim(F.regexp_replace(text, r"^(?U)\s+|\s+$", ""))
    rest = F.regexp_replace(t, f"(?U){ENUMERATION}", "")
    return (F.length(t) > 0) & (F.length(t) <= 60) & rest.rlike(r"^\p{Lu}") & ~rest.rlike("[.;:]")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_extractable(text: Column, furniture: tuple[str, ...] = ()) -> Column:
    """Six letters, no furniture label, no contents line; a line in capitals needs six words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return (letters(text) >= 6) & ~F.lower(F.btrim(text)).isin(*furniture, "") & ~text.rlike(r"\.{4,}\s*\d*\s*$") & (~capitals | (words >= 6))


def cue_pattern(cues: list[str]) -> str:
    """Word-bounded alternation, longest first, so that a cue wins over one it contains."""
    import re

    return rf"(?i)\b(?:{'|'.join(re.escape(c) for c in sorted(cues, key=lambda c: (-len(c), c)))})\b"


def cue_type(text: Column, cues: dict[str, str]) -> Column:
    """The type of the first cue in the text, null without one."""
    hit = F.lower(F.regexp_extract(text, f"({cue_pattern(list(cues))})", 1))
    pairs = [x for c, t in cues.items() for x in (F.lit(c.lower()), F.lit(t))]
    return F.element_at(F.create_map(*pairs), F.nullif(hit, F.lit("")))


def lenient_key(c: Column) -> Column:
    return F.btrim(F.lower(squash(c)), F.lit(" .,;:"))


def lenient_match(a: Column, b: Column) -> Column:
    """Either normalised text contains the other; empty ones match nothing."""
    x, y = lenient_key(a), lenient_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def squad_key(c: Column) -> Column:
    return squash(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def identifier_tokens(c: Column) -> Column:
    """Different tokens of four or more characters that hold a digit."""
    return F.array_sort(F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 4) & t.rlike("[0-9]"))))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4))


def cik(raw: Column) -> Column:
    """Ten digits, zero-padded; null if there is none or there are more."""
    digits = F.regexp_replace(F.regexp_replace(F.btrim(raw), "(?i)^cik[:#]?", ""), r"^\s+|\s+$", "")
    return F.when(digits.rlike("^[0-9]{1,10}$"), F.lpad(digits, 10, "0"))


def column_letters(index: Column) -> Column:
    """0 is A, 25 Z, 26 AA."""
    letter = lambda i: F.char(F.lit(65) + i)
    one, two, three = index < 26, index < 702, index < 18278
    two_of = F.concat(letter(F.floor(index / 26) - 1), letter(index % 26))
    i3 = index - 702
    three_of = F.concat(letter(F.floor(i3 / 676)), letter(F.floor(i3 / 26) % 26), letter(i3 % 26))
    return F.when(one, letter(index)).when(two, two_of).when(three, three_of)


def natural_key(name: Column) -> Column:
    """Sort key in which numbers compare by value: digits padded to twenty places."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def label_verdict(raw: Column, known: tuple[str, ...], default: str) -> Column:
    """Lower case, hyphens and spaces as underscores; what isn't known becomes the default."""
    v = F.regexp_replace(F.lower(F.btrim(raw)), "[- ]", "_")
    return F.when(v.isin(*known), v).otherwise(default)
