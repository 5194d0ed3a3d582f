"""Jurisdictions: surface forms to one canonical place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of places with their canonical form, surfaces that name none, affixes that are cut.
STATES = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine "
    "maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada new_hampshire new_jersey new_mexico new_york north_carolina north_dakota "
    "ohio oklahoma oregon pennsylvania rhode_island south_carolina south_dakota tennessee texas utah vermont virginia washington west_virginia wisconsin wyoming"
).split()
COUNTRIES = {
    "england": "england", "english": "england", "england and wales": "england", "united kingdom": "england", "uk": "england", "great britain": "england", "britain": "england",
    "scotland": "scotland", "wales": "wales", "northern ireland": "northern_ireland", "china": "china", "prc": "china", "people's republic of china": "china",
    "united states": "united_states", "united states of america": "united_states", "usa": "united_states", "u.s.a.": "united_states", "us": "united_states", "canada": "canada",
    "british columbia": "british_columbia", "ontario": "ontario", "belgium": "belgium", "germany": "germany", "france": "france", "japan": "japan", "spain": "spain", "italy": "italy",
    "italian": "italy", "south africa": "south_africa", "israel": "israel", "taiwan": "taiwan", "netherlands": "netherlands", "switzerland": "switzerland",
    "australia": "australia", "singapore": "singapore", "hong kong": "hong_kong", "ireland": "ireland",
}
NO_PLACE = (
    r"applicable\s+law|governing\s+law|not\s+specified|not\s+explicitly|unspecified|none\s+specified|^none$|^other$|best's|exhibit|section\b|bankruptcy\s+code|any\s+jurisdiction"
    r"|jurisdiction\s+governing|franchised\s+restaurant|^territory$|^union$|^worldwide$|\*|\[|last\s+sentence|internal\s+laws"
)
BEFORE = ("the state of ", "state of ", "the commonwealth of ", "commonwealth of ", "the province of ", "province of ", "the ")
AFTER = (", u.s.a.", ", usa", ", united states of america", ", united states", " (u.s.a.)", " (usa)", " and its territories")


def jurisdiction(surface: Column) -> Column:
    """The canonical place: by the whole name, else by the one place that is named in it as whole words (a state wins over
    the federal union); null for what names none or several."""
    names = {s.replace("_", " "): s for s in STATES} | COUNTRIES
    t = F.btrim(F.regexp_replace(F.lower(surface), r"\s+", " "))
    t = F.regexp_replace(t, f"^(?:{'|'.join(map(re.escape, BEFORE))})", "")
    for x in AFTER:
        t = F.replace(t, F.lit(x), F.lit(""))
    t = F.btrim(F.regexp_replace(t, r"\s+(?:law|laws|courts|court|state)$", ""))
    whole = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), t)
    hit = F.array_compact(F.array(*(F.when(t.rlike(rf"\b(?:{'|'.join(re.escape(a) for a in sorted(k for k, v in names.items() if v == place))})\b"), F.lit(place)) for place in sorted(set(names.values())))))
    several = F.when(F.size(hit) > 1, F.array_remove(hit, "united_states")).otherwise(hit)
    found = F.coalesce(whole, F.when(F.size(several) == 1, F.get(several, F.lit(0))))
    return F.when(surface.isNotNull() & (surface != "") & ~surface.rlike(f"(?i){NO_PLACE}"), found)
