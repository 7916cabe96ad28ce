"""Codes written out as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results of sensitivity tests. Fixed values.
INTERPRETATIONS = {"S": "sensitive", "R": "resistant", "I": "intermediate", "P": "pending", "none": "none"}
#: Hospital services. Fixed values.
SERVICES = {
    "CMED": "Cardiac Medical",
    "CSURG": "Cardiac Surgical",
    "DENT": "Dental",
    "ENT": "Ear, Nose, Throat",
    "EYE": "Eye diseases",
    "GU": "Genitourinary",
    "GYN": "Gynecological",
    "MED": "Medical",
    "NB": "Newborn",
    "NBB": "Newborn",
    "NMED": "Neurologic Medical",
    "NSURG": "Neurologic Surgical",
    "OBS": "Obstetrics",
    "ORTHO": "Orthopedic",
    "OMED": "Orthopedic Medical",
    "PSURG": "Plastic Surgical",
    "PSYCH": "Psychiatric",
    "SURG": "Surgery",
    "TRAUM": "Trauma",
    "TSURG": "Thoracic Surgical",
    "VSURG": "Vascular Surgical",
}


def in_words(code: Column, words: dict[str, str], keep: bool = False) -> Column:
    """The word for a code; an unknown code gives null, or itself if ``keep``."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), code)
    return F.coalesce(known, code) if keep else known
