"""Notations of language labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter codes and the public ISO 639 codes and names that stand for them.
NOTATIONS = {
    "en": ["en", "eng", "english", "anglais", "englisch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch"],
    "it": ["it", "ita", "italian", "italiano", "italien", "italienisch"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch"],
}


def label_code(label: Column) -> Column:
    """The two-letter code a label names, whatever its notation; null for none, a placeholder or an unknown one."""
    bare = F.lower(F.trim(label))
    head = F.when(bare.rlike(r"^[a-z]{2,3}[-_].*"), F.regexp_extract(bare, r"^([a-z]{2,3})[-_]", 1)).otherwise(bare)
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(head.isin(names), F.lit(code)).otherwise(out)
    return out
