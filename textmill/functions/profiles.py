"""Settings of text extraction for kinds of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ["offset", "margin", "em", "space", "adaptive", "emails", "citations"]
#: Threshold of offsets (thousandths of an em), ratios of word margin, em and space width; whether thresholds adapt, and e-mails and citations are looked for. Fixed values.
PROFILES = {
    "conservative": (-120.0, 0.1, 0.25, 0.5, False, False, False),
    "heavy": (-100.0, 0.1, 0.25, 0.5, False, False, False),
    "aggressive": (-80.0, 0.2, 0.15, 0.8, False, False, False),
    "balanced": (-100.0, 0.15, 0.2, 0.65, False, False, False),
    "academic": (-105.0, 0.12, 0.18, 0.6, True, True, True),
    "policy": (-110.0, 0.18, 0.22, 0.7, True, False, False),
    "form": (-120.0, 0.08, 0.2, 0.5, False, False, False),
    "government": (-105.0, 0.14, 0.2, 0.65, True, False, False),
    "adaptive": (-100.0, 0.15, 0.2, 0.65, True, False, False),
}


def by_name(name: str) -> dict:
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}; there are {', '.join(PROFILES)}")
    return dict(zip(FIELDS, PROFILES[name], strict=True))


def profile_of(doc_type: Column) -> Column:
    """struct of the settings for a kind of document; documents of mixed or other kinds have the balanced ones."""
    settings = lambda name: F.struct(F.lit(name).alias("profile"), *[F.lit(v).alias(k) for k, v in by_name(name).items()])
    out = settings("balanced")
    for name in ("academic", "policy", "government", "form"):
        out = F.when(doc_type == name, settings(name)).otherwise(out)
    return out
