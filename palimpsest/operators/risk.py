"""Signs that values are being smuggled past redaction: unusual density, encoded values.

Density is matches per thousand characters.  What is usual is learned per source, as quantiles
of a mergeable sketch: tasks sketch what they read, and only sketches are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.redact import match_total

# The risks an audit entry can have.
NONE, ENCODED, DENSE, REVIEW = "none", "encoding_detected", "high_redaction_density", "manual_review_recommended"
# End of fixed values.

#: The quantile of its source that a text's density has to exceed to be unusual.
QUANTILE = 0.99
#: The rank of a sketched quantile is off by at most a part in so many of the source's rows.
ACCURACY = 10_000
#: Fewer matches are never unusual, however short the text.
LEAST = 5


def density(text: Column, matches: Column) -> Column:
    """Matches per thousand characters of the text as it was, rounded to six places; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.round(match_total(matches) * 1000 / F.length(text), 6)).otherwise(F.lit(0.0))


def usual_density(
    rows: DataFrame, source: str = "source", measure: str = "density", quantile: float = QUANTILE, accuracy: int = ACCURACY
) -> DataFrame:
    """``(source, usual, texts)``: the quantile of each source's densities, within ``texts / accuracy`` ranks."""
    sketch = F.percentile_approx(measure, quantile, accuracy)
    return rows.groupBy(F.col(source).alias("usual_of")).agg(sketch.alias("usual"), F.count("*").alias("texts"))


def bypass_risk(
    rows: DataFrame,
    usual: DataFrame,
    source: str = "source",
    measure: str = "density",
    matches: str = "matches",
    encoded: str = "encoded",
    least: int = LEAST,
) -> DataFrame:
    """``rows`` with ``bypass_risk``, against the densities that are usual in their source.

    A text is unusual if it has ``least`` matches or more and is denser than its source's
    quantile; a source without one has nothing unusual.  With values in encoded forms besides, a person
    should look.  ``usual`` has a row for each source; the join is decided by its measured size.
    """
    dense = (F.col(matches) >= least) & F.coalesce(F.col(measure) > F.col("usual"), F.lit(False))
    hidden = F.col(encoded) > 0
    risk = F.when(dense & hidden, REVIEW).when(dense, DENSE).when(hidden, ENCODED).otherwise(NONE)
    known = usual.select("usual_of", "usual")
    joined = rows.join(known, rows[source].eqNullSafe(known["usual_of"]), "left")
    return joined.select(*rows.columns, risk.alias("bypass_risk"))
