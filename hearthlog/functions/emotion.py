"""Emotion distributions and valence-arousal-dominance vectors (native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import EMOTIONS

# Valence, arousal and dominance of each emotion.
VAD = {"joy": (0.85, 0.65, 0.70), "anger": (0.15, 0.85, 0.75), "fear": (0.10, 0.80, 0.20), "sadness": (0.15, 0.25, 0.20), "neutral": (0.50, 0.30, 0.50)}
# Labels that count as another one.
FOLDS = {"disgust": "anger", "surprise": "joy", "sad": "sadness"}


def harmonise(p: str) -> Column:
    """A map of label probabilities as the five emotions, summing to 1 where anything is there."""
    m = F.col(p)
    raw = {e: sum((F.coalesce(m[k], F.lit(0.0)) for k in [e, *[a for a, b in FOLDS.items() if b == e]]), F.lit(0.0)) for e in EMOTIONS}
    total = sum(raw.values(), F.lit(0.0))
    return F.struct(*[F.when(total > 0, v / total).otherwise(v).alias(e) for e, v in raw.items()])


def vad(p: str) -> Column:
    """The expected vector of an emotion struct."""
    s = F.col(p)
    return F.struct(*[sum((s[e] * VAD[e][k] for e in EMOTIONS), F.lit(0.0)).alias(n) for k, n in enumerate(("v", "a", "d"))])


def dominant(p: str) -> Column:
    """The most likely emotion; the first in order wins ties."""
    s, out = F.col(p), F.lit(EMOTIONS[-1])
    best = F.greatest(*[s[e] for e in EMOTIONS])
    for e in reversed(EMOTIONS):
        out = F.when(s[e] == best, e).otherwise(out)
    return out


def keyword_record(emotion: Column, polarity: Column, subjectivity: Column) -> Column:
    """Valence and arousal of an episode; a named emotion is at least half aroused."""
    a = F.when((emotion != "neutral") & (subjectivity < 0.5), 0.5 + 0.5 * subjectivity).otherwise(subjectivity)
    return F.struct(emotion.alias("emotion"), F.bround((polarity + 1) / 2, 2).alias("emotional_valence"), F.bround(a, 2).alias("emotion_arousal"))


def sentiment_label(polarity: Column) -> Column:
    """P38."""
    return F.when(polarity > 0.3, "Very Positive").when(polarity > 0.1, "Positive").when(polarity < -0.3, "Very Negative").when(polarity < -0.1, "Negative").otherwise("Neutral")
