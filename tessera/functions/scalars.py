"""Scalar expressions over columns: identities, probabilities, losses, schedules, selection and gate comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GAME_VIDEO, GAME_LABEL_VIDEO = "game_video", "game_label_video"
SEVERITIES = ("error", "warning", "info")
SPLITS = ("train", "val", "test")
#: Report bounds and confidence edges: fixed values.
BAND_LOW, BAND_EDGE, BAND_HIGH = 0.980, 0.990, 0.995
CONFIDENCE_EDGES = (0.980, 0.990, 0.995, 0.999)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# identities


def stable_source_id(game="game", video="video_id", label="label", mode: str = GAME_VIDEO, namespace: Column | str | None = None) -> Column:
    """The leakage unit: ``game::video`` or ``game::label::video``, behind ``namespace::`` where there is one."""
    if mode not in (GAME_VIDEO, GAME_LABEL_VIDEO):
        raise ValueError(f"unknown identity mode {mode!r}")
    parts = [_c(game), *([_c(label).cast("string")] if mode == GAME_LABEL_VIDEO else []), _c(video).cast("string")]
    space = [] if namespace is None else [F.nullif(_c(namespace), F.lit(""))]
    return F.concat_ws("::", *space, *parts)


def sample_id(split="split", game="game", label="label", video="video_id", frame="frame_id") -> Column:
    return F.format_string("%s:%s:%d:%s:%05d", _c(split), _c(game), _c(label), _c(video), _c(frame))


def source_version_id(stable="stable_source_id", content="content_version_id") -> Column:
    """``stable#content``, or the stable id alone without content."""
    return F.when(F.coalesce(_c(content), F.lit("")) == "", _c(stable)).otherwise(F.concat(_c(stable), F.lit("#"), _c(content)))


def display_reference(path="path", location="frame_location") -> Column:
    return F.coalesce(_c(path), F.concat(F.lit("packed://frame/"), _c(location).cast("string")))


def video_of(name: Column | str) -> Column:
    """Two digits of a frame file name, or null."""
    found = F.regexp_extract(_c(name), r"^(\d{2})(\d{5})\.png$", 1)
    return F.when(found != "", found)


def frame_of(name: Column | str) -> Column:
    """Five digits of a frame file name as an integer, or null."""
    found = F.regexp_extract(_c(name), r"^(\d{2})(\d{5})\.png$", 2)
    return F.when(found != "", found.cast("int"))


def slugify(text: Column | str) -> Column:
    cut = F.lower(F.regexp_replace(F.regexp_replace(_c(text), r"[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(cut == "", F.lit("run")).otherwise(cut)


def severity(text: Column | str) -> Column:
    low = F.lower(_c(text))
    return F.when(low.isin(*SEVERITIES), low).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), low)))


# ratios and probabilities


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` in doubles, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def margin_of_threshold(threshold: float) -> float:
    if not 0 < threshold < 1:
        raise ValueError("a threshold lies between 0 and 1")
    return math.log(threshold / (1 - threshold))


def log_odds(p: Column | str) -> Column:
    """``ln(p / (1 - p))`` as doubles have it: infinite at 0 and 1, NaN outside of them, null for null alone."""
    x = _c(p)
    odds = F.when(x == 1, F.lit(math.inf)).otherwise(F.try_divide(x, 1 - x))
    return F.when(odds == 0, F.lit(-math.inf)).when(odds < 0, F.lit(math.nan)).otherwise(F.log(odds))


def probability(margin: Column | str) -> Column:
    """Sigmoid without overflow."""
    m = _c(margin)
    return F.when(m >= 0, 1 / (1 + F.exp(-m))).otherwise(F.exp(m) / (1 + F.exp(m)))


def positive_probability(logit0="logit0", logit1="logit1") -> Column:
    """Softmax of two logits, second class."""
    return probability(_c(logit1) - _c(logit0))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def margin_loss(margin="margin", label="label", cutoff: float = 0.0, safety: float = 0.0, temperature: float = 1.0) -> Column:
    """Soft distance to the right side of the cutoff."""
    m, t = _c(margin), F.lit(float(temperature))
    wrong = F.when(_c(label) == 1, cutoff + safety - m).otherwise(m - cutoff + safety)
    return t * softplus(wrong / t)


def cross_entropy(margin="margin", label="label", smoothing: float = 0.0) -> Column:
    """Two-class cross entropy from the margin ``logit1 - logit0``; the smoothed share goes to both classes alike."""
    m = _c(margin)
    own = softplus(F.when(_c(label) == 1, -m).otherwise(m))
    if not smoothing:
        return own
    return (1 - smoothing) * own + smoothing / 2 * (softplus(m) + softplus(-m))


def threshold_band(p="p_positive") -> Column:
    """Names of the two bands around the decision threshold; null elsewhere."""
    x = _c(p)
    return F.when((x >= BAND_LOW) & (x < BAND_EDGE), "0.980-0.990").when((x >= BAND_EDGE) & (x <= BAND_HIGH), "0.990-0.995")


def confidence_bucket(p="p_positive") -> Column:
    """0 to 4, by edges that belong to the bucket above."""
    return sum(((_c(p) >= edge).cast("int") for edge in CONFIDENCE_EDGES), F.lit(0))


def error_type(predicted="predicted", label="label") -> Column:
    return F.when(_c(predicted) == _c(label), F.lit(None)).when(_c(predicted) == 1, "FP").otherwise("FN")


def score_bin(p: Column | str, bins: int) -> Column:
    return F.least(F.floor(_c(p) * bins), F.lit(bins - 1)).cast("int")


# schedules


def threshold_weight(step: Column | str, warmup: int, ramp: int, most: float) -> Column:
    """0 through the warm-up, then a line up to ``most``."""
    s = _c(step)
    if ramp <= 0:
        return F.when(s <= warmup, 0.0).otherwise(float(most))
    return F.when(s <= warmup, 0.0).when(s >= warmup + ramp, float(most)).otherwise(most * (s - warmup) / float(ramp))


def learning_rate_factor(step: Column | str, warmup: int, total: int, least: float) -> Column:
    """A line up through the warm-up, then half a cosine down to ``least``."""
    s = _c(step).cast("double")
    progress = F.least(F.lit(1.0), (s - warmup) / float(max(1, total - warmup)))
    return F.when(s < warmup, (s + 1) / float(max(1, warmup))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


# gates


def compare(value: Column | str, op: Column | str, bound: Column | str) -> Column:
    """``value op bound`` for the four gate operators; null for any other."""
    v, o, b = _c(value), _c(op), _c(bound)
    return F.when(o == "<=", v <= b).when(o == "<", v < b).when(o == ">=", v >= b).when(o == ">", v > b)


def html_escape(text: Column | str) -> Column:
    """Text with the five characters that HTML gives a meaning written as references."""
    out = _c(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def run_id(started: Column | str, name: Column | str, salt: Column | str) -> Column:
    """A run's folder: its day, then its time, its name as a slug and four hex digits of a salt's hash."""
    digits = F.substring(F.sha2(_c(salt).cast("string"), 256), 1, 4)
    return F.concat(F.date_format(_c(started), "yyyyMMdd"), F.lit("/"), F.date_format(_c(started), "HHmmss"), F.lit("_"), slugify(name), F.lit("_"), digits)
