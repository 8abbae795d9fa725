"""Column helpers: first-wins extremes, clocks, text shaping, vectors. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The first id of a transcription model's special tokens; fixed value.
SPECIAL_TOKENS = 50257


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def largest_first(key: Column, order: Column, *values: Column, when: Column | None = None) -> Column:
    """Aggregate: the values beside the largest key; of equal keys the least order wins."""
    s = F.struct(key.alias("key"), (-order).alias("order"), *values)
    return F.max(s if when is None else F.when(when, s))


def smallest_first(*keys_and_values: Column, when: Column | None = None) -> Column:
    """Aggregate: the struct with the least leading fields."""
    s = F.struct(*keys_and_values)
    return F.min(s if when is None else F.when(when, s))


def overlap(a0, a1, b0, b1) -> Column:
    """Length of the common part of two intervals, 0 if there is none; null if any bound is null."""
    known = reduce(lambda x, y: x & y, (col(c).isNotNull() for c in (a0, a1, b0, b1)))
    return F.when(known, F.greatest(F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)), F.lit(0.0)))


def midpoint(a, b) -> Column:
    return (F.coalesce(col(a), F.lit(0.0)) + F.coalesce(col(b), F.lit(0.0))) / 2


def buckets(a, b, width: float) -> Column:
    """Numbers of the time buckets that [a, b] touches."""
    lo, hi = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def shown_name(display="display_name", label="label") -> Column:
    return F.coalesce(F.nullif(col(display), F.lit("")), col(label))


# --- clocks: every part is truncated -----------------------------------------------------------------


def _hms(t: Column) -> tuple[Column, Column, Column, Column]:
    return F.floor(t / 3600).cast("int"), F.floor(F.pmod(t, F.lit(3600.0)) / 60).cast("int"), F.floor(F.pmod(t, F.lit(60.0))).cast("int"), F.floor(F.pmod(t, F.lit(1.0)) * 1000).cast("int")


def srt_time(t) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_hms(col(t)))


def vtt_time(t) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", *_hms(col(t)))


def short_time(t) -> Column:
    h, m, s, _ = _hms(col(t))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def minutes_time(t) -> Column:
    """M:SS without hours."""
    return F.format_string("%d:%02d", F.floor(col(t) / 60).cast("int"), F.floor(F.pmod(col(t), F.lit(60.0))).cast("int"))


def duration_text(t) -> Column:
    m, s = F.floor(col(t) / 60).cast("int"), F.floor(F.pmod(col(t), F.lit(60.0))).cast("int")
    return F.when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def megabytes(size) -> Column:
    """``N.N MB``, half to even; the format alone would round half up."""
    return F.format_string("%.1f MB", F.bround(col(size).cast("double") / F.lit(1024.0 * 1024.0), 1))


def seconds_text(t) -> Column:
    """``N.Ns``, half to even."""
    return F.format_string("%.1fs", F.bround(col(t), 1))


def whole_seconds(t) -> Column:
    return F.format_string("%.0f", F.bround(col(t), 0))


def whole_minutes(t) -> Column:
    return F.floor(col(t) / 60)


def day_text(t) -> Column:
    return F.date_format(col(t), "yyyy-MM-dd")


def stamp_text(t) -> Column:
    return F.date_format(col(t), "yyyy-MM-dd HH:mm")


def parse_time(t) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or ``S``, comma or point; null if it is none of these."""
    p = F.split(F.replace(col(t), F.lit(","), F.lit(".")), ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1)).when(F.size(p) == 1, n(0))


# --- text -------------------------------------------------------------------------------------------


def words(t) -> Column:
    """Words without empty ones."""
    return F.filter(F.split(F.trim(col(t)), r"(?U)\s+"), lambda w: w != "")


def cut(t, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(col(t)) > n, F.concat(F.substring(col(t), 1, n), F.lit(suffix))).otherwise(col(t))


#: Characters that a file's name cannot hold; fixed value.
ILLEGAL = r'["\\/:<>|?*\x00-\x1f]'


def safe_filename(name) -> Column:
    s = F.regexp_replace(F.regexp_replace(col(name), ILLEGAL, "_"), r"^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("export"))


def upload_filename(name) -> Column:
    return F.regexp_replace(F.regexp_extract(col(name), r"([^/\\]*)$", 1), r"(?U)[^\w.\-]", "_")


def title_of(name) -> Column:
    return F.regexp_replace(col(name), r"\.[^/.]+$", "")


def slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9-]", "-"), "^-+|-+$", "")


def masked(secret) -> Column:
    s, stars = col(secret), F.lit("*" * 10)
    return F.when(F.length(s) > 6, F.concat(F.substring(s, 1, 3), stars, F.right(s, F.lit(3)))).when(F.length(s) > 0, stars).otherwise(s)


def is_lower(t) -> Column:
    return (col(t) == F.lower(col(t))) & (col(t) != F.upper(col(t)))


def tokens(t) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(t)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def is_hallucination(t) -> Column:
    """Leaked special tokens, or at most two characters."""
    return col(t).contains("<|") | col(t).contains("|>") | (F.length(F.trim(col(t))) <= 2)


def mean_token_probability(tokens_col) -> Column:
    """Mean p over ordinary tokens with p > 0; null if there is none."""
    p = F.transform(F.filter(col(tokens_col), lambda t: (F.coalesce(t["id"], F.lit(0)) < SPECIAL_TOKENS) & (F.coalesce(t["p"], F.lit(0.0)) > 0)), lambda t: t["p"])
    return F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p))


def escaped(t) -> Column:
    out = col(t)
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return out


# --- vectors ----------------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def running_mean(old, n, new) -> Column:
    """Element-wise (old * n + new) / (n + 1)."""
    return F.zip_with(col(old), col(new), lambda x, y: (x * col(n) + y) / (col(n) + 1))


def ema(old, new, keep: float = 0.7) -> Column:
    return F.zip_with(col(old), col(new), lambda x, y: x * keep + y * (1 - keep))


def rms(samples) -> Column:
    """Root mean square; 0 without samples."""
    s = F.transform(col(samples), lambda x: x.cast("double") * x.cast("double"))
    return F.when(F.size(s) > 0, F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))).otherwise(F.lit(0.0))
