"""Whether a candidate is the wanted recording, as column expressions and as SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertone.functions.text import fold

# Words without weight, marks of reproductions, title separators, keywords and bands of the score.
STOPWORDS = "official audio video music lyric lyrics visualizer hd hq the a an of and x feat ft featuring remix mix mixed edit vip version".split()
REPRODUCTIONS = [
    "remake", "ableton", "fl studio", " flp", "logic pro", "tutorial", "how to make", "karaoke", "backing track", "instrumental version", "cover by", "(cover)", "[cover]",
    "guitar cover", "piano cover", "drum cover", "bass cover", "reaction",
]
SEPARATORS = [" - ", " – ", " — "]
GOOD_WORDS = ["official audio", "lyrics", "official video"]
BAD_WORDS = ["live", "cover", "karaoke", "remix", "instrumental"]
BANDS = [(3, 25), (10, 12), (25, 0), (45, -10)]
FAR_PENALTY = -30
LONGEST_TRACK_SEC = 1800

_BRACKETED = r"[(\[][^)\]]*[)\]]"


def tokens(col: Column) -> Column:
    """Distinct folded words that carry weight."""
    return F.array_distinct(F.filter(F.split(fold(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOPWORDS)))


def squash(col: Column) -> Column:
    """Folded letters and digits without anything between them."""
    return F.regexp_replace(fold(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", "")


def _head(col: Column, otherwise: Column) -> Column:
    """What stands before the first kind of separator that occurs."""
    return reduce(lambda acc, s: F.when(F.contains(col, F.lit(s)), F.split_part(col, F.lit(s), F.lit(1))).otherwise(acc), reversed(SEPARATORS), otherwise)


def core_text(title: Column) -> Column:
    """Title without the part behind a separator and without brackets."""
    name = F.coalesce(title, F.lit(""))
    return F.regexp_replace(_head(name, name), _BRACKETED, " ")


def contains_title(title: Column, candidate: Column) -> Column:
    core = squash(core_text(title))
    return (F.length(core) >= 2) & F.contains(squash(candidate), core)


def recall(title: Column, candidate: Column) -> Column:
    """Share of the core title's words that the candidate has, words of four letters and more also inside others."""
    want, have, whole = tokens(core_text(title)), tokens(candidate), squash(candidate)
    hit = F.filter(want, lambda w: F.array_contains(have, w) | ((F.length(w) >= 4) & F.contains(whole, w)))
    return F.when(F.size(want) == 0, 0.0).otherwise(F.size(hit) / F.size(want))


def performed_by(artist: Column, candidate: Column, channel: Column) -> Column:
    """The channel, or what the candidate's title starts with, names the artist."""
    who, name = tokens(artist), F.coalesce(candidate, F.lit(""))
    return F.arrays_overlap(who, tokens(channel)) | F.arrays_overlap(who, tokens(_head(name, name)))


def reproduction(candidate: Column, channel: Column) -> Column:
    text = F.concat(F.lit(" "), F.lower(F.coalesce(candidate, F.lit(""))), F.lit(" | "), F.lower(F.coalesce(channel, F.lit(""))), F.lit(" "))
    return F.exists(F.array(*[F.lit(m) for m in REPRODUCTIONS]), lambda m: F.contains(text, m))


def other_length(seconds: Column, expected: Column) -> Column:
    """Unknown on either side, or further apart than 20 s and 15 %."""
    known = (F.coalesce(seconds, F.lit(0)) > 0) & (F.coalesce(expected, F.lit(0)) > 0)
    return ~known | F.coalesce(F.abs(seconds - expected) > F.greatest(F.lit(20.0), 0.15 * expected), F.lit(False))


def too_long(seconds: Column, expected: Column) -> Column:
    known = F.coalesce(expected, F.lit(0)) > 0
    limit = F.when(known, F.greatest(2 * expected, expected + 120)).otherwise(F.lit(float(LONGEST_TRACK_SEC)))
    return F.coalesce((seconds > 0) & (seconds > limit), F.lit(False))


def score(candidate: Column, seconds: Column, expected: Column) -> Column:
    """Points of title words and of the difference in length."""
    text, gap = F.lower(F.coalesce(candidate, F.lit(""))), F.abs(seconds - expected)
    words = [F.when(F.contains(text, F.lit(w)), n).otherwise(0) for ws, n in ((GOOD_WORDS, 10), (BAD_WORDS, -15)) for w in ws]
    band = reduce(lambda acc, b: F.when(gap <= b[0], b[1]).otherwise(acc), reversed(BANDS), F.lit(FAR_PENALTY))
    return reduce(lambda a, b: a + b, words) + F.when(gap.isNull(), 0).otherwise(band)


def sql_squash(c: str) -> str:
    return f"regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', '', 'g')"


def sql_tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+'), lambda w: w <> '' and w not in ({stop})))"


def sql_head(c: str) -> str:
    return "case " + " ".join(f"when contains({c}, '{s}') then split_part({c}, '{s}', 1)" for s in SEPARATORS) + f" else {c} end"


def sql_core(c: str) -> str:
    return f"regexp_replace({sql_head(c)}, '[(\\[][^)\\]]*[)\\]]', ' ', 'g')"


def sql_score(title: str, gap: str) -> str:
    words = [f"case when contains(lower(coalesce({title}, '')), '{w}') then {n} else 0 end" for ws, n in ((GOOD_WORDS, 10), (BAD_WORDS, -15)) for w in ws]
    band = "case when " + gap + " is null then 0 " + " ".join(f"when {gap} <= {b} then {n}" for b, n in BANDS) + f" else {FAR_PENALTY} end"
    return " + ".join([*words, band])
