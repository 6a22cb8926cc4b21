"""Near-duplicate titles with small edits: candidates by performer and time, banded alignment."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertone.durable import Scratch

#: Not read any more: nothing here depends on how many rows a title has. A test of an earlier round still sets them.
COMMON_TITLE = FEW_ROWS = 0

# Credit words, release labels and take labels of titles.
CREDIT = re.compile(r"^(feat|ft|featuring|with)\b")
RELEASE = re.compile(
    r"^((\d{4} )?(digital )?remaster(ed)?( version)?( \d{4})?|(\d{4} )?reissue( \d{4})?"
    r"|(\d+(st|nd|rd|th) )?(anniversary|deluxe|expanded|special|collectors?|limited|bonus|standard)( \w+)? (edition|version)|(\w+ )?edition"
    r"|bonus( track)?|mono( version| mix)?|stereo( version| mix)?|clean( version)?|explicit( version)?|(single|album|original|lp)( version)?|deluxe)$"
)
PLAIN_TAKES = (
    "live", "acoustic", "unplugged", "demo", "instrumental", "karaoke", "reprise", "slowed", "sped up", "nightcore", "a cappella", "acapella",
    "radio session", "radio edit", "session", "extended mix", "extended", "club mix", "mix", "edit", "dub", "remix", "rework", "bootleg", "cover", "intro", "outro", "interlude",
)
LABELS = ("remastered", "remaster", "reissue", "deluxe edition", "anniversary edition", "bonus track", "mono", "stereo", "clean", "explicit", "single version", "album version", *PLAIN_TAKES, "karaoke version")
QUALIFIED_TAKE = re.compile(r"^(live\b.*|.*\b(remix|dub|mix|edit|session|version|rework|bootleg|cover|demo|acoustic))$")
NUMBERED = re.compile(r"(?:\b(?:pt|part|vol|volume|no|nr|number|chapter|episode)\b\.?|#)\s*(\d+|[ivx]+|one|two|three|four|five|six|seven|eight|nine|ten)\b")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
SPELT = {w: i for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}

_WORDS = re.compile(r"[^\W_]+")
#: What _WORDS finds, for the JVM.
WORDY = r"[\p{L}\p{N}]"
_BRACKET = re.compile(r"[(\[{]([^()\[\]{}]*)[)\]}]")
_DASH = re.compile(r"\s+[-–—]\s+")
_CREDIT_TAIL = re.compile(r"\s(feat|ft|featuring)\b\.?\s.*$")
_PERFORMER_CUT = re.compile(r"[,;/|&·•\t\n\r()\[\]\"“”]+|(?<!\w)(?:featuring|feat|ft)\b\.?|(?<=\s)x(?=\s)")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _close(a: str, b: str) -> bool:
    """At most one slip (insertion, deletion, change or swap of neighbours) apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def classify(segment: str) -> tuple[str, str]:
    """``(role, value)`` of a bracketed or dashed part: credit, release, take or title."""
    seg = " ".join(_WORDS.findall(plain(segment)))
    if CREDIT.match(seg):
        return "credit", ""
    if RELEASE.match(seg):
        return "release", ""
    for label in PLAIN_TAKES:
        if seg in (label, label + " version"):
            return "take", label
    if QUALIFIED_TAKE.match(seg):
        return "take", seg
    if len(seg) >= 5:
        for label in LABELS:
            if len(label) >= 5 and _close(seg, label):
                return classify(label)
    return "title", seg


def parse_title(name: str) -> tuple[list[str], str, str]:
    """``(words, take, numbers)``: title words without labels, kind of take, series numbers."""
    text = plain(name)
    takes: set[str] = set()

    def bracket(m: re.Match) -> str:
        role, value = classify(m.group(1))
        if role == "take":
            takes.add(value)
        return f" {m.group(1)} " if role == "title" else " "

    text = _BRACKET.sub(bracket, text)
    head, *tails = _DASH.split(" " + text)
    kept = [head]
    for tail in tails:
        role, value = classify(tail)
        if role == "take":
            takes.add(value)
        elif role == "title":
            kept.append(tail)
    base = _CREDIT_TAIL.sub("", " ".join(kept))
    numbers = []

    def number(m: re.Match) -> str:
        n = m.group(1)
        numbers.append(int(n) if n.isdigit() else ROMAN.get(n) or SPELT.get(n) or 0)
        return " "

    words = _WORDS.findall(NUMBERED.sub(number, base))
    left = []
    for i, w in enumerate(words):
        if w.isdigit() and len(w) < 18:
            numbers.append(int(w))
        elif w in ROMAN and len(words) > 1 and (len(w) > 1 or i == len(words) - 1):
            numbers.append(ROMAN[w])
        else:
            left.append(w)
    if not left:
        left = words or _WORDS.findall(plain(name))
    return left, "+".join(sorted(takes)), ",".join(map(str, sorted(numbers)))


def performers(names: str) -> list[str]:
    """Folded names without spaces, articles or punctuation, in byte order."""
    out = set()
    for part in _PERFORMER_CUT.split(plain(names)):
        ws = _WORDS.findall(part)
        if ws[:1] == ["the"] and len(ws) > 1:
            ws = ws[1:]
        if ws:
            out.add("".join(ws))
    return sorted(out)


def profile(text: str, k: int = 2) -> list[str]:
    """Occurrence-labelled k-mers, for similarity whatever the order of the parts."""
    times: dict[str, int] = {}
    out = []
    for i in range(max(1, len(text) - k + 1)):
        g = text[i : i + k]
        times[g] = times.get(g, 0) + 1
        out.append(f"{g}{times[g]}")
    return out


@lru_cache(1 << 16)
def _bit(item: str) -> int:
    return 1 << (zlib.crc32(item.encode("utf-8", "surrogatepass")) & 63)


def bits(text: str, k: int) -> int:
    """The occurrence-labelled k-mers as a set of 64 bits; two such sets differ in no more bits than k-mers."""
    out = 0
    for item in profile(text, k):
        out |= _bit(item)
    return out - (1 << 64) if out >> 63 else out


#: Names beyond this many letters meet by length instead of by pieces, whose number grows with the square of it.
LONG = 32


def most_slips(size: int) -> int:
    """Edits that two names may be apart, the longer of which has ``size`` letters."""
    return max(2, int(size * 0.3))


def _stretch(size: int) -> int:
    return int(math.log(size) / math.log(1 / 0.7))


def name_keys(name: str) -> tuple[set[int], set[int]]:
    """``(as the shorter, as the longer)``: two names that are near share a key of the one's first and the other's second set.

    The shorter name is cut into one piece more than edits are allowed, so that a
    piece stands unchanged in the longer one, after at most as many edits as there
    are pieces before it and with the rest of the edits behind it. No near pair is
    missed; what else meets is aligned anyway.
    """
    size = len(name)
    short: set[int] = set()
    long: set[int] = set()
    if size < 5:
        return short, long

    def key(other: int, slips: int, i: int, piece: str) -> int:
        return zlib.crc32(piece.encode("utf-8", "surrogatepass")) | other << 32 | slips << 38 | i << 42

    def pieces(n: int, slips: int) -> Iterator[tuple[int, int, int]]:
        least, more = divmod(n, slips + 1)
        at = 0
        for i in range(slips + 1):
            wide = least + (i > slips - more)
            yield i, at, wide
            at += wide

    longer = size
    while longer <= LONG and longer - most_slips(longer) <= size:
        short.update(key(size, most_slips(longer), i, name[at : at + wide]) for i, at, wide in pieces(size, most_slips(longer)))
        longer += 1
    if longer > LONG:
        short.add(1 << 62 | _stretch(size))
    slips = most_slips(size)
    if size > LONG:
        long.update(1 << 62 | b for b in range(_stretch(size - slips), _stretch(size) + 1))
        return short, long
    for other in range(max(5, size - slips), size + 1):
        apart = size - other
        for i, at, wide in pieces(other, slips):
            first, last = max(0, at - i, at + apart - (slips - i)), min(size - wide, at + i, at + apart + (slips - i))
            long.update(key(other, slips, i, name[x : x + wide]) for x in range(first, last + 1))
    return short, long


def _labelled(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of several texts, one row each in text order, and their numbers."""
    padded = [t.ljust(k, b"\0") for t in texts]
    sizes = np.array([len(t) - k + 1 for t in padded])
    flat = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    starts = np.cumsum([0, *(len(t) for t in padded[:-1])])
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[owner] + place
    gram = np.zeros(len(at), np.uint64)
    for i in range(k):
        gram = gram << np.uint64(8) | flat[at + i]
    order = np.lexsort((place, gram, owner))
    first = np.ones(len(order), bool)
    first[1:] = (gram[order][1:] != gram[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    run = np.arange(len(order))
    times = np.empty(len(order), np.uint64)
    times[order] = run - np.maximum.accumulate(np.where(first, run, 0))
    out = np.zeros((len(texts), int(sizes.max())), np.uint64)
    out[owner, place] = gram | times << np.uint64(32)
    return out, sizes


def order_minhashes(texts: list[str], seeds: np.ndarray, k: int = 3, ell: int = 2) -> np.ndarray:
    """One value per text and seed: the ``ell`` smallest occurrence-labelled k-mers, hashed in text order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.empty((len(texts), len(seeds)), np.uint64)
    lo = 0
    while lo < len(raw):
        hi, widest = lo, 0
        while hi < len(raw) and (hi == lo or max(widest, len(raw[hi])) * (hi - lo + 1) <= 1 << 16):
            widest = max(widest, len(raw[hi]))
            hi += 1
        base, sizes = _labelled(raw[lo:hi], k)
        beyond = np.arange(base.shape[1])[None] >= sizes[:, None]
        row = np.arange(hi - lo)
        for s, seed in enumerate(seeds):
            h = (base ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h[beyond] = np.uint64(0xFFFFFFFFFFFFFFFF)
            picks = []
            for _ in range(min(ell, base.shape[1])):
                picks.append(h.argmin(1))
                h[row, picks[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            acc = np.full(hi - lo, seed)
            # Missing k-mers of short texts sort behind the others and leave the value as it is.
            picks = np.sort(np.where(np.arange(len(picks))[:, None] < sizes, np.stack(picks), base.shape[1]), axis=0)
            for pick in picks:
                there = pick < base.shape[1]
                fresh = (acc ^ base[row, np.where(there, pick, 0)]) * np.uint64(0x94D049BB133111EB)
                acc = np.where(there, fresh ^ fresh >> np.uint64(31), acc)
            out[lo:hi, s] = acc
        lo = hi
    return out


def order_minhash(text: str, seeds: np.ndarray, k: int = 3, ell: int = 2) -> np.ndarray:
    """Order MinHash values of one text."""
    return order_minhashes([text], seeds, k, ell)[0]


_PARSED = "id string, duration long, take string, numbers string, title string, size int, letters long, grams long, names array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = [f.split()[0] for f in _PARSED.split(", ")]
    for batch in batches:
        cols: list[list] = [[] for _ in kinds]
        for ident, name, artists, duration in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words, take, numbers = parse_title(name)
            who = performers(artists)
            if words and who:
                text = "".join(words)
                for col, v in zip(cols, (ident, duration, take, numbers, " ".join(words), len(text), bits(text, 1), bits(text, 2), who)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _name_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of single names as ``(name, letters, longer, key)``."""
    for batch in batches:
        names = batch.column(0)
        both = [[np.fromiter(keys, np.int64, len(keys)) for keys in name_keys(name)] for name in names.to_pylist()]
        letters = pa.array([bits(name, 1) for name in names.to_pylist()], pa.int64())
        for longer in (False, True):
            sets = [keys[longer] for keys in both]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(keys) for keys in sets]))
            found = pa.array(np.concatenate([np.empty(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([names.take(at), letters.take(at), pa.array(np.full(len(at), longer)), found], names=["name", "letters", "longer", "key"])


def _near(a: Column, b: Column, limit: Column) -> Column:
    """Edit distance of at most ``limit``, in a band of that width."""
    return F.call_function("levenshtein", a, b, limit) >= 0


def _turned(words: Column, other: Column, limit: Column) -> Column:
    """Some rotation of the words aligns with the other text."""

    def at(i: Column) -> Column:
        return _near(F.concat_ws("", F.slice(words, i + 1, F.size(words) - i), F.slice(words, F.lit(1), i)), other, limit)

    return F.when(F.size(words) > 1, F.exists(F.sequence(F.lit(1), F.size(words) - 1), at)).otherwise(False)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _profiles(text: str) -> list[str]:
    return profile(text)


def _unlike(a: Column, b: Column) -> Column:
    """Bits that only one of the two sets has."""
    return F.bit_count(a.bitwiseXOR(b))


def _near_names(names: DataFrame) -> DataFrame:
    """Names ``(name, n)`` that agree but for slips, as ``(name, host)``; the host is the one with more rows."""
    marks = names.select("name").mapInArrow(_name_marks, "name string, letters long, longer boolean, key long")
    short = marks.where("not longer").select("key", F.col("name").alias("name_a"), F.col("letters").alias("letters_a"))
    long = marks.where("longer").select("key", F.col("name").alias("name_b"), F.col("letters").alias("letters_b"))
    sizes = F.length("name_a"), F.length("name_b")
    most = F.greatest(F.lit(2), F.floor(sizes[1] * 0.3)).cast("int")
    once = (sizes[0] < sizes[1]) | ((sizes[0] == sizes[1]) & (F.col("name_a") < F.col("name_b")))
    # Each edit changes at most one letter on either side.
    like = (_unlike(F.col("letters_a"), F.col("letters_b")) <= 2 * most - (sizes[1] - sizes[0])) & _near(F.col("name_a"), F.col("name_b"), most)
    both = short.join(long.hint("merge"), "key").where(like & once).select("name_a", "name_b").distinct()
    counted = both.join(names.toDF("name_a", "n_a"), "name_a").join(names.toDF("name_b", "n_b"), "name_b")
    sides = [F.struct(F.col(f"n_{s}").alias("n"), F.col(f"name_{s}").alias("name")) for s in "ab"]
    return counted.select(F.least(*sides)["name"].alias("name"), F.greatest(*sides)["name"].alias("host"))


def _limit(slips: float) -> Column:
    return F.greatest(F.lit(2), F.floor(F.least("size_a", "size_b") * slips)).cast("int")


def _aligned(slips: float) -> Column:
    """The titles, their sorted words, or a rotation of one's words and the other align within the limit."""
    limit, gap = _limit(slips), F.abs(F.col("size_a") - F.col("size_b"))
    words = {s: F.split(F.col(f"title_{s}"), " ") for s in "ab"}
    text = {s: F.replace(F.col(f"title_{s}"), F.lit(" "), F.lit("")) for s in "ab"}
    tidy = {s: F.concat_ws("", F.array_sort(words[s])) for s in "ab"}
    turned = _turned(words["a"], text["b"], limit) | _turned(words["b"], text["a"], limit)
    # However the words lie, each edit changes at most one letter on either side.
    return (gap <= limit) & (_unlike(F.col("letters_a"), F.col("letters_b")) <= 2 * limit - gap) & (_near(text["a"], text["b"], limit) | _near(tidy["a"], tidy["b"], limit) | turned)


def _profile_sizes() -> Column:
    return F.greatest(F.lit(1), F.col("size_a") - 1) + F.greatest(F.lit(1), F.col("size_b") - 1)


def _maybe_alike(slips: float, alike: float) -> Column:
    """What ``_alike`` accepts and little else, from bits alone."""
    return (F.abs(F.col("size_a") - F.col("size_b")) <= _limit(slips)) & (_unlike(F.col("grams_a"), F.col("grams_b")) <= (1 - alike) * _profile_sizes() + 1e-6)


def _alike(slips: float, alike: float) -> Column:
    """Enough labelled 2-mers agree, whatever the order of the parts."""
    grams = {s: _profiles(F.replace(F.col(f"title_{s}"), F.lit(" "), F.lit(""))) for s in "ab"}
    return (F.abs(F.col("size_a") - F.col("size_b")) <= _limit(slips)) & (2 * F.size(F.array_intersect(grams["a"], grams["b"])) >= alike * _profile_sizes())


#: Title lengths beyond this share a key where durations are unknown.
WIDE = 64
#: Parts in which rows are joined one after the other.
ROUNDS = 4

CARRIED = ["id", "duration", "title", "size", "letters", "grams"]


def same_recordings(df: DataFrame, ident: str, title: str, artists: str, duration: str, apart: int = 2500, slips: float = 0.28, alike: float = 0.74) -> tuple[DataFrame, DataFrame]:
    """Pairs of records that are one recording; returns ``(pairs, members)``.

    Rows with equal folded title words, take, numbers, performers and duration
    fold into a class named by its smallest id: ``members`` has ``(id, rep)`` of
    all usable rows, ``pairs`` has ``a < b`` between class names.

    Two classes are one recording when a performer agrees but for slips, take and
    numbers are equal, durations differ by at most ``apart`` ms and the titles
    agree. Candidates are those that satisfy all but the last: names that agree
    are found once among the distinct ones by pieces that must be equal
    (``name_keys``), rows meet under the more frequent name of such a pair, and
    in stretches of time or, where a duration is unknown, of title length. So no
    candidate is missed, however many rows a title or a name has, and none is
    written: titles are compared inside the join, by sets of bits that rule most
    out, then by banded alignment: at most ``slips`` of the shorter title in
    edits (at least 2) between the titles, their sorted words, or any rotation of
    one title's words and the other; or, where parts moved and lost their spaces,
    ``alike`` of their labelled 2-mers agree. The work is quadratic in the rows
    that one performer has in a stretch of 10 seconds.

    Null ids, null or blank titles or artists give no rows; a title that is
    nothing but labels counts as its own words; an unknown duration agrees with
    any; repeated ids count once.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "recordings", free=True)
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(title).alias("title"), F.col(artists).alias("artists"), F.col(duration).cast("long").alias("duration"))
    rows = rows.where(F.col("id").isNotNull() & F.col("title").rlike(WORDY) & F.col("artists").rlike(WORDY))
    same = ["title", "take", "numbers", "duration", "names"]
    keyed = rows.mapInArrow(_parse, _PARSED).withColumn("key", F.unhex(F.sha2(F.to_json(F.struct(*same)), 256)))
    once = keyed.repartition("key").dropDuplicates(["key", "id"])
    classes = scratch.save(once.withColumn("rep", F.min("id").over(Window.partitionBy("key"))).drop("key"))
    members = scratch.save(classes.select("id", "rep").distinct())

    own = classes.where("id = rep").select(F.explode("names").alias("name"), "take", "numbers", *CARRIED)
    near = scratch.save(_near_names(scratch.save(own.groupBy("name").agg(F.count("*").alias("n")))))
    guests = scratch.save(own.join(near, "name").drop("name").withColumnRenamed("host", "name"))
    every = own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))

    def meet(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        keys = ["name", "take", "numbers", *keys]
        a = left.select(*keys, *[F.col(c).alias(f"{c}_a") for c in CARRIED])
        b = right.select(*keys, "guest", *[F.col(c).alias(f"{c}_b") for c in CARRIED])
        in_time = F.coalesce(F.abs(F.col("duration_a") - F.col("duration_b")) <= apart, F.lit(True))
        ordered = F.when(F.col("guest") | F.col("duration_a").isNull() | F.col("duration_b").isNull(), F.col("id_a") != F.col("id_b")).otherwise(F.col("id_a") < F.col("id_b"))
        both = a.join(b.hint("merge"), keys).where(ordered & in_time).where(_maybe_alike(slips, alike) | _aligned(slips))
        return both.select(*[f"{c}_{s}" for c in ("id", "title", "size", "letters") for s in "ab"])

    slot = F.floor(F.col("duration") / (2 * apart))
    beside = F.when(F.col("duration") - slot * 2 * apart < apart, slot - 1).otherwise(slot + 1)
    timed = own.where("duration is not null").withColumn("slot", slot), every.where("duration is not null").withColumn("slot", F.explode(F.array(slot, beside))), ["slot"]
    reach = F.greatest(F.lit(2), F.floor(F.col("size") * slips)).cast("int")
    sized = F.least(F.col("size"), F.lit(WIDE))
    sizes = F.explode(F.sequence(F.least(F.col("size") - reach, F.lit(WIDE)), F.least(F.col("size") + reach, F.lit(WIDE))))
    open_ = own.withColumn("wide", sized), every.where("duration is null").withColumn("wide", sizes), ["wide"]
    open_hosts = own.where("duration is null").withColumn("wide", sizes), every.where("guest and duration is not null").withColumn("wide", sized), ["wide"]
    sides = [timed, open_, open_hosts]
    # Names in rounds, so that only a part of the rows lies on disk for the join at any time.
    turn = F.pmod(F.xxhash64("name"), F.lit(ROUNDS))
    rounds = [scratch.save(reduce(DataFrame.unionByName, [meet(left.where(turn == r), right.where(turn == r), *keys) for left, right, keys in sides])) for r in range(ROUNDS)]
    found = reduce(DataFrame.unionByName, rounds).where(_aligned(slips) | _alike(slips, alike))
    return scratch.save(found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()), members
