"""Column expressions shared by the operators. Missing is NULL, never NaN; a ratio without a denominator is what the caller says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, ``empty`` where the denominator is 0 or null."""
    found = F.try_divide(num.cast("double"), den.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(float(empty)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; (0, 0) without trials."""
    p, m = ratio(successes, n), n.cast("double")
    centre = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * m), 1 + F.try_divide(F.lit(z * z), m))
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m)), 1 + F.try_divide(F.lit(z * z), m))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def wrap(angle: Column) -> Column:
    """An angle in radians to [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def majority_f1(positives: Column, n: Column) -> Column:
    """F1 of always answering the majority class; ties go to positive."""
    return F.when(2 * positives >= n, ratio(2 * positives, positives + n)).otherwise(0.0)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 where a margin is empty; factors are doubles before they are multiplied."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """World offsets (x, y) in the frame that is turned by ``angle``: forward, left."""
    return x * F.cos(angle) + y * F.sin(angle), -x * F.sin(angle) + y * F.cos(angle)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of struct(x, y), open or closed; edges count from below and from the left."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, F.size(ring)))
        at = a.x + F.try_divide((y - a.y) * (b.x - a.x), b.y - a.y)
        return F.when(((a.y <= y) != (b.y <= y)) & (x < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return (F.size(ring) >= 3) & (hits % 2 == 1)


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside an odd number of rings: the outer ring and not a hole."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + point_in_ring(x, y, r).cast("int")) % 2 == 1


def answer_key(text: Column, vocabulary: Column | None = None) -> Column:
    """An answer made comparable: lower case, no articles, single spaces, and singular if that is a known word."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[.!?,;:]+$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))
    if vocabulary is None:
        return plain
    singular = F.regexp_replace(plain, "s$", "")
    return F.when(~F.array_contains(vocabulary, plain) & F.array_contains(vocabulary, singular), singular).otherwise(plain)


def hour_of_log(name: Column) -> Column:
    """The hour in a log name such as n015-2018-07-24-11-22-45+0800; null where there is none."""
    hour = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}-(\d{2})-\d{2}-\d{2}", 1)
    return F.try_to_number(F.nullif(hour, F.lit("")), F.lit("99")).cast("int")


def lighting(hour: Column) -> Column:
    return F.when(hour.isNull(), "unknown").when((hour >= 18) | (hour < 6), "night").otherwise("day")


# Answers that are the same answer, subjects that a phrase may open with, and directions as seen from the car.
SYNONYMS = {"bike": "bicycle", "bikes": "bicycle", "cone": "traffic cone", "cones": "traffic cone", "in motion": "moving"}
SUBJECTS = ("the car is ", "the car ", "there is ", "at least one ")
EGO_DIRECTION = r"\b(front left|front right|back left|back right|front|back)\s+of me\b"


def synonym(answer: Column) -> Column:
    """An answer by the name it is scored under."""
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, answer), answer)


def without_subject(phrase: Column) -> Column:
    """A phrase without the first subject of the list that it opens with."""
    out = phrase
    for lead in reversed(SUBJECTS):
        out = F.when(phrase.startswith(lead), F.substr(phrase, F.lit(len(lead) + 1))).otherwise(out)
    return out


def ego_direction(question: Column) -> Column:
    """The direction a question names as seen from the car; null where it names none."""
    return F.nullif(F.regexp_extract(F.lower(question), EGO_DIRECTION, 1), F.lit(""))


def relation(question: Column, names: list[str]) -> Column:
    """The first of the names that a question holds as whole words, longer names before shorter ones; null without one."""
    alternatives = "|".join(sorted(names, key=lambda n: (-len(n), n)))
    return F.nullif(F.regexp_extract(F.lower(question), rf"\b({alternatives})\b", 1), F.lit(""))


def stem(path: Column) -> Column:
    """A file's name without its folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"(?<=.)\.[^.]*$", "")


def caption(lateral: Column, longitudinal: Column, setting: Column, actors: Column, partial: Column) -> Column:
    """What the car does, where it is and who is there, as sentences; the last three are arrays of phrases, most telling first."""
    some = lambda lead, names, n: F.when(
        F.size(names) > 0,
        F.concat(F.lit(lead), F.array_join(F.slice(names, 1, n), "; "), F.when(F.size(names) > n, F.format_string(" (+%d more)", F.size(names) - n)).otherwise(""), F.lit(".")),
    ).otherwise("")
    ego = F.concat(F.upper(F.substr(lateral, F.lit(1), F.lit(1))), F.substr(lateral, F.lit(2)), F.lit(", "), without_subject(longitudinal), F.lit("."))
    first = F.when(F.size(setting) > 0, F.concat(F.lit(" "), F.initcap(F.substr(F.get(setting, F.lit(0)), F.lit(1), F.lit(1))), F.substr(F.get(setting, F.lit(0)), F.lit(2)), F.lit("."))).otherwise("")
    return F.concat(ego, first, some(" Also: ", actors, 3), some(" Briefly: ", partial, 2))
