"""Dates of partial precision in texts, by a closed grammar. Anything else is null and can't be compared.

Forms: YYYY, YYYY-MM, YYYY-MM-DD (with a sign, and with a time after a T or a space); March 5, 1998; 5 March 1998; 5th of March,
1998; March 1998, with months also by three letters. A year has four digits. A leading minus or a trailing BC or BCE makes it
negative. A date whose month or day can't be is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months: fixed values. Three letters tell them apart.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(f"{name[:3]}(?:{name[3:]})?" if name[3:] else name for name in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?")
_DAY = "[0-9]{1,2}(?:st|nd|rd|th)?"
#: What a text of a date looks like, in lower case, without its era.
FORMS = rf"^(?:-?[0-9]{{4}}(?:-[0-9]{{2}}(?:-[0-9]{{2}})?)?(?:[t ][0-9].*)?|(?:{_MONTH})\.?(?: +{_DAY})?,? +[0-9]{{4}}|{_DAY} +(?:of +)?(?:{_MONTH})\.?,? +[0-9]{{4}})$"
BEFORE, ERA = r" *b\.?c\.?(?:e\.?)?$", r" *(?:a\.?d\.?|c\.?e\.?)$"
#: Markers of approximation before a year: fixed grammar.
APPROXIMATE = r"(?i)^(?:(?:approximately|approx\.?|circa|about|around|ca\.?|c\.?|~)\s+|~\s*)([0-9]{4})$"


def parts(c: Column) -> Column:
    """struct(y, m, d): what the text tells; make it a column of its own before it is used several times.

    The struct as a whole is conditional: Spark puts a plain one's fields, with all their patterns, in the place of each use.
    """
    low = F.lower(F.regexp_replace(F.trim(c), r"^\+", ""))
    text = F.regexp_replace(F.regexp_replace(low, BEFORE, ""), ERA, "")
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    named = F.instr(F.lit("".join(name[:3] for name in MONTHS)), F.substring(F.regexp_extract(text, f"({_MONTH})", 1), 1, 3))
    y = number("([0-9]{4})")
    m = F.when(text.rlike("^-?[0-9]{4}"), number("^-?[0-9]{4}-([0-9]{2})")).otherwise(F.floor((named + 2) / 3).cast("int"))
    d = F.coalesce(number("^-?[0-9]{4}-[0-9]{2}-([0-9]{2})"), number(r"(?:^|[a-z.] +)([0-9]{1,2})(?:st|nd|rd|th)?[, ]"))
    sound = text.rlike(FORMS) & F.coalesce(m.between(1, 12), F.lit(True)) & F.coalesce(d.between(1, 31), F.lit(True))
    signed = F.when(low.rlike(BEFORE) | F.startswith(text, F.lit("-")), -y).otherwise(y)
    return F.when(sound, F.struct(signed.alias("y"), m.alias("m"), d.alias("d")))


def year(c: Column) -> Column:
    return parts(c)["y"]


def month(c: Column) -> Column:
    return parts(c)["m"]


def day(c: Column) -> Column:
    return parts(c)["d"]


def level(told: Column) -> Column:
    """Of parts(): 3 with a day, 2 with a month, 1 with a year, else null."""
    return F.when(told["d"].isNotNull(), 3).when(told["m"].isNotNull(), 2).when(told["y"].isNotNull(), 1)


def precision(c: Column) -> Column:
    return level(parts(c))


def sort_key(told: Column) -> Column:
    """A number for parts() in the order of time, years before Christ first; what isn't told counts as the beginning."""
    return (told["y"] * 12 + F.coalesce(told["m"], F.lit(1)) - 1) * 31 + F.coalesce(told["d"], F.lit(1)) - 1


def approximate_year(c: Column) -> Column:
    """The year after one leading marker of approximation; null unless nothing but a year follows."""
    return F.nullif(F.regexp_extract(F.trim(c), APPROXIMATE, 1), F.lit(""))


def relation(claimed: Column, known: Column) -> Column:
    """relation_of() for texts."""
    return relation_of(parts(claimed), parts(known))


def relation_of(claimed: Column, known: Column) -> Column:
    """match, mismatch, or null where the two (as parts()) can't be told apart.

    Other years differ. A known first of January may stand for its year and a known first of a month for its month. A claim
    that is finer than what is known, or another month or day of the same year, tells nothing.
    """
    fine, known_fine = level(claimed), F.when((known["d"] == 1) & (known["m"] == 1), 1).when(known["d"] == 1, 2).otherwise(level(known))
    off = (claimed["m"] != known["m"]) | ((fine == 3) & (claimed["d"] != known["d"]))
    return (
        F.when(fine.isNull() | known_fine.isNull(), None).when(claimed["y"] != known["y"], "mismatch").when(fine > known_fine, None)
        .when((fine >= 2) & off, None).otherwise("match")
    )


def earliest(c: Column) -> Column:
    """The first day that a text may mean; null before Christ, and for days that a month hasn't."""
    return first_day(parts(c))


def latest(c: Column) -> Column:
    """The last day that a text may mean."""
    return last_day(parts(c))


def first_day(told: Column) -> Column:
    return _day_of(told, 1)


def last_day(told: Column) -> Column:
    return F.when(told["d"].isNotNull(), _day_of(told, 1)).otherwise(F.last_day(_day_of(told, 12)))


def _day_of(told: Column, month_else: int) -> Column:
    text = F.format_string("%04d-%02d-%02d", told["y"], F.coalesce(told["m"], F.lit(month_else)), F.coalesce(told["d"], F.lit(1)))
    return F.when(told["y"] > 0, text).try_cast("date")


def provably_past(end: Column, now: Column) -> Column:
    return F.coalesce(latest(end) < now, F.lit(False))


def provably_future(start: Column, now: Column) -> Column:
    return F.coalesce(earliest(start) > now, F.lit(False))


def present_unscoped(start: Column, end: Column) -> Column:
    return start.isNull() & end.isNull()


def compatible(start: Column, end: Column, valid_from: Column, valid_until: Column, now: Column) -> Column:
    """Whether a statement from start to end can bear out a claim from valid_from to valid_until (ISO text, in its order)."""
    return compatible_with(start, end, valid_from, valid_until, provably_past(end, now), provably_future(start, now))


def compatible_with(start: Column, end: Column, valid_from: Column, valid_until: Column, past: Column, ahead: Column) -> Column:
    """compatible(), with what is known already of the statement's end (past) and start (ahead)."""
    ended = valid_until.isNull() & valid_from.isNull() & past
    early = F.coalesce(valid_from < start, F.lit(False))
    late = F.coalesce((valid_until != "before_present") & (valid_until > end), F.lit(False))
    return (start.isNull() & end.isNull()) | ~(ended | ahead | early | late)
