"""Names, dates and wind: scalar columns of the staging and feature layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, one to one.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: The eight points of the compass, clockwise from north.
CARDINALS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def fold(name: Column) -> Column:
    """Lower case without accents and apostrophes; other punctuation is one blank, blanks collapse."""
    low = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(low, "['’`]", ""), "[^a-z0-9]+", " "))


def school(name: Column) -> Column:
    """``fold`` with a trailing ``st`` read as state and a leading ``st`` as saint."""
    return F.regexp_replace(F.regexp_replace(fold(name), r" st$", " state"), r"^st ", "saint ")


def without_mascot(name: Column, mascots: list[str]) -> Column:
    """The folded name rid of the longest of some trailing mascots, unless nothing would be left."""
    out = fold(name)
    longest = sorted({m.lower() for m in mascots}, key=lambda m: (-len(m), m))
    return F.regexp_replace(out, rf"^(.+?) (?:{'|'.join(longest)})$", "$1")


def season_of(day: Column) -> Column:
    """July to December belong to the calendar year's season, January to June to the one before."""
    return F.year(day) - (F.month(day) < 7).cast("int")


def eastern(ts: Column) -> Column:
    """Wall clock of the US east coast of a UTC time (a timestamp without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def decision_time(kickoff: Column) -> Column:
    """Noon of the last Sunday strictly before the day of a (zone-less) kickoff: a Sunday game goes back a week."""
    noon = F.date_trunc("day", kickoff).cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")
    back = F.dayofweek(kickoff) - 1
    return noon - F.make_dt_interval(F.when(back == 0, 7).otherwise(back))


def compass(degrees: Column) -> Column:
    """The nearest of eight points; ties turn clockwise."""
    return F.element_at(F.array(*map(F.lit, CARDINALS)), (F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45).cast("int") % 8) + 1)


def wind(speed: Column, from_degrees: Column, axis_degrees: Column, calm: float = 5.0) -> dict[str, Column]:
    """Components of wind along and across a field's axis and the kind of wind.

    The angle to the axis lies between 0 (along) and 90 (across); up to 30 is head or tail wind, from
    60 on crosswind, between them quartering; below ``calm`` the kind is calm.
    """
    turn = F.pmod(from_degrees - axis_degrees, F.lit(180.0))
    angle = F.least(turn, 180.0 - turn)
    kind = F.when(speed < calm, "Calm").when(angle <= 30, "Head-Tail").when(angle >= 60, "Crosswind").otherwise("Quartering")
    return {"angle": angle, "along": F.abs(speed * F.cos(F.radians(angle))), "across": F.abs(speed * F.sin(F.radians(angle))), "kind": F.when(speed.isNotNull() & angle.isNotNull(), kind)}
