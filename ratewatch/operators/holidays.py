"""Public holidays of Colombia by their rules, for any year."""

from __future__ import annotations

from datetime import date, timedelta

#: Holidays that stay on their day (month, day).
FIXED = {"New Year": (1, 1), "Labour Day": (5, 1), "Independence": (7, 20), "Boyacá": (8, 7), "Immaculate Conception": (12, 8), "Christmas": (12, 25)}
#: Holidays that are kept on the Monday on or after their day.
TO_MONDAY = {"Epiphany": (1, 6), "Saint Joseph": (3, 19), "Peter and Paul": (6, 29), "Assumption": (8, 15), "Columbus Day": (10, 12), "All Saints": (11, 1), "Cartagena": (11, 11)}
#: Days after Easter Sunday.
BY_EASTER = {"Maundy Thursday": -3, "Good Friday": -2, "Ascension": 43, "Corpus Christi": 64, "Sacred Heart": 71}


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar: the Sunday after the first full moon on or after 21 March."""
    golden, century = year % 19, year // 100
    leap_loss = century - century // 4
    moon_gain = (8 * century + 13) // 25
    age = (19 * golden + leap_loss - moon_gain + 15) % 30
    if age == 29 or age == 28 and golden > 10:
        age -= 1
    moon = date(year, 3, 21) + timedelta(age)
    return moon + timedelta(6 - moon.weekday() or 7)


def colombian(year: int) -> dict[str, date]:
    """The holidays of a year by name."""
    monday = lambda d: d + timedelta(-d.weekday() % 7)
    return (
        {name: date(year, *day) for name, day in FIXED.items()}
        | {name: monday(date(year, *day)) for name, day in TO_MONDAY.items()}
        | {name: easter(year) + timedelta(after) for name, after in BY_EASTER.items()}
    )
