"""Dates as pages write them, read by the roles of their parts.

A text is taken apart into words and numbers. The time and its zone are found first; each part that
is left is a month by its name, a number, a word that says nothing (a day of the week, "of") or
unknown, which makes the whole no date. Year, month and day then follow from how many numbers there
are, how long they are and what stands between them. Parts that are missing are never taken from
today: a date without a time begins the day, one without a day begins the month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.arrays import let

# Names of months in English, French, German, Spanish, Italian and Portuguese.
MONTHS = (
    ("january", "janvier", "januar", "jänner", "enero", "gennaio", "janeiro"),
    ("february", "février", "fevrier", "februar", "febrero", "febbraio", "fevereiro"),
    ("march", "mars", "märz", "maerz", "marzo", "março"),
    ("april", "avril", "abril", "aprile"),
    ("may", "mai", "mayo", "maggio", "maio"),
    ("june", "juin", "juni", "junio", "giugno", "junho"),
    ("july", "juillet", "juli", "julio", "luglio", "julho"),
    ("august", "août", "aout", "agosto"),
    ("september", "septembre", "septiembre", "settembre", "setembro"),
    ("october", "octobre", "oktober", "octubre", "ottobre", "outubro"),
    ("november", "novembre", "noviembre", "novembro"),
    ("december", "décembre", "decembre", "dezember", "diciembre", "dicembre", "dezembro"),
)
# Days of the week in these languages, and words that say nothing about the date.
DAYS = (
    "monday tuesday wednesday thursday friday saturday sunday lundi mardi mercredi jeudi vendredi samedi "
    "dimanche montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag lunes martes miércoles "
    "jueves viernes sábado domingo lunedì martedì mercoledì giovedì venerdì sabato domenica segunda terça "
    "quarta quinta sexta feira"
).split()
SHORT_DAYS = "mon tue tues wed thu thur thurs fri sat sun lun mer jeu ven sam dim mo di mi do fr sa so".split()
FILLERS = "at on and of the t le de del do den der am um uhr à a el las il alle às".split()
# Hours from Greenwich of zones written by name.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00",
    "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "cet": "+01:00",
    "cest": "+02:00", "bst": "+01:00", "jst": "+09:00",
}
PIVOT = 69  # years of two digits from here on are of the last century


def _month_numbers() -> dict[str, int]:
    """Every name and every beginning of three letters and more that means one month alone."""
    found: dict[str, set[int]] = {}
    for number, names in enumerate(MONTHS, 1):
        for name in names:
            for size in range(3, len(name) + 1):
                found.setdefault(name[:size], set()).add(number)
    return {name: min(numbers) for name, numbers in found.items() if len(numbers) == 1}


_NAMED_ZONE = "|".join(sorted(ZONES, key=len, reverse=True))
_TIME = (
    r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?\s?m\b\.?)?"
    rf"(?:\s*\(?({_NAMED_ZONE})\b\)?)?(?:\s*([+-]\d{{2}}):?(\d{{2}})?(?![\d-]))?(?:\s*\([a-z ]*\))?"
)
_PART = r"\d+|[\p{L}\p{M}]+"
# Other ways to write what the rest understands.
_SPELT = (
    (r"(\d+)\s*[年년]\s*(\d+)\s*[月월]\s*(\d+)\s*[日일]", "$1-$2-$3"),
    (r"(\d+)\s*[年년]\s*(\d+)\s*[月월]", "$1-$2"),
    (r"(\d+)\s*[時시]\s*(\d+)\s*[分분](?:\s*(\d+)\s*[秒초])?", "$1:$2"),
    (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?)?(?![\d-])", "$1-$2-$3 $4:$5:$6"),
    (r" (:+)(?=$|\D)", " "),
    (r"(\d{2}):(?=$|[^\d])", "$1"),
    (r"(?<![\d:])(\d{1,2})\s?h\s?(\d{2})(?!\d)", "$1:$2"),
    (r"(?<![\d:.])(\d{1,2})\s*([ap])\.?\s?m\b\.?", "$1:00 $2m"),
    (r"(?<=\d)(?:st|nd|rd|th|er|re|º|ª|°)(?![\p{L}\d])", ""),
    (r"(?<=\d)\.(?=\s)", " "),
)


def _words(names: dict[str, str] | dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("999999999")).cast("int")


def _full_year(number: Column) -> Column:
    short = F.length(number) <= 2
    value = number.cast("int")
    return F.when(short, value + F.when(value < PIVOT, 2000).otherwise(1900)).otherwise(value)


def _day(numbers: Column, month: Column, dotted: Column) -> Column:
    """``struct<y, m, d>`` of the numbers, texts of digits, and of the month's number if it has a name."""
    a, b, c = (F.get(numbers, F.lit(i)) for i in range(3))
    n = F.size(numbers)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.struct(_full_year(y).alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))

    def long(x: Column) -> Column:
        return F.length(x) == 4

    first = F.lit("1")
    year_first = F.when(b.cast("int") > 12, made(a, c, b)).otherwise(made(a, b, c))
    day_first = dotted | (a.cast("int") > 12)
    return (
        F.when(F.exists(numbers, lambda x: F.length(x) > 4), None)
        .when(month.isNotNull() & (n == 2), F.when(long(a) | (a.cast("int") > 31), made(a, month, b)).otherwise(made(b, month, a)))
        .when(month.isNotNull() & (n == 1) & long(a), made(a, month, first))
        .when(month.isNotNull(), None)
        .when((n == 3) & (long(a) | ((a.cast("int") > 31) & ~long(c))), year_first)
        .when((n == 3) & day_first, made(c, b, a))
        .when(n == 3, made(c, a, b))
        .when((n == 2) & long(a) & ~long(b), made(a, b, first))
        .when((n == 2) & long(b) & ~long(a), made(b, a, first))
    )


def _assembled(s: Column) -> Column:
    """The moment that a normalised text means."""
    has_time = F.rlike(s, F.lit(_TIME))
    hour, half = _number(s, _TIME, 1), F.regexp_extract(s, _TIME, 5)
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    fraction = F.rpad(F.regexp_extract(s, _TIME, 4), 6, "0")
    second = F.concat_ws(".", F.coalesce(_number(s, _TIME, 3), F.lit(0)).cast("string"), fraction)
    offset = F.when(
        F.regexp_extract(s, _TIME, 7) != "",
        F.concat(F.regexp_extract(s, _TIME, 7), F.lit(":"), F.rpad(F.regexp_extract(s, _TIME, 8), 2, "0")),
    )
    zone = F.coalesce(offset, F.try_element_at(_words(ZONES), F.regexp_extract(s, _TIME, 6)), F.current_timezone())
    rest = F.regexp_replace(s, _TIME, " ")
    silent = [*DAYS, *SHORT_DAYS, *FILLERS]

    def moment(p: Column) -> Column:
        named = F.filter(p["parts"], lambda x: ~F.rlike(x, F.lit(r"^\d")) & ~x.isin(silent))
        months = F.transform(named, lambda x: F.try_element_at(_words(_month_numbers()), x))
        numbers = F.filter(p["parts"], lambda x: F.rlike(x, F.lit(r"^\d")))
        day = _day(numbers, F.get(months, F.lit(0)), p["dotted"])
        known = (F.size(named) <= 1) & ~F.exists(months, lambda m: m.isNull())
        zero = F.lit(0)
        return F.when(
            known,
            let(
                day,
                lambda d: F.try_make_timestamp(
                    d["y"], d["m"], d["d"],
                    F.when(p["timed"], p["hour"]).otherwise(zero),
                    F.when(p["timed"], p["minute"]).otherwise(zero),
                    F.when(p["timed"], p["second"]).otherwise(F.lit(0).cast("decimal(16,6)")),
                    F.when(p["timed"], p["zone"]).otherwise(F.current_timezone()),
                ),
            ),
        )

    parts = F.struct(
        F.regexp_extract_all(rest, F.lit(_PART), F.lit(0)).alias("parts"),
        F.rlike(rest, F.lit(r"\d\.\s?\d")).alias("dotted"),
        has_time.alias("timed"),
        hour.alias("hour"),
        _number(s, _TIME, 2).alias("minute"),
        second.cast("decimal(16,6)").alias("second"),
        zone.alias("zone"),
    )
    return let(parts, moment)


def _by_week(s: Column) -> Column:
    """ISO weeks, as 2024-W01-5, and days of the year, as 2024-005."""
    week = r"^(\d{4})-?w(\d{2})(?:-?([1-7]))?$"
    fourth = F.make_date(_number(s, week, 1), F.lit(1), F.lit(4))
    days = (_number(s, week, 2) - 1) * 7 + F.coalesce(_number(s, week, 3), F.lit(1)) - 1 - F.weekday(fourth)
    nth = r"^(\d{4})-(\d{3})$"
    start = F.make_date(_number(s, nth, 1), F.lit(1), F.lit(1))
    number = _number(s, nth, 2)
    return F.coalesce(
        F.when(_number(s, week, 2).between(1, 53), F.date_add(fourth, days)),
        F.when(number.between(1, 366), F.date_add(start, number - 1)),
    ).cast("timestamp")


def parse_date(text: Column) -> Column:
    """The moment that ``text`` names, or null.

    Where the order of three short numbers is open, a dot between them means day, month, year, and
    anything else month, day, year, unless the first is no month. Ten digits are seconds since 1970,
    thirteen are milliseconds. A time without a zone is of the session's zone.
    """
    digits = "".join(map(chr, range(0xFF10, 0xFF1A)))
    s = F.lower(F.trim(F.translate(F.regexp_replace(text, r"[\s\x{a0}\x{202f}]+", " "), digits, "0123456789")))

    def read(plain: Column) -> Column:
        spelt = plain
        for pattern, plainer in _SPELT:
            spelt = F.regexp_replace(spelt, pattern, plainer)
        return (
            F.when(F.rlike(plain, F.lit(r"^\d{10}$")), F.timestamp_seconds(F.try_to_number(plain, F.lit("9" * 13)).cast("long")))
            .when(F.rlike(plain, F.lit(r"^\d{13}$")), F.timestamp_millis(F.try_to_number(plain, F.lit("9" * 13)).cast("long")))
            .when(F.rlike(plain, F.lit(r"^\d{4}-?w\d{2}(-?[1-7])?$|^\d{4}-\d{3}$")), _by_week(plain))
            .otherwise(let(spelt, _assembled))
        )

    return let(s, read)
