"""Dates as people write them, read by one SQL expression.

In this grammar letters count in any case, and commas and repeated spaces as one space::

    moment  = [weekday] date [("T" | " " | " at ") time [zone]]
    date    = year s month s day | year2 month2 day2          2024-2-13, 2024/02/13, 20240213
            | number s number s (year | yy)                    2/13/2024: month and day, or day and month
            | day[th] [s] ["of"] name [s] (year | yy)          13th of February 2024, 13-Feb-24
            | name [s] day[th] s year                          Feb. 13, 2024
            | year [s] name [s] day                            2024 Feb 13
            | name s year                                      February 2024: its first day
    time    = hour [":" minute [":" second ["." fraction]]] ["am" | "pm"]     needs a colon, am or pm
    zone    = "Z" | "UTC" | "GMT" | ("+" | "-") hours [":"] minutes
    s       = "-" | "/" | "." | " "                            alike in both places of all-number dates

``name`` is an English month or its first three letters (also "sept"), ``weekday`` an English day or its abbreviation, ``yy``
a year of 1969 to 2068. A day that does not exist is no date. Whether the month or the day comes first in all-number dates
is one choice for a whole column.
"""

from __future__ import annotations

# English names of days and months.
_WEEKDAY = "(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)[.]?"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_REST = "((?:t| ).*)?$"
_MONTH_FIRST, _DAY_FIRST = "$4|$1|$3|$5", "$4|$3|$1|$5"
#: Forms of a date, and where its year, month, day and the rest stand.
_FORMS = [
    (rf"^(\d{{4}})([-/. ])(\d{{1,2}})\2(\d{{1,2}}){_REST}", "$1|$3|$4|$5"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_REST}", "$1|$2|$3|$4"),
    (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_REST}", _MONTH_FIRST),
    (rf"^(\d{{1,2}})[-/. ]?{_MONTH}[-/. ]?(\d{{4}}|\d{{2}}){_REST}", "$3|$2|$1|$4"),
    (rf"^{_MONTH}[-/. ]?(\d{{1,2}})[-/. ](\d{{4}}){_REST}", "$3|$1|$2|$4"),
    (rf"^(\d{{4}})[-/. ]?{_MONTH}[-/. ]?(\d{{1,2}}){_REST}", "$1|$2|$3|$4"),
    (rf"^{_MONTH}[-/. ](\d{{4}})()$", "$2|$1|1|$3"),
]
_TIME = r"^(?:t| at | )(\d{1,2})(?::(\d{2})(?::(\d{2}(?:[.]\d{1,9})?))?)? ?(am|pm)? ?(z|utc|gmt|[+-]\d{2}:?\d{2})?$"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def free_date_sql(text: str, *, day_first: bool = False) -> str:
    """The timestamp that ``text`` (SQL for a string) stands for, NULL if the grammar does not read it."""
    tidy = f"regexp_replace(lower(trim({text})), r'^{_WEEKDAY}[.,]? +', '')"
    tidy = f"regexp_replace({tidy}, r'(\\d)(?:st|nd|rd|th)\\b', '$1')"
    tidy = f"trim(regexp_replace({tidy}, r'[ ,]+(?:of +)?', ' '))"
    turned = {_MONTH_FIRST: _DAY_FIRST} if day_first else {}
    orders = [(form, turned.get(order, order)) for form, order in _FORMS]
    forms = " ".join(f"WHEN t RLIKE r'{form}' THEN regexp_replace(t, r'{form}', '{order}')" for form, order in orders)
    year = "CAST(d[0] AS INT) + IF(length(d[0]) = 4, 0, IF(CAST(d[0] AS INT) < 69, 2000, 1900))"
    month = f"IF(d[1] RLIKE '^[a-z]', CAST((instr('{_MONTHS}', left(d[1], 3)) + 2) / 3 AS INT), try_cast(d[1] AS INT))"
    day = f"{year}, {month}, CAST(d[2] AS INT)"

    def of(group: int) -> str:
        return f"regexp_extract(d[3], r'{_TIME}', {group})"

    hour = f"CAST({of(1)} AS INT)"
    halves = f"IF({hour} BETWEEN 1 AND 12, {hour} % 12 + IF({of(4)} = 'pm', 12, 0), NULL)"
    clock = f"IF({of(4)} = '', {hour}, {halves}), CAST(coalesce(nullif({of(2)}, ''), '0') AS INT), "
    clock += f"CAST(coalesce(nullif({of(3)}, ''), '0') AS DECIMAL(16, 6))"
    zone = f"IF({of(5)} IN ('z', 'utc', 'gmt'), '+00:00', regexp_replace({of(5)}, r'^(...):?(..)$', '$1:$2'))"
    timed = f"IF({of(5)} = '', try_make_timestamp({day}, {clock}), try_make_timestamp({day}, {clock}, {zone}))"
    made = f"CASE WHEN d[3] = '' THEN try_make_timestamp({day}, 0, 0, 0) WHEN d[3] RLIKE r'{_TIME}' AND d[3] RLIKE ':|am|pm' THEN {timed} END"
    return _let(tidy, "t", _let(f"split(CASE {forms} END, '[|]')", "d", made))
