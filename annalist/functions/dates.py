"""Dates kept as text, parsed strictly, and shown by their precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FAR_DAYS = 10**9


def iso_date(c: Column) -> Column:
    """First ten characters as a date; anything but YYYY-MM-DD gives NULL."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), head.try_cast("date"))


def day_gap(a: Column, b: Column) -> Column:
    """Absolute distance in days, NULL if either date is unknown."""
    return F.abs(F.datediff(a, b))


def compact_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD text."""
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))


def mail_date(c: Column) -> Column:
    """Calendar day of an RFC 2822 date in its own offset, as text; NULL if unreadable."""
    day = F.regexp_extract(c, r"(?i)\b(\d{1,2}\s+[a-z]{3}\s+\d{4})\s+\d{1,2}:\d{2}", 1)
    clean = F.initcap(F.regexp_replace(day, r"\s+", " "))
    return F.try_to_date(clean, "d MMM yyyy").cast("string")


# The words of a displayed date.
DATE_WORDS = {"unknown": "날짜 미상", "year": "년", "month": "월", "day": "일", "quarter": "분기"}


def date_label(value: Column, precision: Column, words: dict[str, str] | None = None) -> Column:
    """Date text cut to its precision: year, year+quarter, year+month, or in full."""
    w = words or DATE_WORDS
    parts = F.split(F.substring(value, 1, 10), "-", -1)
    year, month, day = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    number = r"\A\s*[+-]?\d+\s*\z"
    m, d = F.trim(month).try_cast("int"), F.trim(day).try_cast("int")
    y_txt = F.concat(year, F.lit(w["year"]))
    m_txt = F.concat(m.cast("string"), F.lit(w["month"]))
    d_txt = F.concat(d.cast("string"), F.lit(w["day"]))
    quarter = F.floor((m - 1) / F.lit(3)).cast("int") + 1
    q_txt = F.concat(quarter.cast("string"), F.lit(w["quarter"]))
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.lit(w["unknown"]))
        .when((F.size(parts) != 3) | ~month.rlike(number) | ~day.rlike(number), value)
        .when(precision == "year", y_txt)
        .when(precision == "quarter", F.concat_ws(" ", y_txt, q_txt))
        .when(precision == "month", F.concat_ws(" ", y_txt, m_txt))
        .otherwise(F.concat_ws(" ", y_txt, m_txt, d_txt))
    )


# Display words of the stored enumerations.
REVIEW_STATUS_WORDS = {
    "auto_applied": "자동 적용됨",
    "auto_valid": "자동 검증됨",
    "pending": "검토 대기",
    "approved": "승인됨",
    "rejected": "거부됨",
}
STAGE_WORDS = {"announce": "발표", "build": "구축", "pilot": "파일럿", "launch": "출시", "scale": "확장"}
SOURCE_TYPE_WORDS = {
    "dart": "공시(DART)",
    "ir": "IR 자료",
    "press_release": "보도자료",
    "tech_blog": "기술 블로그",
    "ceo_letter": "CEO 서한",
    "news": "뉴스",
}
MATCH_METHOD_WORDS = {"exact": "정확히 일치", "fuzzy_rapidfuzz": "유사 일치", "rejected": "불일치"}


def word_for(c: Column, words: dict[str, str], default: str | None = None) -> Column:
    """Display word of a stored value; unknown values show themselves or ``default``."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    value = F.coalesce(c, F.lit(""))
    return F.coalesce(table[value], value if default is None else F.lit(default))
