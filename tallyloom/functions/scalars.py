"""Column functions over captions, amounts and dates; all are plain expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of printed cells, and letters that make a cell textual; fixed values.
BLANKS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = f"[{BLANKS}]"
TEXT_LETTER = r"[A-Za-z\x{00C0}-\x{024F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often it stands in it; plain nesting copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_sum(value: Column) -> Column:
    """The sum of DOUBLE amounts by their ten decimal places, the same in whatever order the rows come; what is too large for
    that, or no number, is added as DOUBLE."""
    places = value.try_cast("decimal(38,10)")
    return F.coalesce(F.when(F.count(places) == F.count(value), F.try_sum(places)).cast("double"), F.sum(value))


def parse_number(c: Column) -> Column:
    """A printed amount as DOUBLE: parentheses, a trailing minus and CR are negative, the later of two separators is decimal.

    Everything but digits, separators and minus is dropped, so currency signs and codes don't matter (the dot of an
    abbreviation counts as a separator). A lone comma with one or two digits behind it is decimal, other commas part
    thousands. What follows a second decimal point is left out. NULL if no number is there.
    """

    def turned(bare: Column) -> Column:
        has_dot, has_comma = F.contains(bare, F.lit(".")), F.contains(bare, F.lit(","))
        late_comma = has_dot & has_comma & ~F.contains(F.substring_index(bare, ",", -1), F.lit("."))
        lone_comma = ~has_dot & has_comma & bare.rlike(r"^[^,]*,[0-9]{1,2}$")
        # behind a decimal comma that comes last there is no other separator to read, so only the first comma turns
        plain = F.when(late_comma | lone_comma, F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")).otherwise(F.replace(bare, F.lit(","), F.lit("")))
        return F.regexp_extract(plain, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")

    def signed(r: Column) -> Column:
        negative = r["t"].rlike(r"^\(.*\)$|(?i:CR)$") | F.endswith(r["kept"], F.lit("-"))
        return let(let(F.rtrim(r["kept"], F.lit("-")), turned), lambda v: F.when(negative, -v).otherwise(v))

    dense = F.regexp_replace(c, f"[{BLANKS}']", "")
    return let(let(dense, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, "[^0-9.,-]", "").alias("kept"))), signed)


def strict_number(c: Column) -> Column:
    """parse_number, but NULL where the cell carries letters other than a final CR or DR."""
    # most amounts are printed plainly: digits, with commas only where a decimal point follows
    plain = lambda x: x.rlike(r"^[0-9][0-9,]*\.[0-9]+$|^[0-9]+$")
    shape = lambda x: x.rlike(rf"(?i)^{BLANK}*\(?{BLANK}*-?[0-9.,'{BLANKS}]+\)?{BLANK}*(?:CR|DR)?{BLANK}*/?{BLANK}*$")
    # without a digit there is no number
    return let(c, lambda x: F.when(plain(x), F.replace(x, F.lit(","), F.lit("")).try_cast("double")).when(x.rlike("[0-9]") & (~x.rlike(TEXT_LETTER) | shape(x)), parse_number(x)))


def is_textual(c: Column) -> Column:
    """Letters, and not a strict number; false for null."""
    return let(c, lambda x: F.coalesce(x.rlike(TEXT_LETTER) & strict_number(x).isNull(), F.lit(False)))


def loose_number(c: Column) -> Column:
    """parse_number without a " / X" code behind; NULL for what looks like a date."""
    bare = F.regexp_replace(c, r"\s*/\s*[A-Za-z]\s*$", "")
    return let(bare, lambda x: F.when(~x.rlike(r"[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}"), parse_number(x)))


def sign_for_label(label: Column) -> Column:
    """-1 for deductions, accumulated depreciation and allowances or provisions for bad debts, else 1."""
    low = F.lower(label)
    return F.when(low.rlike(r"^less\b|\baccumulated (depreciation|amorti[sz]ation|depletion)\b|\b(allowance|provision) for (bad|doubtful)\b"), -1).otherwise(1)


def tax_book_value(value: Column) -> Column:
    """Tax lines are booked negative: positive amounts turn."""
    return F.when(value > 0, -value).otherwise(value)


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def norm_caption(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""), r"\s+", " "))


def norm_profile(c: Column) -> Column:
    """norm without punctuation at the end."""
    return F.trim(F.regexp_replace(norm(c), r"[\s:：.,;*]+$", ""))


def js_round(c: Column, places: int = 0) -> Column:
    """Rounding with halves toward positive infinity."""
    return F.floor(c * 10**places + 0.5) / 10**places


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def year_before(d: Column) -> Column:
    """First day of the twelve months that end on ``d``; from 29 February, 1 March of the year before."""
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.when(leap, F.make_date(F.year(d) - 1, F.lit(3), F.lit(1))).otherwise(F.date_add(F.add_months(d, -12), 1))


def clean_percent(c: Column) -> Column:
    """A share above 0 and up to 1, with or without a percent sign, or a percentage up to 100, as percent with two places; else NULL."""
    n = F.trim(F.replace(F.trim(c), F.lit("%"), F.lit(""))).try_cast("double")
    p = F.when((n > 0) & (n <= 1), n * 100).otherwise(n)
    return F.when((p >= 0) & (p <= 100), js_round(p, 2))


def mask_tax_id(c: Column) -> Column:
    """Identifiers shaped ddd-dd-dddd keep their last four digits only."""
    return F.regexp_replace(c, r"[0-9]{3}-[0-9]{2}-([0-9]{4})", "***-**-$1")


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)


def similarity(a: Column, b: Column) -> Column:
    """Overlap of two token arrays over the smaller, 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def serial_to_date(n: Column) -> Column:
    """A spreadsheet's day number as a date; null outside 20000 to 80000."""
    return F.when((n > 20000) & (n < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def to_iso_date(text: Column) -> Column:
    """m/d/y with slashes or dashes; day and month change places if the first is above 12; two-digit years are 20xx."""
    pattern = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\s*$"
    a, b, y = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))
    year, month, day = F.when(y < 100, y + 2000).otherwise(y), F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def is_mostly_non_latin(text: Column) -> Column:
    """More than half of the letters are outside the Latin script; false without letters or text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]|[^\p{L}]", ""))
    return F.coalesce(2 * (letters - latin) > letters, F.lit(False))


def column_number(letters: Column) -> Column:
    """A, B, ..., Z, AA, ... as 1, 2, ..., 26, 27, ...; null for anything else."""
    n = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64))
    return F.when(letters.rlike("^[A-Za-z]{1,3}$"), n)


def as_of_label(asked: Column, resolved: Column) -> Column:
    """The date a rate is of, with the requested date if another one was taken."""
    day = F.date_format(resolved, "yyyy-MM-dd")
    return F.when(asked.eqNullSafe(resolved), day).otherwise(F.concat(day, F.lit(" (requested "), F.date_format(asked, "yyyy-MM-dd"), F.lit(")")))
