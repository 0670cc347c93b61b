"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English function words; the list is a parameter of every operator that drops them.
STOP_WORDS = ("a an and are as at be been but by can do does for from had has have he her his how i if in into is it its may more most no not of on or our she should "
              "so such than that the their them then there these they this those to was we were what when which who will with would you your").split()

# The edges of a word of ASCII letters, digits and underscores, whatever an engine takes for a word.
BEFORE, AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def whole(*forms: str) -> str:
    """A pattern for any of these forms as whole words."""
    return BEFORE + "(?:" + "|".join(forms) + ")" + AFTER


def for_sql(pattern: str) -> str:
    """The same pattern for engines without look-around, where a word's edge is of ASCII."""
    return pattern.replace(BEFORE, r"\b").replace(AFTER, r"\b").replace("'", "''")


#: Parameters of the amounts left out of indexed text: units, how often, and periods.
UNITS = ("mg", "milligram(?:me)?s?", "mcg", "µg", "microgram(?:me)?s?", "ml", "iu")
OFTEN = ("once", "twice", "thrice", "[0-9]+ times")
PERIODS = {"hour": "hourly", "day": "daily", "week": "weekly"}


def amounts(units=UNITS, often=OFTEN, periods=PERIODS) -> str:
    """A pattern for a number with a unit, for how often in a period, and for a unit in a period."""
    unit, times, period, adverb = ("(?:" + "|".join(x) + ")" for x in (units, often, periods, periods.values()))
    return "(?i)" + whole(rf"[0-9]+(?:[.,][0-9]+)?\s*{unit}", rf"{times}\s+(?:{adverb}|(?:a|each|per)\s+{period})", rf"{unit}\s*(?:/|per)\s*{period}")


DOSE = amounts()
WITHHELD = "[Left out: this passage states an amount.]"

TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stop=STOP_WORDS) -> Column:
    """Lower-case words with inner hyphens, without stop words; duplicates are kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case letters and digits only, as an array: what phrases are matched on."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_pairs(terms: Column) -> Column:
    """Adjacent pairs of an array, joined by a space; the array is read a fixed number of times, not once per pair."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(F.slice(terms, 1, n), F.slice(terms, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def uni_and_bigrams(text: Column, stop=STOP_WORDS) -> Column:
    """Terms of at least two word characters and their adjacent pairs, after stop words are dropped."""
    return with_pairs(gram_words(text, stop))


def gram_words(text: Column, stop=STOP_WORDS) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop))


def with_pairs(terms: Column) -> Column:
    return F.concat(terms, word_pairs(terms))


def counted(terms: Column | str) -> Column:
    """ARRAY<STRUCT<term, tf>> of an array's distinct terms: lengths of the runs of the sorted array, so they are counted in their row.

    Arrays are bound once by a transform over a single element, so they are not made again for each term."""
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))

    def runs(a):
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return once(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(a))), lambda b, e: F.struct(F.get(a, b).alias("term"), (e - b).cast("bigint").alias("tf"))))

    return once(F.sort_array(terms), lambda a: F.when(F.size(a) > 0, runs(a)))


def sentences(text: Column, ends: str = ".!?") -> Column:
    """Split after an end character when white space follows."""
    return F.filter(F.split(F.regexp_replace(text, rf"([{ends}])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def dose_free(text: Column, pattern: str = DOSE) -> Column:
    return F.regexp_replace(text, pattern, " ")
