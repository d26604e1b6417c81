"""Scalar functions of text and numbers, all as expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPLIT = r"[^\p{L}\p{N}]+"

STOP_WORDS = tuple(
    """i you he she it we they me him her us them my your his its our their mine yours hers ours theirs myself yourself
    himself herself itself ourselves yourselves themselves who whom which what this these those that
    is was were be been being am are have had has having do did does doing will would could should can cannot
    in on at by to of off for from with into onto over under above below between through during before after until
    against about up down out and or but nor if because while as than so then once again further also
    a an the all any both each few more most other some such no not only own same too very just
    here there when where why how now""".split()
)
#: Context names that say nothing about a topic: maintenance and very general pages.
UNHELPFUL_CONTEXTS = (
    "Category:Living people", "Category:Disambiguation pages", "Category:Articles lacking sources", "Category:All stub articles", "Category:Year of birth missing",
    "Category:Unprintworthy redirects", "Category:Orphaned articles", "Main:International Standard Book Number", "Main:United States", "Main:United Kingdom", "Main:English language",
)


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c: Column | str) -> Column:
    """Lower case, one character for each: the dotted capital I becomes an i alone."""
    return F.lower(F.replace(text(c), F.lit("İ"), F.lit("i")))


def normalize(c: Column | str) -> Column:
    """Lower case; apostrophes go, slashes and hyphens become spaces."""
    return F.translate(lower(c), "/-'", "  ")


def tokens(c: Column | str) -> Column:
    """Words of the normalised text; c++ and .net are kept as words."""
    named = F.replace(F.replace(normalize(c), F.lit("c++"), F.lit("cplusplus")), F.lit(".net"), F.lit("dotnet"))
    return F.filter(F.split(named, WORD_SPLIT), lambda w: w != "")


def words(c: Column | str) -> Column:
    """Words of the lower-cased text, without the rewrites of ``tokens``."""
    return F.filter(F.split(lower(c), WORD_SPLIT), lambda w: w != "")


def normalize_form(c: Column | str) -> Column:
    """A surface form: its tokens joined by spaces."""
    return F.array_join(tokens(c), " ")


def ascii_folded(c: Column | str) -> Column:
    """Accents off the Latin letters of Western Europe."""
    return F.translate(text(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def ascii_only(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"[^\x00-\x7F]", "")


def topic_title(c: Column | str) -> Column:
    """The title, in the main namespace unless it names another."""
    return F.when(text(c).contains(":"), text(c)).otherwise(F.concat(F.lit("Main:"), text(c)))


def link_target(namespace: Column | str, title: Column | str) -> Column:
    """Namespace and title up to an anchor."""
    return F.concat(text(namespace), F.lit(":"), F.substring_index(text(title), "#", 1))


def is_non_word_char(c: Column | str) -> Column:
    return text(c).isin(*" ,;.:!?")


def allowed_phrase(form: Column | str) -> Column:
    """Some word of the space-joined form isn't all digits."""
    return ~F.forall(F.split(text(form), " "), lambda w: w.rlike("^[0-9]+$"))


def allowed_topic(name: Column | str) -> Column:
    """No list, table, category, postcode area, or work of fiction or music."""
    n = text(name)
    works = n.contains("(novel)") | n.contains("(song)") | n.contains("(band)") | n.contains("TV series") | n.contains("(album)")
    return ~(n.startswith("Main:List of") | n.startswith("Main:Table of") | n.startswith("Category:") | n.endswith("postcode area") | works)


def allowed_context(name: Column | str, unhelpful: tuple[str, ...] = UNHELPFUL_CONTEXTS) -> Column:
    """Not on the list, without a year, and not about redirects."""
    n = text(name)
    return ~(n.isin(*unhelpful) | n.rlike("[0-9]{4}") | n.contains("redirect"))


def admissible_word(word: Column | str, count: Column | str, more_than: int = 4, bytes_below: int = 20) -> Column:
    """In more than ``more_than`` documents and shorter than ``bytes_below`` bytes."""
    return (text(count) > more_than) & (F.octet_length(text(word)) < bytes_below)


def category_weight(name: Column | str, weight: Column | str) -> Column:
    """The square root of a category's weight; other weights as they are."""
    return F.when(text(name).startswith("Category:"), F.sqrt(text(weight))).otherwise(text(weight))


def is_stop_word(c: Column | str) -> Column:
    return text(c).isin(*STOP_WORDS)


def page_url(name: Column | str) -> Column:
    return F.concat(F.lit("http://en.wikipedia.org/wiki/"), F.regexp_replace(text(name), "^Main:", ""))


def font_weight(w: Column | str) -> Column:
    """ln of ten thousand times the weight, not below 0."""
    return F.greatest(F.log(text(w) * 10000.0), F.lit(0.0))


def font_size(w: Column | str) -> Column:
    """18 and the weight's ln, not below 4."""
    return F.greatest(F.lit(4.0), F.lit(18.0) + F.log(text(w)))


def percent(c: Column | str) -> Column:
    return F.format_string("%.0f%%", text(c) * 100.0)


def great_circle_miles(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Distance on the sphere, 60 * 1.1515 miles a degree; the cosine is kept within [-1, 1]."""
    a, b = F.radians(text(lat1)), F.radians(text(lat2))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(text(lon1) - text(lon2)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * 60 * 1.1515


def parse_location(c: Column | str) -> Column:
    """A struct (lat, lon) from "(lat,lon)"; null where it can't be read."""
    parts = F.split(F.translate(text(c), "() ", ""), ",")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))


def squared_distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    dx, dy = text(x1) - text(x2), text(y1) - text(y2)
    return dx * dx + dy * dy


def distance_weight(distance: Column | str, sigma: float = 6.0) -> Column:
    """A normal density's falling-off with the distance between mentions (off by default in linking)."""
    return F.exp(-(text(distance) * text(distance)) / (2 * sigma * sigma))


def spans_overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Inclusive intervals that share a position."""
    return (start1 <= end2) & (start2 <= end1)


def compatible(site1: Column, alternative1: Column, form1: Column, site2: Column, alternative2: Column, form2: Column) -> Column:
    """May be linked: of different sites, or of one alternative but different forms."""
    return (site1 != site2) | ((alternative1 == alternative2) & (form1 != form2))
