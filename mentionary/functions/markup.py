"""Wiki markup and HTML anchors as column expressions; balanced templates by a vectorised function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import link_target, lower, normalize_form, text, topic_title

#: [[Namespace:Target#anchor|shown text]]
LINK = r"\[\[(?:([A-Za-z ]+):)?([^\]\[|#]+)(?:#([^\]\[|]*))?(?:\|([^\]\[]*))?\]\]"
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
REDIRECT = r"(?i)^\s*#REDIRECT\s*:?\s*\[\["
HEADING = r"(?m)^=+[^=\n].*=+\s*$"


def groups(c: Column | str, pattern: str, count: int) -> Column:
    """One struct (g1, g2, ...) for each match."""
    found = [F.regexp_extract_all(text(c), F.lit(pattern), F.lit(g)) for g in range(1, count + 1)]
    return F.arrays_zip(*[f.alias(f"g{g}") for g, f in enumerate(found, 1)])


def html_anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, href, shown): every anchor of every page."""
    found = pages.select(F.col(id_col).alias("page"), F.posexplode(groups(html_col, ANCHOR, 2)).alias("pos", "a"))
    return found.select("page", "pos", F.col("a.0").alias("href"), F.col("a.1").alias("shown")) if "0" in found.schema["a"].dataType.names else found.select("page", "pos", F.col("a.g1").alias("href"), F.col("a.g2").alias("shown"))


def wiki_links(pages: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(title, pos, namespace, target, anchor, shown, in_first_section) of every internal link.

    A link without a namespace is in Main; shown text defaults to the target.
    """
    head = F.substring(text(text_col), F.lit(1), F.when(text(text_col).rlike(HEADING), F.length(F.regexp_extract(text(text_col), r"(?s)^(.*?)(?=^=+[^=\n]+=+\s*$)".replace("(?s)", "(?sm)"), 1))).otherwise(F.length(text(text_col))))
    in_head = F.size(F.regexp_extract_all(head, F.lit(LINK), F.lit(0)))
    rows = pages.select(F.col(title_col).alias("title"), in_head.alias("n_head"), F.posexplode(groups(text_col, LINK, 4)).alias("pos", "l"))
    g = [F.col("l")[n] for n in rows.schema["l"].dataType.names]
    return rows.select("title", "pos", F.when(g[0] == "", "Main").otherwise(g[0]).alias("namespace"), F.trim(g[1]).alias("target"), g[2].alias("anchor"), F.when(g[3] == "", g[1]).otherwise(g[3]).alias("shown"), (F.col("pos") < F.col("n_head")).alias("in_first_section"))


def surface_forms(pages: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(title, form, topic) without repeats in a page: shown texts of Main links with their targets, and the page's own title."""
    links = wiki_links(pages, title_col, text_col).where("namespace = 'Main'").select("title", normalize_form("shown").alias("form"), link_target("namespace", "target").alias("topic"))
    own = pages.select(F.col(title_col).alias("title"), normalize_form(title_col).alias("form"), topic_title(title_col).alias("topic"))
    return links.unionByName(own).where("form <> ''").distinct()


def contexts(pages: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(topic, context): Category links anywhere, Main links of the first section."""
    links = wiki_links(pages, title_col, text_col).where("namespace = 'Category' or namespace = 'Main' and in_first_section")
    return links.select(topic_title("title").alias("topic"), link_target("namespace", "target").alias("context")).distinct()


def redirects(pages: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(topic, target) for every link of a redirect page."""
    links = wiki_links(pages.where(F.col(text_col).rlike(REDIRECT)), title_col, text_col)
    return links.select(topic_title("title").alias("topic"), link_target("namespace", "target").alias("target"))


def redirect_reason(c: Column | str) -> Column:
    """The template that gives a redirect's reason, or an empty string."""
    return F.regexp_extract(text(c), r"(?is)^\s*#REDIRECT\s*:?\s*\[\[[^\]]*\]\]\s*\{\{([^}|]*)", 1)


def plain_text(c: Column | str) -> Column:
    """Text without comments, templates, tags, external links, entities, tables' marks and link brackets, in document order."""
    t = F.regexp_replace(text(c), r"(?s)<!--.*?-->", " ")
    for _ in range(3):  # templates inside templates
        t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", " ")
    for pattern, to in ((r"(?is)<(script|style|ref|math|nowiki)[^>]*>.*?</\1>", " "), (r"<[^>]*>", " "), (r"\[\[(?:[A-Za-z ]+:)[^\]]*\]\]", " "), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"\[https?://\S+\s?([^\]]*)\]", "$1"), (r"https?://\S+", " "), (r"&[#A-Za-z0-9]+;", " "), (r"'{2,}|={2,}|[{}|]+", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def html_text(c: Column | str) -> Column:
    """Visible text of HTML: without scripts, styles, comments, tags and entities. The patterns mean the same in RE2."""
    t = text(c)
    for pattern in (r"(?s)<script[^>]*>.*?</script>", r"(?s)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>", r"&[#A-Za-z0-9]+;", r"[ \t\r\n]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def good_page(title: Column | str, body: Column | str, templates: tuple[str, ...] = ("disambig", "hndis", "geodis", "surname", "given name"), prefixes: tuple[str, ...] = ("List of", "Table of", "File:", "Template:", "Wikipedia:", "Portal:", "MediaWiki:")) -> Column:
    """No page that a template or a title's beginning marks as a list, name or maintenance page."""
    marked = text(body).rlike(r"(?i)\{\{\s*(?:" + "|".join(map(re.escape, templates)) + r")\b")
    started = text(title).startswith(prefixes[0])
    for p in prefixes[1:]:
        started = started | text(title).startswith(p)
    return ~(marked | started)


def split_templates(s: str | None) -> tuple[str | None, list[str] | None]:
    """Text without its outermost balanced {{templates}}, and these; an unclosed one stays text."""
    if s is None:
        return None, None
    out, found, depth, start, last = [], [], 0, 0, 0
    for m in re.finditer(r"\{\{|\}\}", s):
        if m[0] == "{{":
            if not depth:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(s[last:start])
                found.append(s[start : m.end()])
                last = m.end()
    return "".join([*out, s[last:]]), found


def balanced_templates(c: Column | str) -> Column:
    """struct(text, templates array) by ``split_templates`` on Arrow batches: nesting isn't regular."""

    @F.pandas_udf("text string, templates array<string>")
    def parts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_templates(x) for x in s], columns=["text", "templates"])

    return parts(text(c))


def word_list(c: Column | str, longest: int = 8192) -> Column:
    """Lower-cased words cut at blanks; words over ``longest`` bytes are left out."""
    return F.filter(F.split(lower(c), r"\s+"), lambda w: (w != "") & (F.octet_length(w) <= longest))
