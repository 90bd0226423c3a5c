"""Column functions over texts, titles, urls and wikitext.

The patterns are written so that Java's and RE2's engines agree on them, which lets SQL express the same steps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no vocabulary comparison counts.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was",
    "were", "will", "with", "this", "these", "those", "or", "but", "if", "then", "than", "about", "into", "over", "under", "such", "their", "there",
    "which", "also", "can", "could", "may", "might", "would", "should", "been", "being", "have", "had", "do", "does", "did", "not", "no", "yes", "we",
    "they", "you", "i", "our", "your", "them", "his", "her", "hers", "him", "she", "who", "whom", "what", "when", "where", "why", "how", "because",
    "during", "after", "before", "between", "within", "without", "per", "via", "up", "down", "out", "all", "any", "some", "most", "more", "less",
    "many", "few", "each", "other", "same", "new", "old", "one", "two", "three",
]
SPACES = r"[ \t\n\f\r]+"
#: Markup and what stays of it, in the order in which it is taken away.
MARKUP = (
    (r"(?s)<!--.*?-->", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"),
    (r"'{2,}", ""),
    (r"<[^<>]*>", ""),
)
REFERENCE = r"(?is)<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>"
HEADING = r"(?m)^=+[ \t]*([^=\n]+?)[ \t]*=+[ \t]*$"
#: Citation templates and their classes.
CITE_CLASSES = {
    "cite journal": "journal", "cite book": "book", "cite news": "news", "cite web": "web", "cite report": "report", "cite press release": "press",
    "cite magazine": "news", "cite conference": "journal", "cite thesis": "journal", "cite encyclopedia": "book", "citation": "generic",
}


def terms(text: Column) -> Column:
    """Lower-case words of three or more letters; a word with a digit or "_" goes whole."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}\z"))


def content_terms(text: Column) -> Column:
    return F.filter(terms(text), lambda w: ~w.isin(STOP_WORDS))


def without_markup(text: Column) -> Column:
    for pattern, stays in MARKUP:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", stays))
    return text


def squeezed(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def sentences(text: Column) -> Column:
    """Parts between a terminal mark and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])" + SPACES, "$1\u0001"), "\u0001")


def claim_id(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(squeezed(text)), 256), 1, 20)


def focal_passage(text: Column, entity: Column, most: int = 6000) -> Column:
    """The sentences that name an entity, whatever the case, in order."""
    hits = F.filter(sentences(text), lambda s: F.contains(F.lower(s), F.lower(entity)))
    return F.substring(F.array_join(hits, " "), 1, most)


def lead_of(wikitext: Column, most: int = 3000) -> Column:
    """What stands before the first heading."""
    return F.substring(F.get(F.split(wikitext, r"(?m)^=="), F.lit(0)), 1, most)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and "www."; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def unarchived(url: Column) -> Column:
    """The page that an archive's address wraps."""
    inner = F.regexp_extract(url, r"(?is)^https?://web\.archive\.org/web/[^/]*/(https?://.+)\z", 1)
    return F.when(inner != "", inner).otherwise(url)


def cited_domains(wikitext: Column) -> Column:
    """Hosts of all external links; bare archive links don't count."""
    urls = F.regexp_extract_all(wikitext, F.lit(r"https?://[^\s<>{}\]|\[]+"), F.lit(0))
    hosts = F.transform(urls, lambda u: host_of(unarchived(u)))
    return F.filter(hosts, lambda h: (h != "") & (h != "web.archive.org"))


def domain_class(domain: Column) -> Column:
    """edu, gov/int, or the top-level domain."""
    last = F.substring_index(domain, ".", -1)
    return F.when(domain.endswith(".edu") | domain.contains(".ac."), "edu").when(domain.rlike(r"\.(gov|mil|int|un\.org)\z"), "gov/int").otherwise(last)


def cite_classes(wikitext: Column) -> Column:
    """The class of each citation template."""
    names = F.regexp_extract_all(wikitext, F.lit(r"(?i)\{\{\s*(cite\s+[a-z][a-z ]*?|citation)\s*(?:\||\}\})"), F.lit(1))
    table = F.create_map(*(F.lit(x) for pair in CITE_CLASSES.items() for x in pair))
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(table, squeezed(F.lower(n))), F.lit("other")))


def slug(title: Column) -> Column:
    """A title as a file name: separators to "_"; a name of dots alone to "_" throughout."""
    flat = F.translate(title, " /\\\x00", "____")
    return F.when(flat.rlike(r"^\.+\z"), F.regexp_replace(flat, r"\.", "_")).otherwise(flat)


def plain_title(title: Column) -> Column:
    return F.trim(F.translate(F.coalesce(title, F.lit("")), "_", " "))


def title_of(value: Column) -> Column:
    """A title, from itself or from an article's address; other addresses stay as they are."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    path = F.regexp_extract(raw, r"^https?://[^/]*wikipedia\.org[^/]*/wiki/([^?#]*)", 1)
    asked = F.regexp_extract(raw, r"^https?://[^/]*wikipedia\.org[^/]*/w/index\.php\?(?:[^#]*&)?title=([^&#]*)", 1)
    found = plain_title(F.try_url_decode(F.when(path != "", F.replace(path, F.lit("+"), F.lit("%2B"))).otherwise(asked)))
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(raw)


def _quoted(title: Column) -> Column:
    """A title as a part of an address: spaces to "_", the rest percent-encoded but for ( ) : / and unreserved marks."""
    found = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for coded, plain in (("%28", "("), ("%29", ")"), ("%3A", ":"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        found = F.replace(found, F.lit(coded), F.lit(plain))
    return found


def page_address(title: Column, lang: str = "en") -> Column:
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), _quoted(title))


def oldid_address(title: Column, rev_id: Column, lang: str = "en") -> Column:
    """Where a revision of a page is shown."""
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/w/index.php?title="), _quoted(title), F.lit("&oldid="), rev_id.cast("string"))


def contrast_ratio(first: Column, second: Column) -> Column:
    """Contrast of two colours, each a struct l (percent), c, h (degrees) in OKLCH, after rasterising to 8 bits."""
    one, two = luminance(first), luminance(second)
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


#: From OKLab to cube roots of cone responses, and from these to linear red, green and blue.
TO_CONES = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def luminance(colour: Column) -> Column:
    light, a, b = colour["l"] / 100.0, colour["c"] * F.cos(F.radians(colour["h"])), colour["c"] * F.sin(F.radians(colour["h"]))
    cones = [F.pow(light + x * a + y * b, F.lit(3.0)) for x, y in TO_CONES]

    def channel(row: tuple) -> Column:
        linear = F.least(F.greatest(sum((w * c for w, c in zip(row, cones, strict=True)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        shown = F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(linear, F.lit(1 / 2.4)) - 0.055)
        byte = F.round(F.least(F.greatest(shown, F.lit(0.0)), F.lit(1.0)) * 255) / 255.0
        return F.when(byte <= 0.03928, byte / 12.92).otherwise(F.pow((byte + 0.055) / 1.055, F.lit(2.4)))

    return sum((w * channel(row) for w, row in zip((0.2126, 0.7152, 0.0722), TO_RGB, strict=True)), F.lit(0.0))
