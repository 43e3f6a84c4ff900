"""Functions of names, prices, file names, dates and text as column expressions; null gives null unless said otherwise."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.urls import extract

#: Sizes known by name.
SIZES = ["XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL", "OS", "ONE SIZE", "FREE", "UNIQUE"]
#: Seasons by the words that name them, in the order in which they are tried.
SEASONS = {"spring-summer": "spring|summer|ss", "fall-winter": "fall|autumn|winter|fw|aw", "resort": "resort|cruise", "pre-fall": "pre-fall|prefall"}
COLLECTION_TYPES = {"ready-to-wear": "ready.to.wear|rtw", "menswear": "menswear|mens", "couture": "couture"}
#: Extensions by content type, in the order in which they are tried.
EXTENSIONS = {"png": ".png", "jpeg": ".jpg", "jpg": ".jpg", "gif": ".gif", "svg": ".svg", "webp": ".webp", "icon": ".ico"}
#: US dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 3.0, 15.0


def first_match(text: Column, classes: dict[str, str]) -> Column:
    """The first class whose pattern is found, null if none is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(classes.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def clean_description(text: Column) -> Column:
    """Escapes and character references decoded (twice, as sources nest them), tags and invisible characters out, white space collapsed."""

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        for _ in range(2):
            t = html.unescape(re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t).replace("\\n", "\n").replace("\\/", "/").replace('\\"', '"'))
        t = re.sub("[​-‍﻿]", "", re.sub("<[^>]+>", " ", t))
        return re.sub(r"meta charset=\S*|\$\$", "", re.sub(r"\s+", " ", t)).strip()

    def series(t: pd.Series) -> pd.Series:
        return t.map(clean)

    return F.pandas_udf(series, "string")(text)


def price(text: Column) -> Column:
    """Digits and dots as a number; null if they aren't one."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def availability(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("instock")), F.lit(True)).when(F.contains(low, F.lit("outofstock")), F.lit(False))


def slug(text: Column, joiner: str = "-", longest: int = 50) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", joiner)
    return F.left(F.trim(words, F.lit(joiner)), F.lit(longest))


def padded_number(n: Column, width: int = 3) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def undoubled(name: Column) -> Column:
    """A name whose second half of words repeats the first, once."""
    words = F.split(F.trim(name), r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    twice = (F.size(words) % 2 == 0) & (half > 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
    return F.when(twice, F.array_join(F.slice(words, F.lit(1), half), " ")).otherwise(name)


def season(text: Column) -> Column:
    return first_match(F.lower(text), SEASONS)


def collection_type(text: Column) -> Column:
    return first_match(F.lower(text), COLLECTION_TYPES)


def year(text: Column) -> Column:
    return extract(text, "(20[0-9]{2})").cast("int")


def designer(filename: Column) -> Column:
    """The first two words of a file name that aren't a season, a year or a number."""
    words = F.split(F.regexp_replace(F.lower(filename), r"\.[a-z0-9]+$", ""), "[-_ ]+")
    plain = F.filter(words, lambda w: ~w.rlike(f"^({'|'.join(SEASONS.values())}|[0-9]+|ready|to|wear|{'|'.join(COLLECTION_TYPES.values())})$") & (w != ""))
    return F.nullif(F.array_join(F.slice(plain, 1, 2), " "), F.lit(""))


def look_number(filename: Column) -> Column:
    return F.coalesce(extract(filename, r"-(\d+)\.").try_cast("int"), F.lit(0))


def unescaped(text: Column) -> Column:
    """The usual escapes of embedded JSON, undone."""
    for a, b in (("\\n", "\n"), ("\\r", ""), ("\\t", " "), ('\\"', '"'), ("\\'", "'"), ("\\/", "/")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def between(text: Column, start: str, end: str, longest: int = 5000) -> Column:
    """What lies between two markers; null without both or beyond `longest` characters."""
    at = F.locate(start, text)
    rest = F.substr(text, at + len(start))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 0) & (stop - 1 <= longest), F.left(rest, stop - 1))


def fuzzy_slug_pattern(slug: str) -> str:
    """A pattern that finds a slug whatever parts its words."""
    return r"[-_\s]?".join(re.escape(w) for w in re.split(r"[-_\s]+", slug) if w)


_TEMPLATE_PARTS = r"(\{\{SLUG\}\}|\{\w+\}|\s+)"


def placeholders(template: str, fields: dict[str, str]) -> list[str]:
    """The fields that a template names, in order; as often as it does."""
    return [p[1:-1] for p in re.split(_TEMPLATE_PARTS, template) if re.fullmatch(r"\{\w+\}", p) and p[1:-1] in fields]


def compiled_pattern(template: str, fields: dict[str, str], slug: str | None = None) -> str:
    """A template as a pattern: {field} is a group of the field's own pattern, {{SLUG}} the slug whatever parts its words, blanks are any
    number of blanks, and all else, other names in braces too, is literal."""
    out = []
    for part in re.split(_TEMPLATE_PARTS, template):
        if part == "{{SLUG}}":
            out.append(fuzzy_slug_pattern(slug or ""))
        elif re.fullmatch(r"\{\w+\}", part) and part[1:-1] in fields:
            out.append(f"({fields[part[1:-1]]})")
        else:
            out.append(r"\s*" if part.isspace() else re.escape(part))
    return "".join(out)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def duration(seconds: Column) -> Column:
    """45s, 3m 05s, 2h 07m."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")))


def password_hash(text: Column) -> Column:
    """An unsalted digest, for reading old rows only; not for new credentials."""
    return F.sha2(text, 256)


def url_tag(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(8))


def css_escaped(name: Column) -> Column:
    return F.replace(name, F.lit(":"), F.lit("\\:"))


#: Parts of class names of galleries, and classes that say nothing.
GALLERY_CLASSES = ["swiper", "carousel", "gallery", "slider", "splide", "product-media", "product-image", "media-list", "lightbox"]
UTILITY_CLASSES = ["div", "span", "relative", "flex", "hidden", "w-full", "h-full", "block", "inline", "absolute", "overflow"]


def container_signature(path: Column) -> Column:
    """The four nearest containers of an image, from an array of (tag, cls, id), nearest first: each by its classes, else its id, else its tag."""
    named = lambda c: F.when(c["cls"] != "", c["cls"]).when(c["id"] != "", F.concat(F.lit("#"), c["id"])).otherwise(c["tag"])
    return F.array_join(F.transform(F.slice(path, 1, 4), named), " > ")


def image_selector(path: Column) -> Column:
    """A selector for the images of a container: an id among the four nearest, else a class of a gallery among them, else up to two classes of
    the nearest of three that has any, those that say something first. Null where there is neither id nor class."""
    near, first = F.slice(path, 1, 4), lambda found: F.get(found, 0)
    by_id = F.concat(F.lit("#"), first(F.filter(near, lambda c: c["id"] != ""))["id"])
    of_gallery = first(F.filter(near, lambda c: F.lower(c["cls"]).rlike("|".join(GALLERY_CLASSES))))["cls"]
    classes = F.split(first(F.filter(F.slice(path, 1, 3), lambda c: c["cls"] != ""))["cls"], r"\.")
    telling = F.filter(classes, lambda x: (x != "") & ~x.isin(*UTILITY_CLASSES))
    own = F.array_join(F.slice(F.when(F.size(telling) > 0, telling).otherwise(classes), 1, 2), ".")
    return F.concat(F.coalesce(by_id, F.concat(F.lit("."), F.split_part(of_gallery, F.lit("."), F.lit(1))), F.concat(F.lit("."), own)), F.lit(" img"))


def path_signature(path: Column) -> Column:
    """The first part of an element path that has a class or an id."""
    return F.get(F.filter(F.split(path, " > "), lambda p: p.rlike("[.#]")), F.lit(0))


def extension_of(content_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), first_match(F.lower(content_type), {k: k for k in EXTENSIONS})), F.lit(".ico"))


def run_id(ts: Column) -> Column:
    return F.concat(F.lit("run_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def json_object(reply: Column) -> Column:
    """The JSON of a model's recorded reply, fenced or bare; null if none parses."""
    fenced = extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
    return F.try_parse_json(F.coalesce(fenced, extract(reply, r"(?s)(\{.*\})")))


def valid_size(text: Column) -> Column:
    size = F.upper(F.trim(text))
    return size.isin(SIZES) | size.rlike(r"^[0-9]{1,2}(\.[05])?$") | size.rlike("^[XSML]{1,4}$") | size.rlike("^[A-Z0-9]{1,4}[-/][A-Z0-9]{1,4}$") | (F.length(size) <= 5)


def fuzzy_score(query: Column, *fields: Column) -> Column:
    """The best likeness, 0 to 1, of a query to the fields: 1 where one contains it, else by edit distance."""
    q = F.lower(query)

    def one(f: Column) -> Column:
        f = F.lower(F.coalesce(f, F.lit("")))
        return F.when(F.contains(f, q), F.lit(1.0)).otherwise(1 - F.levenshtein(q, f) / F.greatest(F.length(q), F.length(f), F.lit(1)))

    return F.greatest(*[one(f) for f in fields]) if len(fields) > 1 else one(fields[0])
