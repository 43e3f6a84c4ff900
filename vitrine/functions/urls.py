"""URL functions as column expressions; a null URL gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only size an image.
SIZE_KEYS = ["width", "height", "w", "h", "size", "sw", "sh", "resize", "crop", "fit", "quality", "q", "format", "auto"]
#: Patterns of a product id in a URL, in order of preference.
PRODUCT_ID_PATTERNS = [r"/products?/([A-Za-z0-9_-]+)", r"/p/([A-Za-z0-9_-]+)", r"/item/([A-Za-z0-9_-]+)", r"/([A-Z0-9]{5,})-", r"[?&]id=([A-Za-z0-9_-]+)", r"[?&]productId=([A-Za-z0-9_-]+)"]
#: Brands known by the first label of their host.
BRANDS_BY_HOST = {
    "alexandermcqueen": "Alexander McQueen", "balenciaga": "Balenciaga", "acnestudios": "Acne Studios", "eckhauslatta": "Eckhaus Latta", "entirestudios": "Entire Studios", "khaite": "Khaite",
    "stussy": "Stussy", "uniqlo": "Uniqlo", "cos": "COS", "aritzia": "Aritzia", "kuurth": "Kuurth", "jukuhara": "Jukuhara",
}


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def scheme(url: Column) -> Column:
    return extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://")


def host(url: Column) -> Column:
    return F.coalesce(extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"), F.when(url.isNotNull(), F.lit("")))


def path(url: Column) -> Column:
    return F.when(url.isNotNull(), F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))


def query(url: Column) -> Column:
    return F.when(url.isNotNull(), F.regexp_extract(url, r"\?([^#]*)", 1))


def canonical(url: Column) -> Column:
    """The key of a product page: no query, no trailing slash, no collection before /products/. A fragment stays."""
    bare = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")
    return F.regexp_replace(bare, "/collections/[^/]+/products/", "/products/")


def normalized(url: Column) -> Column:
    """https, the host without "www." and at least "/" as path; query and fragment stay."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    rest = F.regexp_extract(full, r"^https?://[^/?#]*(.*)$", 1)
    return F.concat(F.lit("https://"), domain(full), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def domain(url: Column) -> Column:
    """The host without any "www."."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def domain_without_prefix(url: Column) -> Column:
    """The host without a leading "www."."""
    return F.regexp_replace(host(url), r"^www\.", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)


def product_slug(url: Column) -> Column:
    """What follows the last /products/ (or /product/, /p/), without query; else the last segment of the path."""
    return F.coalesce(extract(path(url), r".*/(?:products?|p)/([^/]+)"), last_segment(url))


def product_id(url: Column) -> Column:
    return F.coalesce(*[extract(url, p) for p in PRODUCT_ID_PATTERNS])


def title_words(text: Column) -> Column:
    """Words split at - and _, each with a capital and the rest small."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(text, "[-_]+", " "), r"\s+", " ")))


def category_name(url: Column) -> Column:
    """From a `tag:` in the query or the last segment of the path; without either, the main collection."""
    tag = extract(query(url), r"(?:^|[&=])(?:tag[:=])([^&]+)")
    return title_words(F.coalesce(tag, F.nullif(F.regexp_replace(last_segment(url), r"\.[a-z]+$", ""), F.lit("")), F.lit("Main Collection")))


def page_urls(url: Column, last: Column) -> Column:
    """URLs of the pages 2 to last of a listing; empty if there is one page."""
    stem = F.regexp_replace(F.regexp_replace(url, r"([?&])page=\d+&?", "$1"), "[?&]$", "")
    join = F.when(F.contains(stem, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda n: F.concat(stem, join, F.lit("page="), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def page_number(url: Column) -> Column:
    """The page that a listing's URL names, else 1."""
    return F.coalesce(F.coalesce(extract(url, r"[?&](?:page|p|pg)=(\d+)"), extract(url, r"/page/(\d+)")).cast("int"), F.lit(1))


def image_identity(url: Column) -> Column:
    """One key for all sizes of an image: an asset id or a hash in the path, else host, path and name without size marks, and other parameters."""
    low = F.lower(path(url))
    name = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]*$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[-_]?\d+x\d+", ""), r"[-_](small|medium|large|thumb|thumbnail|xl|xs|sm|md|lg)$", "")
    place = F.regexp_replace(low, r"/(small|medium|large|thumb|thumbnail|small_thumbnail|large_thumbnail|\d+x\d*)(?=/|$)", "")
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin("width", "height", "w", "h", "size", "sw", "sh", "resize", "v"))
    asset, hashed = extract(low, "/asset/([a-f0-9-]{36})/"), extract(low, "/m/([a-f0-9]{16,})/")
    server = F.lower(host(url))
    whole = F.concat_ws("|", server, place, name, F.nullif(F.array_join(F.array_sort(kept), "&"), F.lit("")))
    return F.when(asset.isNotNull(), F.concat_ws("|", server, F.lit("asset"), asset)).when(hashed.isNotNull(), F.concat_ws("|", server, F.lit("hash"), hashed)).otherwise(whole)


def without_size(url: Column) -> Column:
    """The image in full: no parameters that size it and no size in the file name; a {width} placeholder becomes 1024."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(SIZE_KEYS)), "&")
    bare = F.split_part(url, F.lit("?"), F.lit(1))
    full = F.concat(bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.regexp_replace(F.regexp_replace(full, r"_\d{1,4}x\d{0,4}(?:_crop_center)?(?=\.\w{3,4})", ""), r"\{width\}", "1024")


def best_of_srcset(srcset: Column) -> Column:
    """The widest image of a srcset; of equals the first; the first plain http URL if none has a width."""
    parts = F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+"))
    wide = F.transform(F.filter(parts, lambda p: F.coalesce(F.get(p, F.lit(1)).rlike(r"^\d+w$"), F.lit(False))), lambda p: F.struct(F.rtrim(F.get(p, F.lit(1)), F.lit("w")).cast("int").alias("w"), F.get(p, F.lit(0)).alias("url")))
    best = F.aggregate(wide, F.struct(F.lit(0).alias("w"), F.lit(None).cast("string").alias("url")), lambda a, x: F.when(x["w"] > a["w"], x).otherwise(a), lambda a: a["url"])
    return F.coalesce(best, F.get(F.filter(F.transform(parts, lambda p: F.get(p, F.lit(0))), lambda u: u.startswith("http")), F.lit(0)))


def absolute(link: Column, base: Column) -> Column:
    """A link as a full URL: //host, /path, other relative forms against the base's folder; &amp; decoded."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(link, r"^\./", "")))
    )


def product_name(url: Column) -> Column:
    """A name from the last segment: no extension, no ids; null if it is hexadecimal only or shorter than three letters."""
    stem = F.regexp_replace(F.regexp_replace(last_segment(url), r"\.[a-zA-Z0-9]+$", ""), r"[-_]?\d{4,}$", "")
    return F.when((F.length(stem) >= 3) & ~stem.rlike("^[0-9a-fA-F-]+$"), title_words(stem))


def video_id(url: Column) -> Column:
    """The 11-character id of a watch, short or embed URL."""
    return extract(url, r"(?:[?&]v=|youtu\.be/|/embed/)([A-Za-z0-9_-]{11})")


#: Parts of a URL that speak of an API.
API_PATTERNS = ["/api/", "/graphql", "/v[0-9]+/", r"\.json", "/rest/", "/ajax/", "/products?/", "/catalog/", "/commerce/"]


def looks_like_api(url: Column) -> Column:
    return F.lower(url).rlike("|".join(API_PATTERNS))


def favicons(page: Column, icons: Column) -> Column:
    """Candidate icons of a site: those linked, then the usual places; each once, in order."""
    root = F.concat(scheme(page), F.lit("://"), host(page))
    usual = F.array(*[F.concat(root, F.lit(p)) for p in ("/favicon.ico", "/favicon.png", "/apple-touch-icon.png", "/apple-touch-icon-precomposed.png")])
    return F.array_distinct(F.concat(F.coalesce(icons, F.array().cast("array<string>")), usual))


def brand_of_host(url: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BRANDS_BY_HOST.items() for x in pair])
    return F.try_element_at(known, F.split_part(F.lower(domain(url)), F.lit("."), F.lit(1)))
