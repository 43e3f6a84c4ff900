"""Predicates on pages, images, links and products as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.urls import extract, host, path, query

#: Marks of challenge pages, and how long such a page is at most.
CHALLENGE_MARKS = ["aws-waf", "awswaf", "challenge.js", "captcha", "cf-browser-verification", "challenge-platform", "challenge-form", "just a moment", "checking your browser", "attention required", "cf-challenge", "verify you are human", "bot detection"]
SHORT_PAGE = 5000
#: Names that an error page gives a product, and statuses of failed loads.
GARBAGE_NAMES = ["access denied", "too many requests", "page not found", "404", "error", "not found", "forbidden", "blocked", "please try again", "just a moment", "attention required", "checking your browser", "service unavailable", "temporarily unavailable"]
FAILED_STATUSES = [403, 404, 410, 429, 500, 502, 503]
#: Hosts and paths of images that show no product.
IMAGE_HOSTS = ["cookielaw", "onetrust", "riskified", "analytics", "google", "facebook", "doubleclick", "criteo", "pixel", "tracking", "beacon", "clarity.ms", "akstat.io", "akamai", "cloudflare", "reddit.com", "adnxs.com", "adsrvr.org", "media6degrees", "klaviyo", "connect.facebook", "match.adsrvr"]
IMAGE_PATHS = ["/icon", "/logo", "/favicon", "/sprite", "-logo.", "_logo.", "/brand/", "/brands-logo", "/footer/", "/header/", "/nav/", "/menu/", "payment", "cc-", "-brands.svg", "/badge", "/trust", "/secure", "/payment-icon", "/shipping-", "/guarantee", "placeholder", "clear.svg", "arrow", "/button/", "/chip/", "_chip.", "rp.gif", "/bounce", "/track/", "/recommend", "/similar", "/also-like", "/related", "/recently-viewed", "/upsell", "/cross-sell", "/you-may-like", "/complete-the-look", "/social/", "facebook-icon", "instagram-icon", "twitter-icon", "tiktok-icon"]
SAVED_IMAGE_PATHS = ["/favicon", "/icon", "/logo", "/sprite", "/footer/", "/header/", "/nav/", "/badge", "/payment", "/trust", "/v.gif", "/pixel", "/track"]
#: Paths of API responses that hold no product, and the least length of one that may.
USELESS_RESPONSES = ["/session", "/customer/", "tracking", "analytics", "pixel", "cookie", "judryks"]
LEAST_RESPONSE = 100
#: Names of buttons and links that lead to no product.
UTILITY_NAMES = ["back", "close", "search", "login", "cart", "menu", "subscribe", "play", "pause", "mute", "chat", "support", "cookie", "settings", "help", "navigation", "account", "wishlist", "shipping", "returns", "contact", "privacy", "terms"]

#: Parts of a URL, and of a host, that are a tracker's: of responses in full, and of endpoints.
RESPONSE_TRACKERS = ["google", "facebook", "analytics", "tracking", "pixel", "doubleclick", "criteo", "klaviyo", "attentive", "onetrust", "cookielaw", "abtasty", "gorgias", "preproduct"]
ENDPOINT_TRACKERS = ["google", "facebook", "analytics", "tracking", "pixel", "doubleclick", "adsrvr", "criteo", "pinterest", "snap", "tiktok", "reddit", "taboola", "outbrain", "cookielaw", "onetrust", "cdn.", "static.", "assets."]
#: Words of an endpoint's URL that speak of a product.
ENDPOINT_WORDS = ["product", "item", "price", "stock", "inventory", "variant"]
#: Words of a dialog, by its kind, in the order in which they are tried.
MODAL_WORDS = {
    "subscription": ["newsletter", "subscribe", "email", "signup", "join"],
    "cookie_consent": ["cookie", "consent", "privacy", "gdpr", "tracking", "accept"],
    "age_verification": ["age", "verify", "18+", "adult", "birthday", "confirm"],
    "newsletter": ["newsletter", "updates", "news", "email"],
    "popup_ad": ["sale", "discount", "offer", "deal", "promo"],
    "login_prompt": ["login", "sign in", "account", "register"],
}


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts is found; false for null."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def is_challenge(page: Column) -> Column:
    return (F.length(page) <= SHORT_PAGE) & any_of(F.lower(page), CHALLENGE_MARKS)


def effective_status(page: Column, status: Column, marks: list[str]) -> Column:
    """429 where a short page carries a soft error's mark."""
    return F.when((F.length(page) < SHORT_PAGE) & any_of(F.lower(page), marks), F.lit(429)).otherwise(status)


def is_extracted(name: Column, price: Column, images: Column, description: Column, status: Column | None = None) -> Column:
    """A real name and a price, an image or a description; never from a failed load."""
    real = (F.length(F.trim(name)) > 1) & ~F.lower(F.trim(name)).isin(GARBAGE_NAMES)
    filled = (F.coalesce(price, F.lit(0.0)) != 0) | (F.coalesce(F.size(images), F.lit(0)) > 0) | (F.coalesce(F.length(description), F.lit(0)) > 10)
    loaded = F.lit(True) if status is None else F.coalesce(~status.isin(FAILED_STATUSES), F.lit(True))
    return F.coalesce(real & filled & loaded, F.lit(False))


def is_product_image(url: Column) -> Column:
    low = F.lower(url)
    return ~any_of(low, IMAGE_HOSTS) & ~any_of(low, IMAGE_PATHS) & ~F.coalesce(low.endswith(".svg"), F.lit(False))


def is_saved_image(url: Column) -> Column:
    """An image worth keeping: no junk path, gif or vector, no narrow width, no thumbnail size."""
    low, width = F.lower(url), extract(query(url), r"(?:^|&)width=(\d+)").cast("int")
    small = low.rlike("_140x140|_100x100|_50x50") | low.rlike(r"\.(gif|svg)(\?|$)")
    return F.coalesce(~any_of(F.lower(path(url)), SAVED_IMAGE_PATHS) & ~small & F.coalesce(width >= 200, F.lit(True)), F.lit(False))


def is_useful_response(url: Column, body: Column) -> Column:
    return ~any_of(F.lower(F.split_part(url, F.lit("?"), F.lit(1))), USELESS_RESPONSES) & (F.length(body) >= LEAST_RESPONSE)


def is_utility(name: Column, url: Column) -> Column:
    return any_of(F.lower(name), UTILITY_NAMES) | any_of(F.lower(url), ["/cart", "/account", "/login", "/search", "/help", "/policies"]) | F.coalesce(url.startswith("#"), F.lit(False))


def is_all_category(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\ball\b"), F.lit(False))


def is_homepage(url: Column, base: Column) -> Column:
    return (host(url) == host(base)) & path(url).isin("", "/")


def is_product_link(url: Column) -> Column:
    return F.lower(path(url)).rlike("/(products?|p|item)/")


def is_same_category(url: Column, current: Column) -> Column:
    """The same listing but for its page, and not the current URL."""
    rest = lambda u: F.array_sort(F.filter(F.split(query(u), "&"), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin("page", "p", "pg", "offset", "start")))
    return (host(url) == host(current)) & (path(url) == path(current)) & (rest(url) == rest(current)) & (url != current)


def is_valid_session(now: Column, expires_at: Column, active: Column) -> Column:
    return F.coalesce(~(now > expires_at) & active, F.lit(False))


def matches_truth(field: str, value: Column, truth: Column) -> Column:
    """Whether an extracted field agrees with the truth; where the truth is missing, whether there is a value at all."""
    if field == "price":
        return F.when(F.coalesce(truth, F.lit(0.0)) == 0, value.isNotNull()).otherwise(F.coalesce(F.abs(value - truth) < 0.02, F.lit(False)))
    if field == "variants":
        n = F.coalesce(truth, F.lit(0))
        return (n == 0) | F.coalesce((value > 0) & (F.abs(value - n) <= F.greatest(F.lit(2.0), n * 0.3)), F.lit(False))
    present, known = F.coalesce(value, F.lit("")) != "", F.coalesce(truth, F.lit("")) != ""
    a, b = F.lower(value), F.lower(truth)
    agrees = {"currency": a == b, "name": F.contains(a, b) | F.contains(b, a), "description": F.length(value) >= 0.3 * F.length(truth)}.get(field, F.lit(True))
    return F.when(known, F.coalesce(present & agrees, F.lit(False))).otherwise(present)


def is_complete(name: Column, price: Column, currency: Column, images: Column, description: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return filled(name) & price.isNotNull() & filled(currency) & (F.coalesce(F.size(images), F.lit(0)) > 0) & filled(description)


def scrapability(links: Column) -> tuple[Column, Column]:
    """(high or low, seconds) from the links of a page that lead to collections or products."""
    n = F.size(F.filter(links, lambda u: F.contains(u, F.lit("/collection")) | F.contains(u, F.lit("/product"))))
    return F.when(n > 3, F.lit("high")).otherwise(F.lit("low")), n * 5


def is_duplicate_block(before: Column, after: Column) -> Column:
    """Whether four fifths of a block's lines were there before."""
    lines = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x: F.ltrim(x)), lambda x: x != "")
    new = lines(after)
    return (F.size(new) > 0) & (F.size(F.filter(new, lambda x: F.array_contains(lines(before), x))) >= 0.8 * F.size(new))


def title_verdict(title: Column, brand: Column, season_year: Column, kind: Column, banned: list[str]) -> Column:
    """ok, or the first rule that a video title breaks: brand, source, year, collection type."""
    low = F.lower(title)
    found = F.regexp_extract(low, "(20[0-9]{2})", 1)
    wrong_kind = F.when(kind == "couture", ~F.contains(low, F.lit("couture"))).when(kind == "menswear", ~low.rlike("mens?wear|men's")).otherwise(F.contains(low, F.lit("couture")) | low.rlike("mens?wear"))
    return F.when(~F.contains(low, F.lower(brand)), F.lit("brand")).when(any_of(low, banned), F.lit("source")).when((found != "") & (found != season_year.cast("string")), F.lit("year")).when(wrong_kind, F.lit("collection type")).otherwise(F.lit("ok"))


def missing_fields(**flags: Column) -> Column:
    """The names of the flags that are true, in order."""
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull())


def completeness_score(name: Column, price: Column, currency: Column, images: Column, description: Column, variants: Column, any_availability: Column, brand: Column, sku: Column, category: Column) -> Column:
    """0 to 100: 15 name, 15 price, 5 currency, 15 images, 10 description, 15 variants and 10 more if one's availability is known, 5 each for brand, sku, category."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    points = [(filled(name), 15), (price.isNotNull(), 15), (filled(currency), 5), (has(images), 15), (filled(description), 10), (has(variants), 15), (has(variants) & any_availability, 10), (filled(brand), 5), (filled(sku), 5), (filled(category), 5)]
    total = F.lit(0)
    for test, n in points:
        total = total + F.when(test, F.lit(n)).otherwise(F.lit(0))
    return total


def is_response_tracker(url: Column) -> Column:
    return any_of(F.lower(url), RESPONSE_TRACKERS)


def is_endpoint_tracker(url: Column) -> Column:
    return any_of(F.lower(host(url)), ENDPOINT_TRACKERS)


def endpoint_score(url: Column, product_fields: Column, size: Column, content_type: Column) -> Column:
    """How useful an endpoint seems: 10 for each product field, 5 and 10 for its size, 15 for JSON, 20 for each word of its URL that speaks of
    a product, 100 less for a tracker."""
    score = 10 * product_fields + F.when(size > 1000, 5).otherwise(0) + F.when(size > 5000, 10).otherwise(0) + F.when(F.contains(content_type, F.lit("json")), 15).otherwise(0)
    for word in ENDPOINT_WORDS:
        score = score + F.when(F.contains(F.lower(url), F.lit(word)), 20).otherwise(0)
    return score - F.when(is_endpoint_tracker(url), 100).otherwise(0)


def modal_kind(text: Column) -> Column:
    """The first kind of dialog one of whose words the text has, else unknown."""
    low, out = F.lower(text), F.lit("unknown")
    for kind, words in reversed(MODAL_WORDS.items()):
        out = F.when(any_of(low, words), F.lit(kind)).otherwise(out)
    return out


#: Parts of addresses whose responses a page load passes over.
LOAD_TRACKERS = ["google", "facebook", "analytics", "tracking", "pixel", "doubleclick", "criteo", "onetrust", "cookielaw"]


def is_load_tracker(url: Column) -> Column:
    return any_of(F.lower(url), LOAD_TRACKERS)


def benchmark_score(name: Column, price: Column, images: Column, description: Column) -> Column:
    """0 to 100, what an extraction found: 30 for a name of two characters or more, 30 for a price that isn't "0", 10 each for up to three
    images, 10 for a description of more than ten characters. A null is nothing found."""
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    priced = (price.cast("string") != "") & (price.cast("string") != "0") & (F.coalesce(price.try_cast("double"), F.lit(1.0)) != 0)
    return points(F.length(name) > 1, 30) + points(priced, 30) + 10 * F.least(F.coalesce(F.size(images), F.lit(0)), F.lit(3)) + points(F.length(description) > 10, 10)
