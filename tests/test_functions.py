from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import predicates, text, urls


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_urls(spark) -> None:
    u = lambda x: F.lit(x)
    r = one(
        spark,
        a=urls.canonical(u("https://x.com/collections/all/products/ring/?v=1")),
        b=urls.canonical(u("https://x.com/products/ring#top")),
        c=urls.normalized(u("www.x.com")),
        d=urls.product_id(u("https://x.com/item/AB-12?x=1")),
        e=urls.best_of_srcset(u("a.jpg 100w, b.jpg 900w, c.jpg 500w")),
        f=urls.best_of_srcset(u("http://x/a.jpg")),
        g=urls.image_identity(u("https://x.com/asset/01234567-89ab-cdef-0123-456789abcdef/Large/a.jpg")),
        h=urls.image_identity(u("https://x.com/f/ring_500x500.jpg?width=3&b=1")),
        i=urls.without_size(u("https://x.com/f/ring_140x140.jpg?width=3&v=9")),
        j=urls.absolute(u("//cdn.x.com/a"), u("https://x.com/b/c")),
        k=urls.absolute(u("d"), u("https://x.com/b/c")),
        l=urls.product_name(u("https://x.com/p/red-ring-123456.html")),
        m=urls.product_name(u("https://x.com/p/deadbeef")),
        n=urls.video_id(u("https://youtu.be/abcdefghijk")),
        o=urls.brand_of_host(u("https://www.cos.com/x")),
        p=urls.page_urls(u("https://x.com/c?page=1"), F.lit(3)),
        q=urls.category_name(u("https://x.com/collections/new-in")),
        r=urls.looks_like_api(u("https://x.com/API/a")),
        s=urls.favicons(u("https://x.com/a"), F.array(F.lit("https://x.com/favicon.ico"))),
        t=urls.canonical(F.lit(None).cast("string")),
    )
    assert r["a"] == "https://x.com/products/ring" and r["b"] == "https://x.com/products/ring#top" and r["c"] == "https://x.com/"
    assert r["d"] == "AB-12" and r["e"] == "b.jpg" and r["f"] == "http://x/a.jpg"
    assert r["g"] == "x.com|asset|01234567-89ab-cdef-0123-456789abcdef" and r["h"] == "x.com|/f/ring_500x500.jpg|ring|b=1" and r["i"] == "https://x.com/f/ring.jpg?v=9"
    assert r["j"] == "https://cdn.x.com/a" and r["k"] == "https://x.com/b/d" and r["l"] == "Red Ring" and r["m"] is None and r["n"] == "abcdefghijk" and r["o"] == "COS"
    assert r["p"] == ["https://x.com/c?page=2", "https://x.com/c?page=3"] and r["q"] == "New In" and r["r"] and len(r["s"]) == 4 and r["t"] is None


def test_text(spark) -> None:
    r = one(
        spark,
        a=text.price(F.lit("$1,299.50")), b=text.price(F.lit("1.299.50")), c=text.undoubled(F.lit("new in new in")), d=text.season(F.lit("Acme_FW_2021")), e=text.year(F.lit("a2021b")),
        f=text.duration(F.lit(3725)), g=text.clean_description(F.lit("a&amp;lt;b&amp;gt;\\u00e9 <p>x</p>\\n y")), h=text.between(F.lit("a[[x]]b"), "[[", "]]"), i=text.json_object(F.lit('Sure:\n```json\n{"a": 1}\n```')).cast("string"),
        j=text.extension_of(F.lit("image/jpeg; q=1")), k=text.designer(F.lit("john-doe-spring-2020-3.jpg")), l=text.look_number(F.lit("a-12.jpg")), m=text.valid_size(F.lit("10.5")), n=text.valid_size(F.lit("enormous")),
        o=text.unescaped(F.lit('a\\"b\\/c')), p=text.token_cost(F.lit(1_000_000), F.lit(2_000_000)), q=text.path_signature(F.lit("div > div.grid > a")), r=text.css_escaped(F.lit("md:w-1")),
    )
    assert r["a"] == 1299.5 and r["b"] is None and r["c"] == "new in" and r["d"] == "fall-winter" and r["e"] == 2021 and r["f"] == "1h 02m"
    assert r["h"] == "x" and r["i"] == '{"a":1}' and r["j"] == ".jpg" and r["k"] == "john doe" and r["l"] == 12 and r["m"] and not r["n"] and r["o"] == 'a"b/c' and r["p"] == 33.0
    assert r["q"] == "div.grid" and r["r"] == "md\\:w-1" and "<" not in r["g"] and "é" in r["g"]


def test_predicates(spark) -> None:
    none = F.lit(None).cast("string")
    r = one(
        spark,
        a=predicates.is_challenge(F.lit("<p>Just a moment</p>")), b=predicates.is_challenge(F.lit("just a moment" + " " * 6000)),
        c=predicates.is_extracted(F.lit("Ring"), F.lit(1.0), F.array().cast("array<string>"), none), d=predicates.is_extracted(F.lit("404"), F.lit(1.0), F.array().cast("array<string>"), none),
        e=predicates.is_extracted(F.lit("Ring"), F.lit(1.0), F.array().cast("array<string>"), none, F.lit(429)), f=predicates.is_product_image(F.lit("https://x/logo.png")), g=predicates.is_product_image(F.lit("https://x/ring.png")),
        h=predicates.is_saved_image(F.lit("https://x/a.jpg?width=100")), i=predicates.is_useful_response(F.lit("https://x/session?a"), F.lit("x" * 200)), j=predicates.is_all_category(F.lit("Shop All")), k=predicates.is_all_category(F.lit("Hall")),
        l=predicates.is_product_link(F.lit("https://x/products/a")), m=predicates.is_same_category(F.lit("https://x/c?page=2&s=1"), F.lit("https://x/c?s=1")), n=predicates.matches_truth("price", F.lit(10.0), F.lit(10.01)),
        o=predicates.matches_truth("name", F.lit("Red Ring"), F.lit("ring")), p=predicates.matches_truth("variants", F.lit(4), F.lit(2)), q=predicates.title_verdict(F.lit("Acme Fall 2020"), F.lit("acme"), F.lit(2021), F.lit("ready-to-wear"), ["remix"]),
        r=predicates.is_duplicate_block(F.lit("a\nb\nc\nd"), F.lit(" a\nb\nc\nd\ne")), s=predicates.missing_fields(name=F.lit(True), price=F.lit(False), images=F.lit(True)), t=predicates.is_utility(F.lit("Log in / Login"), F.lit("https://x/a")),
        u=predicates.effective_status(F.lit("rate limit"), F.lit(200), ["rate limit"]), v=predicates.is_homepage(F.lit("https://x/"), F.lit("https://x/a")), w=predicates.scrapability(F.array(F.lit("/product/1")))[0],
        x=predicates.is_complete(F.lit("a"), F.lit(0.0), F.lit("USD"), F.array(F.lit("i")), F.lit("d")), y=predicates.is_valid_session(F.lit(5), F.lit(4), F.lit(True)),
    )
    assert r["a"] and not r["b"] and r["c"] and not r["d"] and not r["e"] and not r["f"] and r["g"] and not r["h"] and not r["i"] and r["j"] and not r["k"] and r["l"] and r["m"] and r["n"] and r["o"] and r["p"]
    assert r["q"] == "year" and r["r"] and r["s"] == ["name", "images"] and r["t"] and r["u"] == 429 and r["v"] and r["w"] == "low" and r["x"] and not r["y"]
