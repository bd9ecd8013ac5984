from pyspark.sql import functions as F

from prospector.functions import dates, geo, html, ids, text


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_places_by_name(spark):
    cases = [("Sobral", "CE"), ("Sobral - CE", None), ("Sobral/CE", None), ("Sobral, Ceará", None), ("SOBRAL (CE)", None), ("sobral", "ce")]
    got = values(spark, *[text.normalize_location(F.lit(c), F.lit(s).cast("string")) for c, s in cases])
    assert {(r["city"], r["state"]) for r in got} == {("Sobral", "CE")}
    got = values(spark, text.normalize_location(F.lit("São João do Jaguaribe"), F.lit("CE")), text.normalize_location(F.lit("rio de janeiro - rj")))
    assert [(r["city"], r["state"]) for r in got] == [("São João do Jaguaribe", "CE"), ("Rio de Janeiro", "RJ")]
    assert values(spark, *[text.normalize_uf(F.lit(x)) for x in ("Ceará", "ceara", "XX")]) == ["CE", "CE", None]


def test_business_names(spark):
    cases = [("RESTAURANTE X LTDA", None), ("Restaurante X", None), ("Restaurante X - Sobral", "Sobral")]
    assert values(spark, *[text.normalize_business_name(F.lit(a), F.lit(c) if c else None) for a, c in cases]) == ["restaurante x"] * 3
    assert values(spark, text.name_similarity(F.lit("abc"), F.lit("abc")), text.name_similarity(F.lit(""), F.lit("a"))) == [1.0, 0.0]


def test_phones(spark):
    assert values(spark, *[ids.phone_key(F.lit(x)) for x in ("(88) 99999-9999", "5588999999999", "88999999999", "123")]) == ["88999999999"] * 3 + [None]
    assert values(spark, ids.is_mobile(F.lit("88999990000")), ids.is_mobile(F.lit("8836110000")), ids.split_phones(F.lit("+55 88 3611-0000;+55 88 99999-0000"))) == [True, False, ["+55 88 3611-0000", "+55 88 99999-0000"]]


def test_tax_ids(spark):
    assert values(spark, *[ids.is_valid_tax_id(F.lit(x)) for x in ("11.222.333/0001-81", "11222333000180", "11111111111111", "1")]) == [True, False, False, False]
    assert values(spark, ids.format_tax_id(F.lit("11222333000181"))) == ["11.222.333/0001-81"]


def test_sites_and_profiles(spark):
    assert values(spark, *[ids.website_domain(F.lit(x)) for x in ("https://www.aragao.com.br/menu", "https://instagram.com/x", "ifood.com.br/y", "no dots", "a b.com")]) == ["aragao.com.br", None, None, None, None]
    assert values(spark, *[ids.normalize_social("instagram", F.lit(x)) for x in ("@aragao", "instagram.com/aragao/", "not a handle!!")]) == ["https://www.instagram.com/aragao", "https://www.instagram.com/aragao", None]
    assert values(spark, ids.domain_matches_name(F.lit("aragao.com.br"), F.lit("Restaurante Aragão")), ids.domain_matches_name(F.lit("xyzfoods.com"), F.lit("Restaurante Aragão"))) == ["HIGH", "LOW"]
    assert values(spark, *[ids.website_from_email(F.lit(m), F.lit("Restaurante Aragão")) for m in ("a@aragao.com.br", "a@gmail.com", "a@aragao.gov.br", "a@contador.com")]) == ["aragao.com.br", None, None, None]


def test_templates_and_lists(spark):
    r = text.render_template(F.lit("{a} {b} {c}"), {"a": F.lit("x"), "b": F.lit("")})
    got = values(spark, r, text.ordered_distinct(F.array(F.lit("A"), F.lit("b"), F.lit("a"))), text.round_half_up(F.lit(-2.5)))
    assert (got[0]["text"], got[0]["missing"], got[1], got[2]) == ("x [b?] {c}", ["b"], ["A", "b"], -2)


def test_geo_and_dates(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    hole = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))])
    shape = F.array(ring, hole)
    inside = [geo.in_polygon(F.lit(x), F.lit(y), shape) for x, y in ((3.0, 3.0), (1.5, 1.5), (5.0, 1.0))]
    assert values(spark, *inside) == [True, False, False]
    assert str(values(spark, dates.compact_date(F.lit("20260102")))[0]) == "2026-01-02"
    assert values(spark, dates.compact_date(F.lit("00000000")), dates.recency_bonus(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-20"))) == [None, 2]


def test_pages(spark):
    page = """<html><head><title> A &amp; B </title><script>x@script.com</script></head><body><a href="mailto:Info@a.com.br">m</a> logo@2x.png me@a.com.br
    (88) 3611-0000 1288361100001 <a href="https://instagram.com/p/1">p</a><a href="https://instagram.com/abc">i</a><a href="/contato">c</a><video src=x></video> Promoção CARDAPIO Em breve</body></html>"""
    f = values(spark, html.page_features(F.lit(page)))[0]
    assert f["title"] == "A &amp; B" and f["emails"] == ["info@a.com.br", "me@a.com.br"] and f["phones"] == ["8836110000"]
    assert f["profiles"] == {"instagram": "https://instagram.com/abc"} and f["videos"] == ["vídeo HTML5"] and f["contact_page"] and f["hints"] == ["em breve", "cardápio"]
    assert f["contact"].asDict() == {"email": "info@a.com.br", "phone": "8836110000", "whatsapp": None, "email_origin": "link", "phone_origin": "text"}


def contacts_by_hand(page):
    import re
    from urllib.parse import unquote

    def mail(x):
        e = x.strip().lower()
        m = re.fullmatch(r"([a-z0-9._%+-]+)@([a-z0-9.-]+\.[a-z]{2,})", e)
        bad = not m or re.search(rf"\.({html.FILES})$", m[2]) or re.search(r"@\d+x\.", e) or re.search(rf"(^|\.)({html.NO_DOMAINS})$", m[2]) or re.fullmatch(html.NO_NAMES, m[1]) or re.fullmatch("[0-9a-f]{16,}", m[1])
        return None if bad else e

    def number(x):
        d = re.sub("[^0-9]", "", x)
        d = d[2:] if d.startswith("55") and len(d) >= 12 else d
        d = d[1:] if d.startswith("0") and len(d) >= 11 else d
        n = d[2:]
        right = len(d) in (10, 11) and d[:2] in html.AREAS and (n[0] == "9" if len(n) == 9 else n[0] in "2345") and len(set(n)) > 1
        return d if right else None

    first = lambda xs: next((x for x in xs if x), None)
    text = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1>", " ", page)
    text = re.sub(r"(?s)<[^>]+>", " ", text).replace("&nbsp;", " ").replace("&amp;", "&")
    text = re.sub(r"\s+", " ", text)
    link = first(mail(unquote(x)) for x in re.findall(r"(?i)href=[\"']mailto:([^\"'?]+)", page))
    tel = first(number(unquote(x)) for x in re.findall(r"(?i)href=[\"']tel:([^\"']+)", page))
    shown = first(mail(x) for x in re.findall(html.SHOWN_MAIL, text))
    phone = first(number("".join(x)) for x in re.findall(html.SHOWN_PHONE, text, re.ASCII))
    whatsapp = first(number(x) for x in re.findall(r"(?i)(?:wa\.me/|whatsapp\.com/send/?\?phone=)\+?(\d{10,13})", page))
    return link or shown, tel or phone, whatsapp, "link" if link else "text" if shown else None, "link" if tel else "text" if phone else None


def test_contacts_by_hand(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += [
        None, "", '<a href="tel:+55%20(88)%203611-0000">x</a> <a href="mailto:a%40b.com.br?x">m</a>', "call 088 99999-1234 or (88) 3611 2222", "5588991234567 +55 88 99123-4567", "x@2x.png noreply@a.com deadbeefdeadbeef@a.com ok@b.co",
        "https://wa.me/5588991234567 api.whatsapp.com/send?phone=8836110000", "(20) 3611-0000 (88) 99999-9999 (88) 1611-0000 88 2611-0000-1", '<script>a@b.com</script> 11 5555-5555',
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "i long, html string").select("i", html.contacts("html").alias("c")).collect()
    got = {r["i"]: tuple(r["c"]) for r in rows}
    assert [got[i] for i in range(len(pages))] == [contacts_by_hand(p or "") for p in pages]
