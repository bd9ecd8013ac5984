"""Telephone numbers, tax ids, activity codes, e-mails, addresses of sites and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, fold_text, name_similarity, normalize_business_name, significant_tokens

# Hosts, providers and weights that results depend on.
PLATFORM_HOSTS = (
    "instagram.com facebook.com fb.com fb.me m.facebook.com tiktok.com linkedin.com youtube.com youtu.be wa.me api.whatsapp.com whatsapp.com linktr.ee linktree.com "
    "bit.ly goo.gl google.com maps.google.com g.page ifood.com.br aiqfome.com anota.ai cardapioweb.com goomer.app twitter.com x.com beacons.ai taplink.cc"
).split()
NETWORKS = {"instagram": ["instagram.com"], "facebook": ["facebook.com", "fb.com", "fb.me"], "tiktok": ["tiktok.com"], "linkedin": ["linkedin.com"], "youtube": ["youtube.com", "youtu.be"]}
PROFILE = {"instagram": "https://www.instagram.com/", "facebook": "https://www.facebook.com/", "tiktok": "https://www.tiktok.com/@", "linkedin": "https://www.linkedin.com/company/", "youtube": "https://www.youtube.com/@"}
FREE_MAIL = "gmail.com hotmail.com outlook.com yahoo.com yahoo.com.br icloud.com live.com bol.com.br uol.com.br terra.com.br ig.com.br".split()
FIRST_WEIGHTS = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def digits(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def phone(c: Column | str) -> Column:
    """struct(area, number, valid): the country code 55 goes only where more than 11 digits stand."""
    d = digits(c)
    local = F.when((F.length(d) > 11) & d.startswith("55"), F.substring(d, 3, 20)).otherwise(d)
    long = F.length(local).isin(10, 11)
    area = F.when(long, F.substring(local, 1, 2))
    number = F.when(long, F.substring(local, 3, 20)).otherwise(local)
    return F.struct(area.alias("area"), number.alias("number"), (area.isNotNull() & F.length(number).isin(8, 9)).alias("valid"))


def phone_key(c: Column | str) -> Column:
    p = phone(c)
    return F.when(p["valid"], F.concat(p["area"], p["number"]))


def is_mobile(c: Column | str) -> Column:
    return F.coalesce(phone_key(c).rlike("^[0-9]{2}9[0-9]{8}$"), F.lit(False))


def format_phone(c: Column | str) -> Column:
    key = phone_key(c)
    return F.coalesce(F.regexp_replace(key, "^(..)(.{4,5})(.{4})$", r"($1) $2-$3"), col(c))


def split_phones(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[;,/]|\s{2,}"), lambda p: F.trim(p)), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 8)


def repair_mobile(c: Column | str) -> Column:
    """Old mobile numbers of 8 digits that begin with 6 to 9 get their 9."""
    return F.when(col(c).rlike("^[6-9][0-9]{7}$"), F.concat(F.lit("9"), col(c))).otherwise(col(c))


def tax_id(c: Column | str) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, d)


def _check_digit(numbers: Column, weights: list[int]) -> Column:
    total = F.aggregate(F.zip_with(numbers, F.array(*map(F.lit, weights)), lambda n, w: n * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.transform(F.array(total % 11), lambda rest: F.when(rest < 2, 0).otherwise(11 - rest))[0]


def is_valid_tax_id(c: Column | str) -> Column:
    """14 digits, not one repeated, both check digits right."""

    def valid(d: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(d, F.lit("[0-9]"), F.lit(0)), lambda x: x.cast("int"))
        right = lambda n: (_check_digit(n, FIRST_WEIGHTS) == F.get(n, F.lit(12))) & (_check_digit(n, [6, *FIRST_WEIGHTS]) == F.get(n, F.lit(13)))
        return ~d.rlike(r"^(\d)\1{13}$") & F.transform(F.array(numbers), right)[0]

    # A one-element array names the digits: they would else be computed for each use.
    return F.coalesce(F.transform(F.array(tax_id(c)), lambda d: F.when(d.isNotNull(), valid(d)))[0], F.lit(False))


def format_tax_id(c: Column | str) -> Column:
    return F.regexp_replace(tax_id(c), r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")


def format_activity(c: Column | str) -> Column:
    return F.regexp_replace(F.lpad(digits(c), 7, "0"), r"^(\d{4})(\d)(\d{2})$", "$1-$2/$3")


def import_domain(c: Column | str) -> Column:
    """The looser domain of imports: platforms are not left out."""
    return host(c)


def email(c: Column | str) -> Column:
    e = F.lower(F.trim(col(c)))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), e)


def host(c: Column | str) -> Column:
    """The host of an address, lower case, without www.; null if there is no dot in it or white space in the address."""
    raw = F.trim(col(c))
    whole = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    name = F.lower(F.regexp_extract(whole, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when((raw != "") & ~raw.rlike(r"\s") & F.contains(name, F.lit(".")), F.regexp_replace(name, r"^www\.", ""))


def is_platform(h: Column) -> Column:
    return h.isin(*PLATFORM_HOSTS) | h.rlike(r"\.(?:" + "|".join(x.replace(".", r"\.") for x in PLATFORM_HOSTS) + ")$")


def website_domain(c: Column | str) -> Column:
    h = host(c)
    return F.when(~is_platform(h), h)


def social_network(c: Column | str) -> Column:
    h = host(c)
    out = F.lit(None).cast("string")
    for name, hosts in reversed(NETWORKS.items()):
        out = F.when(h.rlike(r"(?:^|\.)(?:" + "|".join(x.replace(".", r"\.") for x in hosts) + ")$"), F.lit(name)).otherwise(out)
    return out


def normalize_social(network: str, c: Column | str) -> Column:
    """A profile's address from an address or a handle; null if it is neither."""
    raw = F.trim(col(c))
    path = F.regexp_replace(F.regexp_extract(raw, r"(?i)^(?:https?://)?[^/?#]+(/[^?#]*)", 1), "/+$", "")
    own = social_network(raw) == network
    site = F.concat(F.lit("https://www."), F.regexp_replace(host(raw), r"^m\.", ""), path)
    handle = F.regexp_replace(raw, "^@", "")
    return F.when(F.coalesce(own, F.lit(False)), F.when(path != "", site)).when(handle.rlike("^[A-Za-z0-9_.-]{2,60}$"), F.concat(F.lit(PROFILE[network]), handle))


def is_profile(c: Column | str) -> Column:
    """False for posts and share buttons."""
    return ~F.coalesce(col(c).rlike(r"(?i)/(?:p|reel|reels|stories|explore|sharer|share|intent|watch|embed|plugins|status|hashtag)(?:[/.?]|$)"), F.lit(True))


def domain_matches_name(domain: Column | str, name: Column | str) -> Column:
    label = F.replace(fold_text(F.substring_index(col(domain), ".", 1)), F.lit(" "), F.lit(""))
    tokens = significant_tokens(normalize_business_name(name))
    return (
        F.when(col(domain).isNull() | col(name).isNull() | (col(name) == ""), "LOW")
        .when(F.size(tokens) == 0, "MEDIUM")
        .when(F.exists(tokens, lambda t: F.contains(label, t)), "HIGH")
        .when(name_similarity(label, F.array_join(tokens, "")) >= 0.4, "MEDIUM")
        .otherwise("LOW")
    )


def website_from_email(mail: Column | str, name: Column | str) -> Column:
    """The domain of a business's own e-mail address; null for free mail, public bodies, platforms, and domains unlike the name."""
    domain = F.substring_index(email(mail), "@", -1)
    own = ~domain.isin(*FREE_MAIL) & ~domain.rlike(r"\.(?:gov|edu|jus|leg|mil)(?:\.br)?$") & ~is_platform(domain) & (domain_matches_name(domain, name) != "LOW")
    return F.when(own, domain)
