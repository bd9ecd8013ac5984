"""What a stored page tells: title, text, contacts, profiles, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import is_profile, social_network
from .text import col, strip_accents

# Patterns, words and area codes that results depend on.
VIDEO = {
    "YouTube": r"youtube(?:-nocookie)?\.com/(?:embed|watch|shorts)|youtu\.be/",
    "Vimeo": r"player\.vimeo\.com|vimeo\.com/\d+",
    "vídeo HTML5": r"<video[\s>]",
    "Instagram Reels": r"instagram\.com/reels?/",
    "TikTok": r"tiktok\.com/@[\w.]+/video/|tiktok\.com/embed",
    "Wistia/Vidyard": r"wistia\.(?:com|net)|vidyard\.com",
}
HINTS = [
    "lançamento", "lançamentos", "inauguração", "inauguramos", "nova unidade", "novas unidades", "em breve", "eventos", "evento", "reserve", "reservas", "agende",
    "agendamento", "cardápio", "franquia", "franquias", "nossas unidades", "casamentos", "festas", "pré-lançamento", "empreendimento", "decorado",
]
AREAS = (
    "11 12 13 14 15 16 17 18 19 21 22 24 27 28 31 32 33 34 35 37 38 41 42 43 44 45 46 47 48 49 51 53 54 55 61 62 63 64 65 66 67 68 69 "
    "71 73 74 75 77 79 81 82 83 84 85 86 87 88 89 91 92 93 94 95 96 97 98 99"
).split()
FILES = "png|jpe?g|gif|svg|webp|avif|ico|css|js|mjs|json|woff2?|ttf|mp4|webm"
NO_DOMAINS = (
    r"example\.(?:com|org|net)|exemplo\.com(?:\.br)?|domain\.com|dominio\.com(?:\.br)?|seudominio|yourdomain|email\.com|mail\.com|test\.com|teste\.com|"
    r"sentry\.io|sentry-next\.wixpress\.com|wixpress\.com|wix\.com|godaddy\.com|schema\.org|w3\.org"
)
NO_NAMES = "nome|seunome|seuemail|email|e-mail|usuario|user|exemplo|example|fulano|contato@contato|your|you|name|noreply|no-reply|donotreply"
SHOWN_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LINKED_MAIL = r"""(?i)href=["']mailto:([^"'?]+)"""
LINKED_PHONE = r"""(?i)href=["']tel:([^"']+)"""
LINKED_WHATSAPP = r"(?i)(?:wa\.me/|whatsapp\.com/send/?\?phone=)\+?(\d{10,13})"
SHOWN_PHONE = r"(?<![\d/.-])(?:\+?55[\s.-]?)?\(?0?(\d{2})\)?[\s.-]?(9?\d{4})[\s.-](\d{4})(?![\d/-])"


def plausible_email(c: Column) -> Column:
    """The address in lower case, if it is neither a file's name, a placeholder nor a hash; else null."""
    e = F.lower(F.trim(c))
    name, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    fine = e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & ~domain.rlike(rf"\.(?:{FILES})$") & ~e.rlike(r"@\d+x\.") & ~domain.rlike(rf"(?:^|\.)(?:{NO_DOMAINS})$") & ~name.rlike(f"^(?:{NO_NAMES})$") & ~name.rlike("^[0-9a-f]{16,}$")
    return F.when(fine, e)


def plausible_phone(c: Column) -> Column:
    """10 or 11 digits with a known area, a mobile number of nine that begins with 9 or another of eight that begins with 2 to 5; else null."""
    d = F.regexp_replace(c, "[^0-9]", "")
    local = F.regexp_replace(F.regexp_replace(d, "^55(?=[0-9]{10})", ""), "^0(?=[0-9]{10})", "")
    number = F.substring(local, 3, 20)
    fine = local.rlike("^[0-9]{2}(?:9[0-9]{8}|[2-5][0-9]{7})$") & F.substring(local, 1, 2).isin(*AREAS) & ~number.rlike(r"^(\d)\1+$")
    return F.when(fine, local)


def _decoded(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _first(found: Column) -> Column:
    return F.get(F.array_compact(found), F.lit(0))


def _named(c: Column, f) -> Column:
    """f of an expression that is computed once."""
    return F.transform(F.array(c), f)[0]


def _found(html: Column, text: Column) -> Column:
    """struct of all matches that contacts come from, plausible or null: mail and phone numbers of links, and in the visible text, and numbers of message links."""
    every = lambda c, pattern, group=1: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.struct(
        F.transform(every(html, LINKED_MAIL), lambda x: plausible_email(_decoded(x))).alias("mail_links"),
        F.transform(every(text, SHOWN_MAIL, 0), plausible_email).alias("mail_shown"),
        F.transform(every(html, LINKED_PHONE), lambda x: plausible_phone(_decoded(x))).alias("phone_links"),
        every(text, SHOWN_PHONE, 0).alias("phone_shown"),
        F.transform(every(html, LINKED_WHATSAPP), plausible_phone).alias("whatsapp"),
    )


def _contact(found: Column) -> Column:
    parts = lambda m: F.concat(*[F.regexp_extract(m, SHOWN_PHONE, g) for g in (1, 2, 3)])
    origin = lambda link, shown: F.when(link.isNotNull(), "link").when(shown.isNotNull(), "text")
    first = F.struct(
        _first(found["mail_links"]).alias("ml"),
        _first(found["mail_shown"]).alias("mt"),
        _first(found["whatsapp"]).alias("w"),
        _first(found["phone_links"]).alias("pl"),
        _first(F.transform(found["phone_shown"], lambda m: plausible_phone(parts(m)))).alias("pt"),
    )
    return _named(first, lambda x: F.struct(F.coalesce(x["ml"], x["mt"]).alias("email"), F.coalesce(x["pl"], x["pt"]).alias("phone"), x["w"].alias("whatsapp"), origin(x["ml"], x["mt"]).alias("email_origin"), origin(x["pl"], x["pt"]).alias("phone_origin")))


def _all_emails(found: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(found["mail_links"], found["mail_shown"])))


def _all_phones(found: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(found["phone_links"], F.transform(found["phone_shown"], plausible_phone))))


def contacts(html: Column | str) -> Column:
    """struct(email, phone, whatsapp, email_origin, phone_origin): the first plausible one of links, else of the visible text."""
    return _named(visible_text(html), lambda t: _named(_found(col(html), t), _contact))


def title(html: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta_description(html: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(html), r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1)), F.lit(""))


def visible_text(html: Column | str) -> Column:
    t = F.regexp_replace(col(html), r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"""(?i)href=["']([^"'#]+)["']"""), F.lit(1))


def emails(html: Column | str) -> Column:
    """All plausible addresses: of mailto links first, then of the visible text."""
    return _named(visible_text(html), lambda t: _named(_found(col(html), t), _all_emails))


def phones(html: Column | str) -> Column:
    """Digits of all plausible numbers: of tel links first, then of the visible text."""
    return _named(visible_text(html), lambda t: _named(_found(col(html), t), _all_phones))


def profiles(html: Column | str) -> Column:
    """map(network, first profile link)."""
    found = F.filter(F.transform(links(html), lambda u: F.struct(social_network(u).alias("network"), u.alias("url"))), lambda s: s["network"].isNotNull() & is_profile(s["url"]))
    start = F.create_map().cast("map<string,string>")
    return F.aggregate(found, start, lambda acc, s: F.when(F.map_contains_key(acc, s["network"]), acc).otherwise(F.map_concat(acc, F.create_map(s["network"], s["url"]))))


def videos(html: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(col(html).rlike("(?i)" + p), F.lit(n)) for n, p in VIDEO.items()]))


def _hints(text: Column, words: list[str]) -> Column:
    found = lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lower(strip_accents(F.lit(w)))), F.lit(w)) for w in words]))
    return F.slice(_named(F.lower(strip_accents(text)), found), 1, 10)


def hints(html: Column | str, words: list[str] = HINTS) -> Column:
    """The first ten of the words that the visible text has, whatever the accents and the case."""
    return _hints(visible_text(html), words)


def content_hash(html: Column | str) -> Column:
    return F.substring(F.sha2(F.encode(F.substring(col(html), 1, 5000), "utf-8"), 256), 1, 16)


def page_features(html: Column | str) -> Column:
    """All features of a page in one struct; its visible text and its matches are computed once."""
    h = col(html)
    flag = lambda p: h.rlike("(?is)" + p)
    of_found = lambda f: F.struct(_all_emails(f).alias("emails"), _all_phones(f).alias("phones"), _contact(f).alias("contact"))
    of_text = _named(visible_text(h), lambda t: F.struct(_named(_found(h, t), of_found).alias("found"), _hints(t, HINTS).alias("hints")))
    whole = lambda x: F.struct(
        title(h).alias("title"),
        meta_description(h).alias("description"),
        x["found"]["emails"].alias("emails"),
        x["found"]["phones"].alias("phones"),
        x["found"]["contact"].alias("contact"),
        profiles(h).alias("profiles"),
        videos(h).alias("videos"),
        x["hints"].alias("hints"),
        flag(r"href=[\"'][^\"']*(?:contato|contact)").alias("contact_page"),
        flag(r"wa\.me/|api\.whatsapp\.com|<form").alias("call_to_action"),
        flag(r"href=[\"'][^\"']*/blog").alias("blog"),
        content_hash(h).alias("content_hash"),
    )
    return _named(of_text, whole)
