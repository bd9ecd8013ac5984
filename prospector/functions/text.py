"""Text: folding, business names, similarity, templates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks, and the characters that canonical decomposition takes apart into an ASCII character and such marks.
MARKS = "".join(map(chr, range(0x300, 0x370)))
DECOMPOSED = {c: d[0] for c in map(chr, range(0x80, 0x10000)) if (d := unicodedata.normalize("NFD", c)) != c and d[0].isascii() and not d[1:].strip(MARKS)}
ACCENTED = "".join(DECOMPOSED) + MARKS  # marks have no counterpart in PLAIN and are deleted
PLAIN = "".join(DECOMPOSED.values())

# Words that results depend on.
LEGAL_SUFFIXES = r"\b(ltda|me|epp|eireli|sa|mei|limitada|comercio|servicos|com|serv)\b"
GENERIC_WORDS = (
    "restaurante restaurant lanchonete lanches bar pizzaria pizza cafe cafeteria padaria comida casa ponto espaco centro clinica loja salao "
    "studio estudio academia hotel pousada oficina auto pet shop do da de dos das e o a the grill churrascaria hamburgueria burger sorveteria delivery food"
).split()
STOP_WORDS = ["de", "da", "do", "das", "dos", "e", "a", "o", "the", "and"]
JUNK_NAMES = "sem nome|nome|desconhecido|unknown|teste?|test|xxx+|null|undefined"
SMALL_WORDS = ["de", "da", "do", "das", "dos", "e"]
STATES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás",
    "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul", "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná", "PE": "Pernambuco", "PI": "Piauí",
    "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte", "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina", "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_in(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def present(c: Column | str) -> Column:
    """Text with empty and blank as null: absence is unknown."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, for negative numbers too."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def strip_accents(c: Column | str) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def fold_text(c: Column | str) -> Column:
    """Without accents, lower case, runs of all else than a-z0-9 as one space; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " ")), F.lit(""))


def dedup_name(c: Column | str) -> Column:
    """Like fold_text, but other characters are deleted and spaces stay as they are."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9 ]", ""))


def normalize_uf(c: Column | str) -> Column:
    """A state's code or name as its code; null if there is none."""
    raw = F.trim(col(c))
    names = F.create_map(*[x for uf, name in STATES.items() for x in (fold_text(F.lit(name)), F.lit(uf))])
    return F.when(F.upper(raw).isin(*STATES), F.upper(raw)).otherwise(F.try_element_at(names, fold_text(raw)))


def title_city(c: Column | str) -> Column:
    parts = F.split(F.lower(col(c)), " +")
    return F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))), " ")


def normalize_location(city: Column | str, state: Column | str | None = None) -> Column:
    """struct(city, state) of "City", "City - UF", "City/UF", "City, State", "CITY (UF)"."""
    text = F.trim(F.regexp_replace(F.coalesce(col(city), F.lit("")), r"\s+", " "))
    pattern = r"^(.*?)(?:\s*[-/,(]\s*|\s+)([A-Za-zÀ-ÿ ]{2,})\)?\s*$"
    before, uf = F.trim(F.regexp_extract(text, pattern, 1)), normalize_uf(F.regexp_extract(text, pattern, 2))
    stated = uf.isNotNull() & (F.length(before) >= 2)
    name = F.trim(F.regexp_replace(F.when(stated, before).otherwise(text), r"[-/,(]+$", ""))
    name = F.when((name == F.upper(name)) | (name == F.lower(name)), title_city(name)).otherwise(name)
    hint = normalize_uf(col(state)) if state is not None else F.lit(None).cast("string")
    return F.struct(name.alias("city"), F.coalesce(F.when(stated, uf), hint).alias("state"))


def normalize_business_name(name: Column | str, city: Column | str | None = None) -> Column:
    n = F.regexp_replace(fold_text(name), LEGAL_SUFFIXES, " ")
    if city is not None:
        c = fold_text(city)
        tail = F.concat(F.lit(" "), c)
        padded = F.concat(F.lit(" "), n)
        n = F.when((c != "") & padded.endswith(tail), F.substring(padded, F.lit(1), F.length(padded) - F.length(tail))).otherwise(n)
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def significant_tokens(normal_name: Column | str, stop: Column | None = None) -> Column:
    keep = F.filter(F.split(col(normal_name), " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(words_in(GENERIC_WORDS), t))
    return F.array_distinct(F.array_except(keep, stop) if stop is not None else keep)


def trigrams(c: Column | str) -> Column:
    padded = F.concat(F.lit("  "), col(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col(c)) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_numbers(c: Column | str) -> Column:
    """The trigrams as numbers, equal where they are: three code points of 21 bits each."""
    point = lambda t, i: F.ascii(F.substring(t, i, 1)).cast("long")
    return F.transform(trigrams(c), lambda t: (point(t, 1) * 2**21 + point(t, 2)) * 2**21 + point(t, 3))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of trigrams; equal is 1, empty is 0."""
    a, b = col(a), col(b)
    return gram_similarity(a, trigrams(a), b, trigrams(b))


def gram_similarity(a: Column, ta: Column, b: Column, tb: Column) -> Column:
    """name_similarity of names whose trigrams, or their numbers, are there: a name of many pairs is cut once."""
    both = F.size(F.array_intersect(ta, tb))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).otherwise(both / (F.size(ta) + F.size(tb) - both))


def is_generic_name(c: Column | str) -> Column:
    """Shorter than 3, digits only, a name for none, or but for stop words one or two words that are all generic."""
    n = fold_text(c)
    parts = F.filter(F.split(n, " "), lambda t: ~F.array_contains(words_in(STOP_WORDS), t))
    generic = F.size(parts).between(1, 2) & F.forall(parts, lambda t: F.array_contains(words_in(GENERIC_WORDS), t))
    return (F.length(n) < 3) | n.rlike(f"^(?:[0-9 ]+|{JUNK_NAMES})$") | generic


def slug(c: Column | str) -> Column:
    return F.replace(fold_text(c), F.lit(" "), F.lit("-"))


def clean_keyword(c: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(col(c), r"[^\p{L}\p{N} ]+", " ")), 1, 60)


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """struct(text, missing): {name} replaced; a null or empty value shows as [name?] and is listed; unknown names stay."""
    out, missing = col(template), []
    for name, value in values.items():
        filled = F.nullif(value.cast("string"), F.lit(""))
        missing.append(F.when(F.contains(col(template), F.lit("{" + name + "}")) & filled.isNull(), F.lit(name)))
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(filled, F.lit(f"[{name}?]")))
    return F.struct(out.alias("text"), F.array_compact(F.array(*missing)).alias("missing"))


def ordered_distinct(c: Column | str) -> Column:
    """A list without repeats in any case; the first spelling stays, in order."""
    start = F.array().cast("array<string>")
    return F.aggregate(col(c), start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def cache_key(parts: dict[str, Column], length: int = 32) -> Column:
    """A key that depends neither on the order of the names nor on letter case."""
    text = F.concat_ws("|", *[F.concat(F.lit(k + "="), F.coalesce(F.lower(v.cast("string")), F.lit(""))) for k, v in sorted(parts.items())])
    return F.substring(F.sha2(text, 256), 1, length)
