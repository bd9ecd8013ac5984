"""Links to maps and messages, personalisation, relative times, robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import phone_key
from .text import present, round_half_up

SEARCH = "https://www.google.com/maps/search/?api=1&query="
MESSAGE = "https://wa.me/55"


def encode_component(c: Column) -> Column:
    """Percent encoding of a part of an address: a space as %20, and ! ' ( ) * ~ as they are."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def map_links(name: Column, street: Column, number: Column, neighborhood: Column, city: Column, state: Column, lat: Column, lon: Column) -> Column:
    """struct(strategy, query, search_url, pin_url): the most telling of six ways to name a place; (0, 0) is no place."""
    joined = lambda sep, *cs: F.nullif(F.concat_ws(sep, *[present(c) for c in cs]), F.lit(""))
    x = F.struct(present(name).alias("name"), joined(" ", street, number).alias("street"), present(neighborhood).alias("hood"), joined(" - ", city, state).alias("city"), F.when((lat.between(-90, 90)) & (lon.between(-180, 180)) & ~((lat == 0) & (lon == 0)), F.concat_ws(",", lat, lon)).alias("at"))

    def chosen(p: Column) -> Column:
        has = {k: p[k].isNotNull() for k in ("name", "street", "city", "at")}
        ways = [("name_address", has["name"] & has["street"], ("name", "street", "hood", "city")), ("name_city", has["name"] & has["city"], ("name", "city")), ("name_only", has["name"], ("name",)), ("address_only", has["street"], ("street", "city")), ("coordinates", has["at"], ("at",))]
        strategy, query = F.lit("city_only"), F.coalesce(p["city"], F.lit(""))
        for way, when, parts in reversed(ways):
            strategy, query = F.when(when, way).otherwise(strategy), F.when(when, F.concat_ws(", ", *[p[k] for k in parts])).otherwise(query)
        return F.struct(strategy.alias("strategy"), query.alias("query"), p["at"].alias("at"))

    linked = lambda r: F.struct(r["strategy"], r["query"], F.concat(F.lit(SEARCH), encode_component(r["query"])).alias("search_url"), F.concat(F.lit(SEARCH), encode_component(r["at"])).alias("pin_url"))
    return F.transform(F.transform(F.array(x), chosen), linked)[0]


def message_link(phone: Column, text: Column) -> Column:
    return F.concat(F.lit(MESSAGE), phone_key(phone), F.when(present(text).isNotNull(), F.concat(F.lit("?text="), encode_component(text))).otherwise(""))


def personalisation_level(first_name: Column, company: Column, industry: Column, observation: Column, idea: Column) -> Column:
    """0 to 4: each level needs all that the lower ones need."""
    has = [present(c).isNotNull() for c in (industry, observation, idea)]
    base = present(first_name).isNotNull() & present(company).isNotNull()
    return F.when(~base, 0).when(~has[0], 1).when(~has[1], 2).when(~has[2], 3).otherwise(4)


def relative_time(at: Column, as_of: Column) -> Column:
    """How long ago (or ahead), in the largest unit that fits, each unit rounded from the one below."""
    minutes = round_half_up((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000.0)
    units = [("minuto", "minutos", 60, 60.0), ("hora", "horas", 24, 24.0), ("dia", "dias", 30, 30.0), ("mês", "meses", 12, 12.0), ("ano", "anos", None, None)]

    def said(n: Column, one: str, more: str) -> Column:
        size = F.abs(n).cast("long")
        label = F.when(size == 1, one).otherwise(more)
        return F.concat(F.when(n >= 0, "há ").otherwise("em "), size.cast("string"), F.lit(" "), label)

    out, value, when = F.when(F.abs(minutes) < 1, "agora"), minutes, []
    for one, more, limit, step in units:
        when.append((F.abs(value) < limit if limit else F.lit(True), said(value, one, more)))
        value = round_half_up(value / step) if step else value
    for test, text in when:
        out = out.when(test, text)
    return out


def seconds_text(total: Column) -> Column:
    s = F.greatest(F.lit(0), round_half_up(total)).cast("long")
    rest = F.when(s % 60 > 0, F.concat(F.lit(" "), (s % 60).cast("string"), F.lit("s"))).otherwise("")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("min"), rest))


def path_allowed(robots: Column, path: Column, agent: str = "*") -> Column:
    """Whether no Disallow rule of the agent's groups begins the path; no robots file allows all.

    Groups of * count until one for the agent itself is found.
    """
    start = F.struct(F.lit(False).alias("here"), F.lit(False).alias("own"), F.array().cast("array<string>").alias("rules"))

    def step(s: Column, line: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.substring(line, F.length(F.substring_index(line, ":", 1)) + F.lit(2), F.length(line)))
        named = key == "user-agent"
        own = named & (F.lower(value) == agent.lower())
        here = F.when(named, own | ((value == "*") & ~s["own"])).otherwise(s["here"])
        rules = F.when((key == "disallow") & s["here"] & (value != ""), F.concat(s["rules"], F.array(value))).otherwise(s["rules"])
        return F.struct(here.alias("here"), (s["own"] | own).alias("own"), rules.alias("rules"))

    lines = F.filter(F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return ~F.exists(F.aggregate(lines, start, step)["rules"], lambda r: F.startswith(path, r))
