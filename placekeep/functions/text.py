"""Normal forms of names, addresses and URLs, and tolerant parsing, as Column expressions.

The forms differ on purpose (Unicode or ASCII letters, which words are
dropped); scores are stated in terms of their own form.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placekeep.session import ship_package

#: Words of editions, and words that tell variants apart.
EDITION_WORDS = ("arcade", "game", "limited", "edition", "premium", "pro", "le", "se", "special", "remake", "pinball")
VARIANT_WORDS = ("2p", "4p", "6p", "ce", "dx", "dxplus", "le", "plus", "premium", "pro", "se")
#: Generic words of place names.
GENERIC_WORDS = ("the", "and", "at", "of", "arcade", "arcades", "bar", "bowling", "entertainment", "family", "fun", "center", "centre", "games", "game", "amusement", "sports", "mall", "location")
#: makers' names in normal form.
MAKERS = {
    "bally midway": "bally",
    "bally manufacturing": "bally",
    "chicago gaming company": "chicago gaming",
    "dave and busters": "dave and busters",
    "dave busters": "dave and busters",
    "stern pinball": "stern",
    "stern pinball inc": "stern",
    "williams electronic games": "williams",
    "williams electronics": "williams",
}
IMPORT_MAKERS = {
    "american pinball": "american",
    "stern pinball": "stern",
    "bally midway": "bally",
    "chicago gaming company": "chicago gaming",
    "jersey jack pinball": "jersey jack",
    "spooky pinball": "spooky",
}
#: The continental states and their abbreviations.
STATES = {
    "AL": "Alabama", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
    "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming",
}
#: Further spellings.
STATE_SPELLINGS = {"washington dc": "DC", "d.c.": "DC"}
#: Weights of link and page words.
ROSTER_WEIGHTS = {
    "arcade games": 3,
    "cabinet": 2,
    "collection": 3,
    "current": 1,
    "game list": 4,
    "game-list": 4,
    "games": 1,
    "lineup": 3,
    "machine list": 4,
    "machines": 3,
    "pinball": 1,
    "repair": 2,
    "roster": 4,
    "view games": 4,
}
#: Hosts whose links aren't rosters.
IGNORED_HOSTS = ("facebook.com", "g.page", "instagram.com", "tiktok.com", "twitch.tv", "x.com", "youtube.com")


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _replace(x: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(x, pattern, by)


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x], x)


def _without_the(x: Column) -> Column:
    return _replace(_replace(x, "^the ", ""), " the$", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def _dropping(x: Column, dropped: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(words(x), lambda w: ~w.isin(*dropped)), " ")


def normal(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits (of any script) to one space."""
    return F.trim(_replace(F.lower(_text(x)), r"[^\p{L}\p{N}]+", " "))


def title_text(x: Column) -> Column:
    y = F.replace(F.lower(_text(x)), F.lit("&"), F.lit(" and "))
    return F.trim(_replace(_replace(y, r"\bac\s*/?\s*dc\b", "acdc"), r"[^\p{L}\p{N}]+", " "))


def title_key(x: Column) -> Column:
    return F.replace(_without_the(title_text(x)), F.lit(" "), F.lit(""))


def loose_title(x: Column) -> Column:
    return _replace(_dropping(title_text(x), EDITION_WORDS), "^the( |$)", "")


def maker_key(x: Column) -> Column:
    return _mapped(title_text(x), MAKERS)


def digit_tokens(x: Column) -> Column:
    return F.regexp_extract_all(title_text(x), F.lit(r"(\d+)"), F.lit(1))


def variant_tokens(x: Column) -> Column:
    return F.array_sort(F.array_intersect(words(title_text(x)), F.array(*[F.lit(w) for w in VARIANT_WORDS])))


def clean(x: Column) -> Column:
    """Trimmed; null for nothing, a dash or ``nil``."""
    y = F.trim(x)
    return F.when(~y.isin("", "-", "nil"), y)


def match_form(x: Column) -> Column:
    y = F.replace(F.lower(_text(clean(x))), F.lit("&"), F.lit(" and "))
    for short, long in (("ste", "suite"), ("st", "street"), ("s", "south"), ("n", "north"), ("e", "east"), ("w", "west")):
        y = _replace(y, rf"\b{short}\b", long)
    return F.trim(_replace(y, r"[^a-z0-9]+", " "))


def _one_space(x: Column) -> Column:
    return F.trim(_replace(x, r"\s+", " "))


_EDITIONS = r"\b(pro|premium|le|limited edition|special|remake|se)\b"


def import_name(x: Column) -> Column:
    return _one_space(_replace(_replace(_without_the(match_form(x)), _EDITIONS, ""), r"\bpinball\b", ""))


def import_maker(x: Column) -> Column:
    return _mapped(match_form(x), IMPORT_MAKERS)


def merge_name(x: Column) -> Column:
    y = F.replace(F.lower(_replace(_text(x), "([a-z])([A-Z])", "$1 $2")), F.lit("&"), F.lit(" and "))
    y = _one_space(_replace(_replace(y, r"[^a-z0-9]+", " "), _EDITIONS, " "))
    return F.trim(_without_the(y))


def directory_words(x: Column, drop_generic: bool = False) -> Column:
    y = _one_space(_replace(F.replace(F.lower(_text(x)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9 ]+", " "))
    return _dropping(y, GENERIC_WORDS) if drop_generic else y


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


def unescape(x: Column) -> Column:
    """Character references resolved; only texts with an ampersand go to Python."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    some = F.contains(x, F.lit("&"))
    return F.when(some, _unescaped(F.when(some, x))).otherwise(x)


def roster_name(x: Column, escaped: bool = True) -> Column:
    """``escaped`` texts may hold character references."""
    y = F.lower(unescape(_text(x)) if escaped else _text(x))
    y = _replace(_replace(y, r"\([^)]*\)", " "), r"^(.+),\s*(the|a|an)$", "$2 $1")
    return F.trim(_replace(y, r"[^a-z0-9]+", " "))


def review_text(x: Column) -> Column:
    y = F.replace(F.lower(_text(x)), F.lit("&"), F.lit(" and "))
    return F.trim(_replace(_replace(y, r"\bac\s*/?\s*dc\b", "acdc"), r"[^a-z0-9]+", " "))


def review_key(x: Column) -> Column:
    return F.replace(_replace(_replace(review_text(x), "^the( |$)", ""), "(^| )the$", ""), F.lit(" "), F.lit(""))


def strict_key(x: Column) -> Column:
    return F.trim(_replace(F.lower(_text(x)), r"[^\p{L}\p{N}]+", " "))


def whole_number(x: Column) -> Column:
    """Integer, or null."""
    return clean(x).try_cast("bigint")


def number(x: Column) -> Column:
    return clean(x).try_cast("double")


def truth(x: Column) -> Column:
    y = F.lower(clean(x))
    return F.when(y == "true", True).when(y == "false", False)


def count_number(x: Column) -> Column:
    """Integer of a text with thousands separators and words around it."""
    return F.regexp_replace(_text(x), r"[^0-9-]", "").try_cast("bigint")


def yes_no(x: Column) -> Column:
    y = F.lower(F.trim(_text(x)))
    return F.when(y.isin("yes", "y", "true", "1"), 1).when(y.isin("no", "n", "false", "0"), 0).cast("long")


def split_list(x: Column) -> Column:
    """Comma list as trimmed parts; no part for a null list."""
    return F.when(clean(x).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(clean(x), ","), lambda p: F.trim(p)))


def state_code(x: Column) -> Column:
    """Abbreviation for an abbreviation or name in any case, or null."""
    table = {a.lower(): a for a in STATES} | {n.lower(): a for a, n in STATES.items()} | STATE_SPELLINGS
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.lower(F.trim(x))]


def address_parts(x: Column) -> Column:
    """Struct of street, city, state, postal_code and phone from the lines of an address block."""
    lines = F.filter(F.transform(F.split(_text(x), r"\r?\n"), lambda v: _one_space(v)), lambda v: v != "")
    pattern = r"^(.*?),\s*([A-Za-z]{2})\.?\s*(\d{5}(?:-\d{4})?)?$"
    place = F.get(F.filter(lines, lambda v: F.regexp_like(v, F.lit(pattern))), 0)
    phone = F.get(F.filter(lines, lambda v: F.regexp_like(v, F.lit(r"^\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$"))), 0)
    street = F.array_join(F.filter(lines, lambda v: ~F.regexp_like(v, F.lit(pattern)) & ~F.regexp_like(v, F.lit(r"^\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$"))), ", ")

    def part(i: int) -> Column:
        y = F.regexp_extract(place, pattern, i)
        return F.when(y != "", y)

    return F.struct(F.when(street != "", street).alias("street"), part(1).alias("city"), F.upper(part(2)).alias("state"), part(3).alias("postal_code"), phone.alias("phone"))


def with_scheme(url: Column) -> Column:
    y = F.trim(url)
    return F.when((y == "") | F.regexp_like(y, F.lit("(?i)^https?://")), y).otherwise(F.concat(F.lit("https://"), y))


def host(url: Column) -> Column:
    """Host in lower case, without ``www.``; null if there is none."""
    return _replace(F.lower(F.try_parse_url(with_scheme(url), F.lit("HOST"))), r"^www\.", "")


def public_website(url: Column, engine_hosts: tuple[str, ...] = ("google.com", "gstatic.com", "googleusercontent.com")) -> Column:
    """The URL if it is a site of its own; redirects of the search engine are followed once, its own hosts give null."""

    def own(u: Column) -> Column:
        h = F.lower(F.try_parse_url(u, F.lit("HOST")))
        bad = h.startswith("maps.")
        for suffix in engine_hosts:
            bad = bad | h.endswith(suffix)
        return F.when(F.regexp_like(u, F.lit("(?i)^https?://[^/]")) & ~bad, u)

    redirect = (F.lower(F.try_parse_url(url, F.lit("HOST"))) == "www." + engine_hosts[0]) & (F.try_parse_url(url, F.lit("PATH")) == "/url")
    return F.when(redirect, own(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("q"))))).otherwise(own(url))


def id_in_url(url: Column, pattern: str = r"[?&/](?:id|by_location_id|location)[=/](\d+)") -> Column:
    y = F.regexp_extract(_text(url), pattern, 1)
    return F.when(y != "", y.cast("bigint"))


def hashed_id(key: Column) -> Column:
    """First 15 hexadecimal digits of the key's sha1, as an integer."""
    return F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long")


def keyword_score(x: Column) -> Column:
    y = F.lower(_text(x))
    score = F.lit(0)
    for word, weight in ROSTER_WEIGHTS.items():
        score = score + F.when(F.contains(y, F.lit(word)), weight).otherwise(0)
    return score


def holds_words(x: Column, inner: Column) -> Column:
    """Whether ``inner`` stands in ``x`` as whole words."""
    return F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def is_noise(name: Column) -> Column:
    """Names that are page furniture rather than items."""
    y = roster_name(name)
    whole = r"^(games?|pinball|arcade|video games?|classic games?|our games?|view games?|arcade games?|pinball games?|machines?|more|about|contact|submit|welcome)$"
    part = (
        r"\b(account|blog|bottom of page|buy|careers?|contact|documentation|events?|facebook|copyright|developed by|gift|hours?|instagram|leagues?|liability|location|menu|orders?|parties|party|photo|"
        r"powered by|price|private|rate|repair|rental|rent|sale|sell|service|shop|sign in|sign out|submit|thanks|theme|ticket|top of page|tournaments?|waiver|weblizar|welcome)\b"
    )
    return (F.length(y) < 3) | F.regexp_like(y, F.lit(whole)) | F.contains(_text(name), F.lit("@")) | F.regexp_like(y, F.lit(part))


def machine_kind(cabinet: Column) -> Column:
    return F.when(F.lower(_text(cabinet)) == "pinball", "pinball").otherwise("video")


def stringify(x: Column) -> Column:
    """Up to three decimals, without trailing zeros."""
    return _replace(_replace(F.format_string("%.3f", x.cast("double")), "0+$", ""), r"\.$", "")
