"""Item names on web pages, compared with what is known of the places."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekeep.functions import similarity as S
from placekeep.functions import text as X
from placekeep.operators.blocking import alike_candidates, containment_candidates
from placekeep.operators.matching import one_to_one
from placekeep.operators.identity import source_rank
from placekeep.session import checkpointed

#: Names of a page, thresholds of likeness, pairing and review.
PAGE_NAMES, LIKE, PAIR, SHORT = 1_500, 0.88, 0.78, 0.9
READY_RATIO, READY_PRESSURE, READY_IGNORED = 0.90, 0.15, 0.05
ALIASES = {"kuzure okami": "kodure ookami samurai assassin"}
MANUAL = {"rapid fire": "rapid fire|bally"}
STOPWORDS = ("a", "an", "and", "of", "the")

#: Lines that aren't names.
FURNITURE = (
    r"(?i)(admission|birthday|calendar|contact|directions|email|facebook|food|footer|hours?|instagram|login|membership|menu|newsletter|party|phone|privacy|restaurant|"
    r"subscribe|ticket|tiktok|toggle navigation|twitter|video walk.?through|youtube|www\.|https?://)"
)


class ListFormat(NamedTuple):
    """A page whose names stand between a marker and a stop line."""

    host: str
    start: str
    stop: str = "(?!)"
    drop: str = "(?!)"
    prefix: str = ""


def page_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, position, line) of page summaries."""
    return pages.select(key, F.posexplode(F.split("page.text", "\n")).alias("position", "line"))


def cleaned(line: Column) -> Column:
    y = F.regexp_replace(line, r"^\s*[-*•]\s+", "")
    y = F.regexp_replace(y, r"^\s*\d+[.)]\s+", "")
    y = F.regexp_replace(y, r"(?i)\s+(?:\(?(?:working|down|needs repair|out of order|coming soon|sold)\)?)$", "")
    return F.regexp_replace(y, "^[ :\\-–—|\"]+|[ :\\-–—|\"]+$", "")


def is_name(y: Column) -> Column:
    """Whether a cleaned line may be an item's name."""
    like = lambda p: F.regexp_like(y, F.lit(p))
    rejected = [
        (F.length(y) < 3) | (F.length(y) > 80),
        like(r"(?i)\b\d{1,2}\s*(?:am|pm)\b"),
        like(r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
        like(r"\d") & like(r"(?i)\b(ave|avenue|blvd|boulevard|dr|drive|rd|road|st|street)\.?\b"),
        like(r"(?i)\b\d+\s+days\s+a\s+year\b"),
        F.lower(y).isin("games", "game list", "games list", "home"),
        like(r"(?i)^(about |current games|games list)"),
        like(FURNITURE),
        ~like("[A-Za-z]") & ~like(r"^\d{3,4}$"),
        F.size(F.split(F.trim(y), r"\s+")) > 9,
    ]
    return ~reduce(lambda a, b: a | b, rejected)


def _distinct_names(lines: DataFrame, key: str, limit: int) -> DataFrame:
    """First of each normal form, in page order, up to the limit."""
    df = lines.withColumn("name", cleaned(F.col("line"))).where(is_name(F.col("name"))).withColumn("form", X.roster_name(F.col("name"))).where(F.length("form") >= 3)
    first = df.groupBy(key, "form").agg(F.min(F.struct("position", "name")).alias("f")).select(key, "form", "f.position", "f.name")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("_n") <= limit).select(key, F.col("_n").alias("place"), "name", "form")


def generic_names(pages: DataFrame, key: str, limit: int = 200) -> DataFrame:
    return _distinct_names(page_lines(pages, key), key, limit)


def marked_names(pages: DataFrame, key: str, form: ListFormat, limit: int = PAGE_NAMES) -> DataFrame:
    """Names of pages of one host, between its marker lines."""
    lines = page_lines(pages.where(X.host(F.col("url")) == form.host), key)
    begin = lines.where(F.regexp_like("line", F.lit(form.start))).groupBy(key).agg(F.min("position").alias("_from"))
    rows = lines.join(begin, key).where("position > _from")
    end = rows.where(F.regexp_like("line", F.lit(form.stop))).groupBy(key).agg(F.min("position").alias("_to"))
    rows = rows.join(end, key, "left").where("_to IS NULL OR position < _to").where(~F.regexp_like("line", F.lit(form.drop)))
    return _distinct_names(rows.withColumn("line", F.regexp_replace("line", form.prefix, "") if form.prefix else F.col("line")), key, limit)


def block_names(pages: DataFrame, key: str, form: ListFormat, label: str = "Manufacturer:", limit: int = PAGE_NAMES) -> DataFrame:
    """Names on the lines before a detail label; lines of a plain list count until the first line that ``drop`` fits."""
    lines = page_lines(pages.where(X.host(F.col("url")) == form.host), key)
    begin = lines.where(F.regexp_like("line", F.lit(form.start))).groupBy(key).agg(F.min("position").alias("_from"))
    rows = lines.join(begin, key).where("position > _from")
    plain = rows.where(F.regexp_like("line", F.lit(form.drop))).groupBy(key).agg(F.min("position").alias("_to"))
    w = Window.partitionBy(key).orderBy("position")
    rows = rows.join(plain, key, "left").withColumn("_next", F.lead("line").over(w))
    before = F.coalesce(F.startswith("_next", F.lit(label)), F.lit(False))
    listed = (F.col("_to").isNull() | (F.col("position") < F.col("_to"))) & ~F.startswith("line", F.lit(label))
    return _distinct_names(rows.where((before | listed) & ~F.regexp_like("line", F.lit(form.stop))), key, limit)


def scored_links(pages: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Links that look like rosters, best first; social hosts are left out."""
    df = pages.select(key, F.posexplode("page.links").alias("position", "link")).select(key, "position", "link.*").where(F.regexp_like("url", F.lit("(?i)^https?://")) & ~F.coalesce(X.host(F.col("url")).isin(*X.IGNORED_HOSTS), F.lit(False)))
    once = df.groupBy(key, F.lower("text").alias("_t"), "url").agg(F.min(F.struct("position", "text")).alias("f")).select(key, "url", F.col("f.text").alias("text"), F.col("f.position").alias("position"))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    hits = once.withColumn("score", X.keyword_score(F.concat_ws(" ", "text", path))).where("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.lower("text"), "position")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, "rank", F.substring("text", 1, 120).alias("text"), "url", "score")


def probe_scores(pages: DataFrame, key: str) -> DataFrame:
    """Roster score of each homepage: its title and its best links."""
    links = scored_links(pages, key).groupBy(key).agg(F.sum("score").alias("_l"), F.count("*").alias("hints"))
    return pages.join(links, key, "left").select(key, "page.title", (X.keyword_score(F.col("page.title")) + F.coalesce("_l", F.lit(0))).alias("roster_score"), F.coalesce("hints", F.lit(0)).alias("hints"))


def likely_same(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of normal forms that name one item; only those that letters can't tell apart reach the ratio."""
    x, y = F.col(a), F.col(b)
    some = (x != "") & (y != "")
    cheap = (x == y) | ((F.length(x) >= 5) & X.holds_words(y, x)) | ((F.length(y) >= 5) & X.holds_words(x, y))
    # A ratio of .88 needs lengths within 2 * .88 / (2 - .88) of each other.
    near = (F.least(F.length(x), F.length(y)) * 2.0) / (F.length(x) + F.length(y)) >= LIKE
    return pairs.where(some & (cheap | (near & (F.coalesce(S.ratio_if(some & ~cheap & near, x, y), F.lit(0.0)) >= LIKE))))


def page_texts(listed: DataFrame, pages: DataFrame | None = None, key: str = "location_id") -> DataFrame:
    """(key, text): normal form of the titles of a place's pages and their names, in order.

    ``listed`` may have page and place, which order its names; ``pages`` has
    (key, title) and may have page.
    """
    order = [F.col(c) if c in listed.columns else F.lit(0) for c in ("page", "place")]
    rows = listed.select(key, F.struct(order[0].alias("page"), F.lit(1).alias("kind"), order[1].alias("place"), F.col("name").alias("line")).alias("r"))
    if pages is not None:
        page = F.col("page") if "page" in pages.columns else F.lit(0)
        rows = rows.unionByName(pages.select(key, F.struct(page.alias("page"), F.lit(0).alias("kind"), F.lit(0).alias("place"), F.coalesce("title", F.lit("")).alias("line")).alias("r")))
    # A place's pages hold a bounded number of names each.
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r")).select(key, X.roster_name(F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def compare_rosters(known: DataFrame, listed: DataFrame, key: str = "location_id", pages: DataFrame | None = None) -> DataFrame:
    """(key, bucket, name): matched and missing known names, and names on the web only.

    ``known`` has (key, name), ``listed`` has (key, name, form), ``pages`` the
    titles of the read pages. A known name is matched if it is likely one of
    the listed names or stands in the pages' text as whole words. Places
    without a read page aren't compared.
    """
    read = listed.select(key) if pages is None else listed.select(key).unionByName(pages.select(key))
    # Each of these is read several times; the tables behind them are far larger.
    k = checkpointed(known.join(read.distinct(), key, "left_semi").select(key, "name").distinct().withColumn("form", X.roster_name(F.col("name"))))
    # Names of one normal form are listed once, as the first of them.
    order = [F.col(c) for c in ("page", "place") if c in listed.columns]
    once = checkpointed(listed.where("form <> ''").groupBy(key, "form").agg(F.min_by("name", F.struct(*order, "name")).alias("name")))
    # Forms are compared once each, wherever they stand, and only those that can be alike.
    forms = lambda df: df.select("form", F.lit(0).alias("part"))
    alike = checkpointed(likely_same(alike_candidates(forms(k), forms(once), LIKE).select(F.col("a").alias("_a"), F.col("b").alias("_b")), "_a", "_b"))
    own = k.select(key, F.col("name").alias("_k"), F.col("form").alias("_a")).join(alike, "_a")
    pairs = checkpointed(own.join(once.select(key, F.col("name").alias("_w"), F.col("form").alias("_b")), [key, "_b"]).select(key, "_k", "_w"))
    written = k.where(F.length("form") >= 4).join(page_texts(listed, pages, key), key).where(X.holds_words(F.col("text"), F.col("form")))
    hit = checkpointed(pairs.select(key, F.col("_k").alias("name")).unionByName(written.select(key, "name")).distinct())
    seen = pairs.select(key, F.col("_w").alias("name")).distinct()
    k = k.select(key, "name")
    return (
        k.join(hit, [key, "name"], "left_semi").withColumn("bucket", F.lit("matched"))
        .unionByName(k.join(hit, [key, "name"], "left_anti").withColumn("bucket", F.lit("missing")))
        .unionByName(once.select(key, "name").join(seen, [key, "name"], "left_anti").withColumn("bucket", F.lit("website_only")))
    )


def manifest(compared: DataFrame, key: str = "location_id") -> DataFrame:
    """Counts of a comparison, and whether the page is likely the place's roster."""
    n = lambda b: F.count_if(F.col("bucket") == b)
    df = compared.groupBy(key).agg(n("matched").alias("matched"), n("missing").alias("missing"), n("website_only").alias("website_only")).withColumn("known", F.col("matched") + F.col("missing"))
    share = F.when(F.col("known") > 0, F.col("matched") / F.col("known")).otherwise(0.0)
    likely = (F.col("known") > 0) & ((F.col("matched") >= 20) | ((F.col("matched") >= 10) & (share >= 0.5)))
    return df.withColumn("match_ratio", F.round(share, 4)).withColumn("likely_manifest", likely)


def alias_score(web: Column, known: Column) -> Column:
    """Likeness of a listed and a known name, with short forms."""
    x, y = X.roster_name(web), X.roster_name(known)
    base = S.ratio_if((x != "") & (y != "") & (x != y), x, y)
    cx, cy = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    the = (y == F.concat(F.lit("the "), x)) | (y == F.concat(x, F.lit(" the"))) | (x == F.concat(F.lit("the "), y)) | (x == F.concat(y, F.lit(" the")))
    part = lambda a, b, ca, cb: (F.length(a) >= 4) & (X.holds_words(b, a) | F.startswith(cb, ca))
    manual = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])[x]
    return F.when((x == "") | (y == ""), 0.0).when(F.coalesce(manual == y, F.lit(False)), 0.95).when(x == y, 1.0).when(the | part(x, y, cx, cy) | part(y, x, cy, cx), F.greatest(base, F.lit(SHORT))).otherwise(base)


def pair_names(compared: DataFrame, key: str = "location_id") -> DataFrame:
    """One-to-one pairs of web-only and missing names at each place."""
    web = compared.where(F.col("bucket") == "website_only").where(~X.is_noise(F.col("name"))).select(key, F.col("name").alias("website_name"))
    missing = compared.where(F.col("bucket") == "missing").select(key, F.col("name").alias("db_name"))
    met = checkpointed(web.join(missing, key))
    # Names are compared once each, however many places have the pair.
    names = met.select("website_name", "db_name").distinct().withColumn("score", alias_score(F.col("website_name"), F.col("db_name"))).where(F.col("score") >= PAIR)
    scored = met.join(names, ["website_name", "db_name"])
    sided = scored.withColumn("_w", F.struct(key, "website_name")).withColumn("_d", F.struct(key, "db_name"))
    return one_to_one(sided, "_w", "_d", F.desc("score"), F.desc("website_name"), F.desc("db_name")).select(key, "website_name", "db_name", F.round("score", 4).alias("similarity"))


def reconciliation(compared: DataFrame, pairs: DataFrame, key: str = "location_id") -> DataFrame:
    """Additions, removals, pairs and noise of each place, and its review status."""
    noise = X.is_noise(F.col("name"))
    tagged = compared.join(pairs.select(key, F.col("website_name").alias("name"), F.lit("website_only").alias("bucket"), F.lit(True).alias("_paired")).unionByName(pairs.select(key, F.col("db_name").alias("name"), F.lit("missing").alias("bucket"), F.lit(True).alias("_paired"))), [key, "name", "bucket"], "left")
    free = F.col("_paired").isNull()
    web = F.col("bucket") == "website_only"
    df = tagged.withColumn("_noise", web & noise).groupBy(key).agg(
        F.count_if(F.col("bucket") == "matched").alias("matched"), F.count_if(F.col("bucket").isin("matched", "missing")).alias("known"), F.count_if(web).alias("website_only"), F.count_if("_noise").alias("ignored"),
        F.count_if(web & ~F.col("_noise") & free).alias("add_candidates"), F.count_if((F.col("bucket") == "missing") & free).alias("remove_candidates"), F.count_if(web & ~free).alias("canonical_candidates"),
    )
    ratio = F.round(F.when(F.col("known") > 0, F.col("matched") / F.col("known")).otherwise(0.0), 4)
    pressure = F.when(F.col("known") > 0, (F.col("add_candidates") + F.col("remove_candidates")) / F.col("known")).otherwise(0.0)
    ignored = F.when((F.col("known") > 0) & (F.col("website_only") > 0), F.col("ignored") / F.col("website_only")).otherwise(0.0)
    status = F.when(F.col("known") == 0, "needs_parser").when(ratio < READY_RATIO, "partial_or_stale").when((ignored > READY_IGNORED) | (pressure > READY_PRESSURE), "needs_parser").otherwise("review_ready")
    return df.select("*", ratio.alias("match_ratio"), F.round(pressure, 4).alias("change_pressure"), F.round(ignored, 4).alias("ignored_ratio"), status.alias("review_status"))


def _without_stopwords(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))))


def roster_key(x: Column) -> Column:
    return F.array_join(F.filter(F.split(X.roster_name(x), " "), lambda w: ~w.isin(*STOPWORDS)), " ")


def resolve_score(a: Column, b: Column) -> Column:
    """Ladder from 1 to .9 for a listed name ``a`` and an item's name ``b``; 0 below it."""
    sa, sb = X.strict_key(a), X.strict_key(b)
    ka, kb = roster_key(a), roster_key(b)
    ta, tb = _without_stopwords(ka), _without_stopwords(kb)
    wa, wb = _without_stopwords(sa), _without_stopwords(sb)
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    holds = lambda words, w: F.array_contains(words, F.lit(w))
    remake = holds(wa, "remake") & (holds(wb, "remake") | holds(wb, "cgc") | holds(wb, "chicago") | holds(wb, "gaming")) & holds(wb, "medieval") & holds(wb, "madness")
    subset = (F.size(ta) > 0) & (F.size(F.array_except(ta, tb)) == 0) & (F.size(tb) > F.size(ta))
    return (
        F.when(sa == sb, 1.0).when(remake, 1.0).when((ka == kb) & (wa != wb), 0.97).when(ka == kb, 0.99).when(compact(sa) == compact(sb), 0.98)
        .when((F.size(ta) > 0) & (ta == tb), 0.97).when(subset, 0.95).when(X.roster_name(a) == X.roster_name(b), 0.94)
        .when((F.length(sa) >= 4) & F.startswith(sb, sa), 0.92).when((F.length(sb) >= 4) & F.startswith(sa, sb), 0.92).when((ka != "") & F.contains(kb, ka), 0.9).otherwise(0.0)
    )


def resolve_names(names: DataFrame, items: DataFrame) -> DataFrame:
    """The item of each listed name (name), if one scores .9 or more.

    Pairs meet on words (or having none but stop words), first four letters and
    compact forms, on the marks of remakes, and where one key stands within the other; each rung of the score
    needs one of these.
    """
    def blocks(df: DataFrame, col: str, remade: bool) -> DataFrame:
        s = X.strict_key(F.col(col))
        compact = F.replace(s, F.lit(" "), F.lit(""))
        words = F.filter(F.split(s, " "), lambda w: ~w.isin(*STOPWORDS))
        mark = F.array_contains(F.split(s, " "), F.lit("remake")) if remade else F.array_contains(F.split(s, " "), F.lit("medieval"))
        parts = F.concat(words, F.array(F.concat(F.lit("^"), F.substring(s, 1, 4)), F.concat(F.lit("="), compact)), F.when(mark, F.array(F.lit("*remake"))).otherwise(F.array().cast("array<string>")), F.when(roster_key(F.col(col)) == "", F.array(F.lit("~"))).otherwise(F.array().cast("array<string>")))
        return df.withColumn("block", F.explode(F.array_distinct(parts)))

    listed = names.select(F.col("name").alias("listed_name")).distinct()
    known = items.select("game_id", "name", "manufacturer", "location_count")
    by_block = blocks(listed, "listed_name", True).join(blocks(known, "name", False), "block").drop("block")
    keyed = lambda df, c: df.withColumn("form", roster_key(F.col(c))).withColumn("part", F.lit(0))
    inside = containment_candidates(keyed(listed, "listed_name"), keyed(known, "name")).select("a", "b")
    by_key = keyed(listed, "listed_name").withColumnRenamed("form", "a").drop("part").join(inside, "a").join(keyed(known, "name").withColumnRenamed("form", "b").drop("part"), "b").drop("a", "b")
    pairs = by_block.unionByName(by_key).distinct()
    manual = F.create_map(*[F.lit(v) for kv in MANUAL.items() for v in kv])[X.strict_key(F.col("listed_name"))]
    is_manual = F.coalesce(manual == F.concat_ws("|", X.strict_key(F.col("name")), X.strict_key(F.col("manufacturer"))), F.lit(False))
    scored = pairs.withColumn("score", F.when(is_manual, 1.01).otherwise(resolve_score(F.col("listed_name"), F.col("name")))).where("score >= 0.9")
    w = Window.partitionBy("listed_name").orderBy(F.desc("score"), source_rank(F.col("game_id")), F.desc("location_count"), F.lower("name"), "game_id")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("listed_name", "game_id", "name", "score")
