"""Order MinHash fingerprints, in DataFrame expressions only.

A text is a sequence of tokens: ideographs and letters of scripts without
spaces stand alone, other runs without white space are cut into pieces of up to
four characters. Its k-mers are runs of K tokens, with padding before the first
and nothing after the last, and the n-th occurrence of a k-mer counts as another
one than the first. Each k-mer has one hash, a point on a circle. BINS starting
points divide the circle; each selects the PICK k-mers that follow it (in a long
text the least of its own bin, in a short one those of the bins after it as
well), puts them back into the order they have in the text, and hashes them as a
tuple. Two texts are alike as far as their starting points' tuples agree: a
tuple agrees only if both the selected k-mers and their order do, which follows
edit distance where plain MinHash sees sets.

The hash and the place of a k-mer share one long (39 and 24 bits), so that
sorting longs does the selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from placekeep.session import checkpointed

K = 3
#: Selected k-mers of a tuple; the expressions are written for two.
PICK = 2
#: Code points of scripts without spaces, and tokens.
_ALONE = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u2E80-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
TOKEN = f"[{_ALONE}]|[^ \\t\\n\\x0B\\f\\r{_ALONE}]{{1,4}}"
#: log2 of the number of bins.
BIN_BITS = 6
PLACE_BITS = 24
#: log2 of the ids in a bucket of neighbours, at most (ids of distinct documents).
BUCKET_BITS = 8
#: Rows of two longs that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets whose order one task may find.
ORDERED = 4_096

_PLACE = (1 << PLACE_BITS) - 1
_BIN_SHIFT = 63 - BIN_BITS
_HASH_BITS = 32 - BIN_BITS


def _bin(x: str) -> str:
    return f"shiftright({x}, {_BIN_SHIFT})"


def _high(x: str) -> str:
    return f"shiftright({x}, {PLACE_BITS})"


def with_signature(df: DataFrame, text: str, name: str, when: str = "true") -> DataFrame:
    """Adds the array column ``name``: the number and tuple hash of each starting point, as one integer.

    Places from 16,777,215 on count as one place, so that k-mers beyond it keep
    the order of their hashes.
    """
    words, grams, marked = (f"_{name}_{x}" for x in ("words", "grams", "marked"))
    pad = ", ".join(["''"] * (K - 1))
    gram = ", ".join(f"get({words}, i + {j})" if j else f"get({words}, i)" for j in range(K))
    pattern = TOKEN.replace("\\", "\\\\")
    df = df.withColumn(words, F.expr(f"if({when}, concat(array({pad}), regexp_extract_all({text}, '{pattern}', 0)), null)"))
    df = df.withColumn(
        grams,
        F.expr(f"sort_array(transform(sequence(0, size({words}) - 1), i -> shiftleft(shiftrightunsigned(xxhash64({gram}), {64 - 63 + PLACE_BITS}), {PLACE_BITS}) | cast(least(i, {_PLACE}) as bigint)))"),
    )
    # Equal k-mers stand side by side: a later one gets a hash of its own from the k-mer and its occurrence number,
    # the distance to the first of the run, which is found by halving.
    run = f"aggregate(sequence(30, 0, -1), j, (a, b) -> if(a >= shiftleft(1, b) and {_high(f'get({grams}, a - shiftleft(1, b))')} = {_high('x')}, a - shiftleft(1, b), a))"
    same = f"j > 0 and {_high(f'get({grams}, j - 1)')} = {_high('x')}"
    df = df.withColumn(
        marked,
        F.expr(
            f"if(exists(transform({grams}, (x, j) -> {same}), y -> y),"
            f" sort_array(transform({grams}, (x, j) -> if({same}, shiftleft(shiftrightunsigned(xxhash64({_high('x')}, j - {run}), {64 - 63 + PLACE_BITS}), {PLACE_BITS}) | (x & {_PLACE}L), x))),"
            f" {grams})"
        ),
    )
    # The tuple of a k-mer and the one after it on the circle, in the order of their places.
    x, y = "get({m}, j)".format(m=marked), "get({m}, (j + 1) % size({m}))".format(m=marked)
    ordered = f"if(({x} & {_PLACE}L) <= ({y} & {_PLACE}L), xxhash64({_high(x)}, {_high(y)}), xxhash64({_high(y)}, {_high(x)})) & {(1 << _HASH_BITS) - 1}L"
    # The first k-mer of a bin serves its own starting point and those of the empty bins before it; after the last one the circle closes.
    before = f"if(j = 0, -1L, {_bin(f'get({marked}, j - 1)')})"
    heads = f"filter(sequence(0, size({marked}) - 1), j -> {before} <> {_bin(x)})"
    served = f"flatten(transform({heads}, j -> array_repeat({ordered}, cast({_bin(x)} - {before} as int))))"
    closing = f"transform(array(0), j -> {ordered})"
    df = df.withColumn(f"_{name}_served", F.expr(f"concat({served}, flatten(transform({closing}, t -> array_repeat(t, cast({(1 << BIN_BITS) - 1} - {_bin(f'get({marked}, size({marked}) - 1)')} as int)))))"))
    df = df.withColumn(name, F.expr(f"transform(_{name}_served, (t, b) -> shiftleft(cast(b as bigint), {_HASH_BITS}) | t)"))
    return df.drop(words, grams, marked, f"_{name}_served")


def likeness(a: str, b: str):
    """Share of the starting points whose tuples agree."""
    return F.expr(f"cast(size(array_intersect({a}, {b})) as double) / {1 << BIN_BITS}")


def as_text(name: str):
    return F.expr(f"array_join(transform({name}, x -> lower(lpad(hex(x), 8, '0'))), '')")


def next_keys(keys: DataFrame) -> DataFrame:
    """(key, next) for distinct longs ``key``; null after the last.

    Keys are ordered within groups of 256 neighbouring values, and the groups
    in the same way, so that no task orders more than a bounded number.
    """
    if keys.count() <= ORDERED:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    grouped = keys.withColumn("up", F.shiftright("key", BUCKET_BITS))
    heads = grouped.groupBy("up").agg(F.min("key").alias("head"))
    follows = next_keys(checkpointed(heads.select(F.col("up").alias("key"))))
    after = follows.join(heads, follows["next"] == heads["up"]).select(F.col("key").alias("up"), "head")
    inside = grouped.select("key", "up", F.lead("key").over(Window.partitionBy("up").orderBy("key")).alias("inner"))
    return inside.join(after, "up", "left").select("key", F.coalesce("inner", "head").alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document in order of id, then text; the last
    is followed by the first. Returns ``id_col``, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts count
    as empty. Rows with a null id are their own next document. Repeated rows
    follow one another. Other columns are ignored; an empty table gives no
    rows. Ids are whole numbers. A text is an array of its tokens, so it stays
    below Spark's 2 GB a row.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} isn't a whole number; the order of documents needs one")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = own.withColumn("bucket", F.shiftright(F.col("id").cast("long"), BUCKET_BITS))
    heads = checkpointed(own.where("id IS NOT NULL").groupBy("bucket").agg(F.min("id").alias("head")))
    order = next_keys(heads.select(F.col("bucket").alias("key")))
    first = heads.agg(F.min("bucket").alias("b")).first()["b"]
    # The first row of each bucket also goes to the end of the bucket before.
    sent = order.select(F.col("key").alias("to"), F.coalesce("next", F.lit(first)).alias("bucket")).join(heads, "bucket").select("to", F.col("head").alias("id"))
    sent = checkpointed(sent)
    sent = F.broadcast(sent) if sent.count() <= BROADCAST_ROWS else sent
    dealt = own.join(sent, "id", "left").select(
        "id",
        "t",
        F.explode(F.array_compact(F.array(F.struct(F.coalesce("bucket", F.xxhash64("t")).alias("bucket"), F.lit(0).alias("copy")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("copy")))))).alias("at"),
    )
    dealt = dealt.select("id", "t", F.col("id").isNull().alias("bare"), "at.bucket", "at.copy")
    place = Window.partitionBy("bare", "bucket").orderBy("copy", "id", "t")
    rows = dealt.withColumn("follows", F.lead("t").over(place)).withColumn("n", F.row_number().over(place))
    rows = rows.withColumn("n_chars", F.length("t").cast("long"))
    rows = rows.withColumn("edited", F.expr("if(copy = 0, concat(substring(t, 1, length(t) - length(t) div 2), substring(if(bare, t, follows), 1, cast(length(t) div 2 as int))), null)"))
    rows = with_signature(with_signature(rows, "t", "sig"), "edited", "edited_sig", "copy = 0")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("t", "follows", "edited")
    rows = rows.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("bare", "bucket").orderBy("n"))).where("copy = 0")
    rows = rows.withColumn("next_sig", F.when(F.col("bare"), F.col("sig")).otherwise(F.col("next_sig")))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
