"""Benchmark decontamination by templates, in built-in expressions only.

Texts are brought to one form: numbers, the units after them and names (capitalised words after a word in small letters or
a comma; words that begin a sentence both as names and as words) become typed slots that keep their value aside; all else is lower-cased words. Windows of WINDOW tokens, slots
without their values, are hashed and joined with those of the benchmark items. Where a window matches, slots stand opposite
each other; over the matching windows of one place of an item in a document, the slots of one benchmark value should stand opposite
one value in the document, changed or not. So a question asked again with other numbers or names is found, while texts
that merely share a common form, with values all over, are not.

The place is the alignment, the document's position less the item's. Each is judged for itself, then each run of near ones
(words put in or left out shift the rest of an item), then all together; the item is found if any of these passes. So an
item that a document holds twice, with different values, is found.

Before a window of a document is hashed, a Bloom filter of SIEVE bits tells whether any benchmark window begins with its
first LEAD tokens; with very many windows it lets all through and never loses one. Benchmark windows are joined by broadcast only
while they are at most BROADCAST rows, which is counted first; else by a shuffle. The values of slots are compared for
matching windows only, and texts are read again only for documents with such windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.shared import maybe_in, stored

WINDOW = 8
#: Plain words that a window must hold, so that forms of slots alone match nothing.
PLAIN = 5
#: Matching windows in an item that make a leak (of 12 words in a row, say); items of fewer windows need all.
ENOUGH = 5
#: Share of slots that stand opposite the usual value for their benchmark value.
CONSISTENT = 0.8
BROADCAST = 200_000
#: Items of fewer tokens are no passages; they match a whole line only.
SHORTEST = 4
LEAD = 3
SIEVE = 1 << 21
UNITS = ("percent", "kilometers", "kilometres", "meters", "metres", "miles", "feet", "inches", "kg", "km", "cm", "mm", "grams", "pounds",
         "liters", "litres", "dollars", "euros", "cents", "years", "months", "weeks", "days", "hours", "minutes", "seconds", "degrees")


def tokens(text: Column) -> Column:
    """array<string>: words in small letters; slots as ``<n:value``, ``<u:value`` and ``<p:value``.

    A capitalised word elsewhere, at the start of a sentence mostly, may be a name or not and comes as ``<s:value``.
    """
    out = F.regexp_replace(text, r"[<>:]", " ")
    out = F.when(out.rlike("[0-9]"), F.regexp_replace(
        F.regexp_replace(out, r"[$€£]?(?<![\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)*)(?![\p{L}\p{N}])", " <n:$1 "),
        r"(<n:[0-9.,]+)\s*(?:(%)|(" + "|".join(UNITS) + r")\b)", "$1 <u:$2$3 ")).otherwise(out)
    out = F.regexp_replace(out, r"(?<=[\p{Ll},] )(\p{Lu}[\p{Ll}][\p{L}'’-]*)", "<p:$1")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}:'’-])(\p{Lu}[\p{Ll}][\p{L}'’-]*)", "<s:$1")
    return F.filter(F.split(F.lower(out), r"(?:[^\p{L}\p{N}<:.,%'’-]|(?<![0-9])[.,]|[.,](?![0-9])|['’-](?![\p{L}]))+"), lambda w: w != "")


def _all(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def bare(w: Column) -> Column:
    """A token without the mark of a name."""
    return F.when(w.startswith("<s:") | w.startswith("<p:"), F.substring(w, 4, 1_000_000_000)).otherwise(w)


def _slot(w: Column) -> Column:
    # the lowest bit of a hash tells slots from words
    return F.xxhash64(F.substring(w, 1, 2)).bitwiseOR(F.lit(1))


def _plain(w: Column) -> Column:
    return F.xxhash64(w).bitwiseAND(F.lit(-2))


def as_words(w: Column) -> Column:
    """Hash of a token, a capitalised word at the start of a sentence taken as a word."""
    return F.when(w.startswith("<s:"), _plain(bare(w))).when(w.startswith("<"), _slot(w)).otherwise(_plain(w))


def as_names(w: Column) -> Column:
    """Hash of a token, such a word taken as a name."""
    return F.when(w.startswith("<s:"), _slot(F.lit("<p"))).when(w.startswith("<"), _slot(w)).otherwise(_plain(w))


def as_either(w: Column) -> Column:
    """Hash of a token, all such words alike."""
    return F.when(w.startswith("<s:"), F.lit(0).cast("long")).when(w.startswith("<"), _slot(w)).otherwise(_plain(w))


def _bits(h: Column) -> tuple[Column, Column]:
    """Two places of a hash in the sieve."""
    return F.pmod(h, F.lit(SIEVE)), F.pmod(F.shiftright(h, 32), F.lit(SIEVE))


def sieve_of(windows_: DataFrame) -> Column:
    """A scalar array<bigint> of SIEVE bits, two set for each lead of ``windows_``.

    It is a subquery, one row of a fixed size, and no literal: Spark writes a plan's literals out in full at each of its
    steps, for every stage anew, and all those texts are the driver's.
    """
    place = windows_.select(F.explode("leads").alias("lead")).select(F.explode(F.array(*_bits(F.col("lead")))).alias("place"))
    bits = place.select(F.shiftright("place", 6).alias("id"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    bits = windows_.sparkSession.range(SIEVE // 64).join(bits.groupBy("id").agg(F.bit_or("bit").alias("bits")), "id", "left")
    longs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return bits.agg(longs.alias("longs")).select("longs.bits").scalar()


def _lead(v: Column, i: Column | int) -> Column:
    return F.xxhash64(*[v[i + j] for j in range(LEAD)])


def windows(rows: DataFrame, keys: list[str], text: str, size: int, short: list[int], whole: bool = False, long: bool = True) -> DataFrame:
    """(keys, length, at, h, exact, leads) of the windows of each text, length its number of tokens.

    A window of ``size`` tokens with enough plain words is hashed by words and types of slots, once with words at the start
    of sentences as words and once with them as names. The other windows of ``size`` tokens, and those of as many tokens as
    ``short`` has, are exact: hashed with their values. With ``whole`` only texts of such a number have short windows, and
    without ``long`` there are only short ones. leads: hashes of the first LEAD tokens, with any of them at the start of a
    sentence or not; exact windows have one, of their values.
    """
    words = rows.select(*keys, tokens(F.col(text)).alias("_w"))
    hashed = words.select(
        *keys, F.size("_w").alias("length"), F.transform("_w", as_words).alias("_x"), F.transform("_w", as_names).alias("_y"),
        F.transform("_w", lambda w: F.xxhash64(bare(w))).alias("_e"))
    x, y, e = F.col("_x"), F.col("_y"), F.col("_e")
    enough = lambda v, i: _all([v[i + j].bitwiseAND(F.lit(1)) for j in range(size)]) <= size - PLAIN
    masked = lambda v, i: F.array(*[F.xxhash64(*[F.lit(0).cast("long") if m >> j & 1 else v[i + j] for j in range(LEAD)]) for m in range(1 << LEAD)])
    one = lambda i, h, exact, leads: F.struct(i.alias("at"), h.alias("h"), F.lit(exact).alias("exact"), leads.alias("leads"))
    form = lambda v, i: one(i, F.xxhash64(*[v[i + j] for j in range(size)]), False, masked(v, i))
    exactly = lambda i, n: one(i, F.xxhash64(F.lit(n), *[e[i + j] for j in range(n)]), True, F.array(_lead(e, i)))
    starts = lambda n: F.when(F.col("length") >= n, F.sequence(F.lit(0), F.col("length") - n)).otherwise(F.array().cast("array<int>"))
    at_start = lambda i: F.when(enough(y, i), F.array_distinct(F.array(form(x, i), form(y, i)))).otherwise(F.array(form(x, i)))
    full = [F.flatten(F.transform(starts(size), lambda i: F.when(enough(x, i), at_start(i)).otherwise(F.array(exactly(i, size)))))] if long else []
    of = lambda n: F.when(F.col("length") == n, starts(n)).otherwise(F.array().cast("array<int>")) if whole else starts(n)
    some = [(lambda n: F.transform(of(n), lambda i: exactly(i, n)))(n) for n in short]
    return hashed.select(*keys, "length", F.explode(F.concat(*full, *some)).alias("_o")).select(*keys, "length", "_o.*")


def sieved_windows(rows: DataFrame, keys: list[str], text: str, size: int, sieve: Column, exact: bool) -> DataFrame:
    """(keys, at, h) of the windows of ``size`` tokens whose lead ``sieve`` holds, exact ones only with ``exact``.

    Each place costs one hash of LEAD tokens; only where the sieve holds it, the window's own tokens are hashed.
    """
    words = rows.select(*keys, tokens(F.col(text)).alias("_w"))
    values = F.transform("_w", lambda w: F.xxhash64(bare(w))) if exact else F.lit(None).cast("array<bigint>")
    # a column, as lambdas must not hold a subquery
    words = words.select(*keys, "_w", F.transform("_w", as_either).alias("_c"), values.alias("_v"), sieve.alias("_sieve"))
    bit = lambda p: F.getbit(F.get("_sieve", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

    def held(v: Column, i: Column) -> Column:
        first, second = _bits(_lead(v, i))
        return bit(first) & bit(second)

    n = F.size("_w")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    at = F.filter(starts, lambda i: held(F.col("_c"), i) | held(F.col("_v"), i) if exact else held(F.col("_c"), i))
    some = words.select(*keys, "_w", F.explode(at).alias("at")).select(*keys, "at", F.slice("_w", F.col("at") + 1, size).alias("_s"))
    some = some.select(*keys, "at", F.transform("_s", as_words).alias("_x"), F.transform("_s", as_names).alias("_y"), F.transform("_s", lambda w: F.xxhash64(bare(w))).alias("_e"))
    of = lambda v: [F.col(v)[j] for j in range(size)]
    enough = lambda v: _all([h.bitwiseAND(F.lit(1)) for h in of(v)]) <= size - PLAIN
    form = lambda v: F.xxhash64(*of(v))
    exactly = F.array(F.xxhash64(F.lit(size), *of("_e")))
    found = F.when(enough("_x"), F.when(enough("_y"), F.array_distinct(F.array(form("_x"), form("_y")))).otherwise(F.array(form("_x")))).otherwise(exactly)
    return some.select(*keys, "at", F.explode(found).alias("h"))


def _found(docs: DataFrame, items: DataFrame, text: str, key: str, item_key: str = "item_id", item_text: str = "text",
           size: int = WINDOW, null_keys: bool = False) -> DataFrame:
    """(_name, key, item, n_matched, n_windows, consistency); see ``leaks``. _name is ``_name_of`` the row."""
    spark = docs.sparkSession
    bench = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_body")).where("_item is not null and _body is not null")
    lengths = bench.select(F.size(tokens(F.col("_body"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < size)).distinct()
    lengths = sorted(r["n"] for r in lengths.collect())  # fewer than ``size``
    short = [n for n in lengths if n >= SHORTEST]
    of_items = windows(bench, ["_item"], "_body", size, short, whole=True)
    # exact windows serve the items that have no other
    of_items = of_items.withColumn("_none", F.min("exact").over(Window.partitionBy("_item"))).where("not exact or _none").drop("_none")
    of_items = stored(of_items, "decontamination-items")  # their long expressions are planned once, not for each use
    lists = of_items.groupBy("h").agg(F.collect_set(F.struct("_item", F.col("at").alias("_item_at"))).alias("_places"))
    n = lists.limit(BROADCAST + 1).count()
    lists = F.broadcast(lists) if n <= BROADCAST else lists
    rows = docs.select(_name_of(text, key).alias("_key"), F.col(key).alias("_given"), F.col(text).alias("_text")).where("_text is not null")
    rows = rows if null_keys else rows.where("_given is not null")
    rows = rows.withColumn("_twin", F.xxhash64("_text"))
    exact = not of_items.where("exact").isEmpty()
    places = sieved_windows(rows, ["_key", "_twin"], "_text", size, sieve_of(of_items), exact)
    if short:
        places = places.unionByName(windows(rows, ["_key", "_twin"], "_text", size, short, long=False).select("_key", "_twin", "at", "h"))
    hits = places.join(lists, "h")
    hits = hits.select("_key", "_twin", "at", F.explode("_places").alias("_p")).select("_key", "_twin", "at", "_p._item", "_p._item_at")
    sizes = of_items.groupBy("_item").agg(F.countDistinct("at").alias("_windows"), F.max("length").alias("_length"), F.max("exact").alias("_exact"))
    pair = ["_key", "_twin", "_item"]
    placed = hits.withColumn("_d", F.col("at") - F.col("_item_at")).groupBy(*pair, "_d").agg(F.collect_set("_item_at").alias("_ats")).join(sizes, "_item")
    by_place = Window.partitionBy(*pair).orderBy("_d")
    apart = F.col("_d") - F.lag("_d").over(by_place) > F.greatest(F.lit(size - 1), F.floor(F.col("_length") / 2))
    placed = placed.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_run", F.sum("_apart").over(by_place))
    over = lambda *by: F.struct(F.min("_d").over(Window.partitionBy(*by)).alias("lo"), F.max("_d").over(Window.partitionBy(*by)).alias("hi"))
    placed = placed.withColumn("_of_run", over(*pair, "_run")).withColumn("_of_all", over(*pair))
    # alignments, runs of them and all; what is the same comes once
    spans = F.array_distinct(F.array(F.struct(F.col("_d").alias("lo"), F.col("_d").alias("hi")), "_of_run", "_of_all"))
    placed = placed.withColumn("_span", F.explode(spans)).withColumn("_pairs", F.transform("_ats", lambda a: F.struct(
        (F.col("_d") + a).alias("at"), a.alias("_item_at"))))
    found = placed.groupBy(*pair, "_span", "_windows", "_length", "_exact").agg(F.flatten(F.collect_list("_pairs")).alias("_pairs"))
    found = found.withColumn("_matched", F.size(F.array_distinct(F.transform("_pairs", lambda p: p["_item_at"]))).cast("long"))
    needed = F.when(F.col("_exact"), F.col("_windows")).otherwise(F.least(F.lit(ENOUGH), F.col("_windows")))
    found = found.where((F.col("_matched") >= needed) & (~F.col("_exact") | (F.col("_span.lo") == F.col("_span.hi"))))
    found = stored(found, "decontamination-found")

    words_of = lambda rows, keys, body, name: rows.select(*keys, tokens(F.col(body)).alias(name))
    some = found.select("_key", "_twin").distinct()
    few = maybe_in(rows, "_key", some, "_key").join(some, ["_key", "_twin"], "left_semi")
    of_docs = words_of(few, ["_key", "_given", "_twin"], "_text", "_doc_words")
    paired = found.join(of_docs, ["_key", "_twin"]).join(words_of(bench, ["_item"], "_body", "_item_words"), "_item")
    opposite = F.flatten(F.transform("_pairs", lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(size), F.col("_length")) - 1), lambda j: F.struct(
        F.get(F.col("_item_words"), p["_item_at"] + j).alias("mine"), F.get(F.col("_doc_words"), p["at"] + j).alias("its")))))
    # a name is the same at the start of a sentence; words there that are no names stand opposite themselves
    value = lambda w: F.regexp_replace(w, "^<s:", "<p:")
    is_slot = lambda s: s["mine"].startswith("<") & ~(s["mine"].startswith("<s:") & (value(s["mine"]) == F.concat(
        F.when(s["its"].startswith("<"), F.lit("")).otherwise(F.lit("<p:")), value(s["its"]))))
    slots = F.array_distinct(F.transform(F.filter(opposite, is_slot), lambda s: F.struct(value(s["mine"]).alias("mine"), value(s["its"]).alias("its"))))
    values = F.array_distinct(F.transform(slots, lambda s: s["mine"]))
    judged = paired.withColumn("_slots", slots).withColumn("_values", values)
    # what is exact has been compared with its values
    consistency = F.when(F.col("_exact") | (F.size("_slots") == 0), F.lit(1.0)).otherwise(F.size("_values") / F.size("_slots"))
    judged = judged.select("_key", "_given", "_item", "_matched", "_windows", consistency.alias("_share")).where(F.col("_share") >= CONSISTENT)
    if lengths and lengths[0] < SHORTEST:
        whole = lambda body: F.array_join(F.transform(tokens(body), bare), " ")
        tiny = bench.where(F.size(tokens(F.col("_body"))).between(1, SHORTEST - 1)).select("_item", whole(F.col("_body")).alias("_line"))
        lines = rows.select("_key", "_given", F.explode(F.array_distinct(F.split("_text", r"[\n\r]+"))).alias("_line"))
        lines = lines.select("_key", "_given", whole(F.col("_line")).alias("_line")).join(tiny, "_line")
        one = F.lit(1).cast("long")
        judged = judged.unionByName(lines.select("_key", "_given", "_item", one.alias("_matched"), one.alias("_windows"), F.lit(1.0).alias("_share")))
    worst = judged.groupBy("_key", "_given").agg(F.max(F.struct("_matched", (-F.col("_item")).alias("_low"), "_windows", "_share")).alias("_m"))
    return worst.select(F.col("_key").alias("_name"), F.col("_given").alias(key), (-F.col("_m._low")).alias("item"), F.col("_m._matched").alias("n_matched"),
                        F.col("_m._windows").alias("n_windows"), F.col("_m._share").alias("consistency"))


def _name_of(text: str, key: str) -> Column:
    """A key that is never null: rows without one are named by their texts."""
    return F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(
        F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **kwargs) -> DataFrame:
    """(key, item, n_matched, n_windows, consistency) of the documents that hold a benchmark item, its worst item each.

    Null or empty texts match nothing. Items of fewer than ``size`` tokens, and items whose windows all hold too many slots,
    match where they stand whole and with their own values; items of fewer than SHORTEST tokens, which stand in any text,
    where they are a whole line. Documents of
    one key are one document. Ties go to the smallest item id. Rows with a null key are looked at with ``null_keys`` only;
    each text is then a document.
    """
    return _found(docs, items, text, key, **kwargs).drop("_name")


def marked(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **kwargs) -> DataFrame:
    """``docs`` with contaminated, item, n_matched, n_windows and consistency; columns of these names are replaced."""
    new = ["item", "n_matched", "n_windows", "consistency"]
    found = _found(docs, items, text, key, **kwargs).select(F.col("_name").alias("_leak"), *new)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in [*new, "contaminated"]])
    return kept.join(found, _name_of(text, key) == F.col("_leak"), "left").withColumn("contaminated", F.col("_leak").isNotNull()).drop("_leak")


def without(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **kwargs) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = _found(docs, items, text, key, **kwargs).select(F.col("_name").alias("_leak"))
    return docs.join(found, _name_of(text, key) == F.col("_leak"), "left_anti")
