"""Benchmark decontamination by template windows and own words, with DataFrame functions only.

Both sides are canonicalised word by word: numbers become ``<n>``, units ``<u>``, capitalised words that don't begin a
sentence ``<p>`` (a name), everything else is lower-cased without outer punctuation. A second template has ``<p>`` for
capitalised words that begin a sentence, too. A unit or percent sign joined to a number is split off. A window is ``window`` words in a
row; its template is the sequence of canonical words. Templates of benchmark windows with at least ``literals`` words that
are no placeholder are hash-joined with those of documents, so a question with other numbers, names or units is still
found. Matches lie on diagonals (document position minus item position). For each document and item the slots of the
matched windows are then compared: one and the same original value must stand for one and the same new value all over a
diagonal, and kind for kind; diagonals that contradict themselves are dropped, unless the words are the same to the letter.

Windows are joined on their own lower-cased words too, whatever they hold, so that a verbatim copy is always found. An item
shorter than a window counts as one window of its own length; with fewer than ``shortest`` words it is joined on its own
words only, so an item of one word matches each document that has the word. A window of punctuation alone is none.

A document's words are looked at once: the hashes of all its windows are put together from those of pairs, fours and eights.
A template counts only for windows that hold a placeholder, as others are found by their own words. The hashes are joined with the distinct ones of the benchmark. That side is broadcast only if there
are at most ``BROADCAST_ROWS`` of them, else Spark picks a shuffled join; the same holds for the texts looked at again, those
with matched templates, each once. A passage that many documents hold yields one row for each place and is no hot group in
any aggregation, since those are by document and diagonal.

Edge cases: null and empty texts have no words and match nothing; an empty benchmark or an empty table gives an empty
result; items with the same text each match; rows that share an id are compared each by itself and counted together, identical
ones once; the same holds for items; null ids are ids like any other; other columns are ignored by :func:`matches` and kept by
:func:`drop_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col, fresh, materialize

WINDOW, LITERALS, SHORTEST, BROADCAST_ROWS = 8, 4, 5, 1_000_000
#: Units in the singular and plural and their signs.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "gram", "grams", "kilogram",
    "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "sec", "minute", "minutes", "min",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "km/h", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "%", "degree", "degrees",
)
INNER, ALL, EXACT = 1, 2, 3
MODES = (INNER, ALL, EXACT)
#: First signs of tagged words; any other first sign is that of a literal word.
NAME, FIRST, NUMBER, UNIT = 1, 3, 4, 5


def tagged(text: Column) -> Column:
    """The text's words in lower case without outer punctuation, joined by one space, each with a sign before it if it can
    be a placeholder: ``\x01`` a name, ``\x03`` a capitalised word that begins a sentence, ``\x04`` a number, ``\x05`` a unit.

    Works on the whole string, since regular expressions over strings run compiled, and lambdas over arrays don't. A word
    of punctuation alone becomes empty, so that words keep their places.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    units = "|".join(u.replace("/", r"\/") for u in sorted(UNITS, key=len, reverse=True))
    # each pattern begins with what is rare, so that most characters are passed by after one test
    # a unit joined to its number becomes a word
    t = F.regexp_replace(t, r"\p{N}(?=(?i:" + units + r")[^\p{L}\p{N}%])", "$0 ")
    # a capital after a word that doesn't end a sentence begins a name
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^.!?:;\x20\"”»)\]|]\x20\p{Lu})[\p{Ll}\p{M}'’-]+(?=[^\p{L}\p{N}])", "\x01$0")
    t = F.regexp_replace(t, r"\p{Lu}(?<=\x20[^\p{L}\p{N}%\x20\x01]{0,20}\p{Lu})[\p{Ll}\p{M}'’-]+(?=[^\p{L}\p{N}])", "\x03$0")
    t = F.lower(t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}%\x20\x01\x03]++(?=\x20)|(?<=\x20)[^\p{L}\p{N}%\x20\x01\x03]++", "")
    t = F.regexp_replace(t, r"\x20(?=\p{N}[\p{N}.,:/]*\x20)", " \x04")
    t = F.regexp_replace(t, r"\x04([^\x20]*\x20)(?=(?:" + units + r")\x20)", "\x04$1\x05")
    return F.substr(t, F.lit(2), F.length(t) - 2)


def tokens(text: Column) -> Column:
    """The text's tagged words."""
    return F.split(tagged(text), " ")


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, as a variable."""
    return F.element_at(F.transform(F.array(x), f), 1)


def rolled(a: Column, size: int) -> Column:
    """A hash of every ``size`` values in a row, put together from hashes of powers of two; null where fewer are left."""

    def after(x: Column, k: int) -> Column:
        return F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))

    def pair(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda v, w: F.when(w.isNotNull(), F.xxhash64(v, w)))

    def step(block: Column, length: int, have: Column | None, done: int) -> Column:
        if size & length:
            have, done = (block if have is None else pair(have, after(block, done))), done + length
        if 2 * length > size:
            return have
        return _bound(pair(block, after(block, length)), lambda b: step(b, 2 * length, have, done))

    return _bound(a, lambda x: step(x, 1, None, 0))


def windows(tokens: str, asked: list[tuple[int, int]]) -> Column:
    """Structs, one for each word: the hash of the window that begins there for each ``(mode, size)``; null beyond the end."""
    t = col(tokens)
    own = F.transform(t, lambda w: F.xxhash64(F.when((w >= "\x06") | (w == ""), w).otherwise(F.substring(w, 2, 1 << 30))))

    def canonical(h: Column, mode: int) -> Column:
        def one(w: Column, x: Column) -> Column:
            k = F.ascii(w)
            slot = F.when(k.isin(NAME, NUMBER, UNIT), k.cast("long"))
            return F.when(w >= "\x06", x).otherwise(F.coalesce(slot if mode == INNER else slot.when(k == FIRST, F.lit(NAME).cast("long")), x))

        return h if mode == EXACT else F.zip_with(t, h, one)

    return _bound(own, lambda h: F.arrays_zip(*[rolled(canonical(h, m), n).alias(_name(m, n)) for m, n in asked]))


def _name(mode: int, size: int) -> str:
    return f"h{mode}_{size}"


def hashed(mode: int, size: int) -> Column:
    """A window's hash with its mode and size; null if the window holds no placeholder that the mode before lacks."""
    h = F.col("z." + _name(mode, size))
    mine = F.xxhash64(h, F.lit(8 * size + mode))
    if mode == EXACT:
        return F.when(h.isNotNull(), mine)
    return F.when(h != F.col("z." + _name(EXACT if mode == INNER else INNER, size)), mine)


def _asked(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows that :func:`hashed` looks at for ``pairs``."""
    return sorted({(m, n) for _, n in pairs for m in MODES})


def slots(part: Column, mode: Column) -> Column:
    """``array<struct<o,k,w>>``: offsets, kinds and words of the placeholders among a window's tagged words."""
    all_ = F.transform(part, lambda t, i: F.struct(i.alias("o"), F.when(t < "\x06", F.ascii(t)).otherwise(0).alias("k"), F.substring(t, 2, 1 << 30).alias("w")))
    some = F.filter(all_, lambda s: ((mode != EXACT) & s["k"].isin(NAME, NUMBER, UNIT)) | ((mode == ALL) & (s["k"] == FIRST)))
    return F.transform(some, lambda s: F.struct(s["o"].alias("o"), F.when(s["k"] == FIRST, NAME).otherwise(s["k"]).alias("k"), s["w"].alias("w")))


def _items(bench: DataFrame, item_col: str, text_col: str, window: int, literals: int, shortest: int) -> DataFrame:
    """``item_id, tid, mode, q, h, size, old``: the benchmark's windows, as templates those with enough literal words, as own words all."""
    rows = bench.select(col(item_col).alias("item_id"), F.xxhash64(col(text_col)).alias("tid"), tokens(col(text_col)).alias("t"))
    rows = rows.withColumn("n", F.size("t"))
    rows = materialize(rows, "bench-words")
    out = None
    for size in sorted({window} | {r[0] for r in rows.select(F.least("n", F.lit(window))).distinct().collect()}):  # at most ``window``
        mine = rows.where(F.col("n") >= window if size == window else F.col("n") == size)
        mine = mine.select("item_id", "tid", "n", "t", F.posexplode(windows("t", _asked([(EXACT, size)]))).alias("q", "z")).where(F.col("q") <= F.col("n") - size)
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), hashed(m, size).alias("h")) for m in MODES])).alias("m")
        mine = mine.select("item_id", "tid", "n", "q", F.slice("t", F.col("q") + 1, F.lit(size)).alias("part"), each)
        mine = mine.select("item_id", "tid", "n", "q", "part", "m.mode", "m.h", F.lit(size).alias("size")).where("h is not null")
        out = mine if out is None else out.unionByName(mine)
    out = out.withColumn("old", slots(F.col("part"), F.col("mode")))
    literal = F.size(F.filter("part", lambda t: t != "")) - F.size("old")
    good = F.when(F.col("mode") == EXACT, literal > 0).otherwise((F.col("n") >= shortest) & (literal >= F.least(F.lit(literals), F.col("size") - 1)))
    return out.where(good).select("item_id", "tid", "mode", "q", "h", "size", "old")


def matches(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, literals: int = LITERALS, shortest: int = SHORTEST,
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_slots, n_changed`` for every document and item that share own words or consistent template windows."""
    items = materialize(_items(bench, item_col, item_text_col, window, literals, shortest), "bench-windows")
    keys = materialize(items.select("h", "mode", "size").distinct(), "bench-keys")
    small = keys.count() <= BROADCAST_ROWS
    asked = sorted(tuple(r) for r in keys.select("mode", "size").distinct().collect())  # at most window sizes in each mode
    asked = asked or [(EXACT, window)]
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("rid"), tokens(col(text_col)).alias("t"))
    rows = rows.select("doc_id", "rid", F.posexplode(windows("t", _asked(asked))).alias("p", "z"))
    rows = rows.select("doc_id", "rid", "p", F.explode(F.array(*[hashed(m, n) for m, n in asked])).alias("h")).where("h is not null")
    hits = materialize(rows.join(F.broadcast(keys) if small else keys, "h"), "bench-hits")
    return _consistent(_with_slots(hits, docs, id_col, text_col), items)


def _with_slots(hits: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``new``, the placeholders of each matched window; documents with matched templates are read again, each once."""
    asked = hits.where(F.col("mode") != EXACT).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("p", "h", "mode", "size")).alias("at"))
    asked = materialize(asked, "bench-touched")
    small = asked.count() <= BROADCAST_ROWS
    ids = asked.select(F.col("rid").alias("have")).distinct()
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("have"), col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, "have", "left_semi")
    both = rows.join(asked, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("have") == F.col("rid"))).select("doc_id", "rid", "at", tokens(F.col("text")).alias("t"))
    found = F.transform("at", lambda a: F.struct(a["p"].alias("p"), a["h"].alias("h"), slots(F.slice("t", a["p"] + 1, a["size"]), a["mode"]).alias("new")))
    templates = both.select("doc_id", "rid", F.explode(found).alias("f")).select("doc_id", "rid", "f.p", "f.h", "f.new")
    exact = hits.where(F.col("mode") == EXACT).select("doc_id", "rid", "p", "h", F.array().cast(templates.schema["new"].dataType).alias("new"))
    return templates.unionByName(exact)


def _consistent(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Compares slots along diagonals, each mode by itself; windows of the same own words need no comparison."""
    pairs = hits.join(items, "h")
    # equal templates have placeholders at equal offsets
    met = F.zip_with("new", "old", lambda a, b: F.named_struct(F.lit("at"), F.col("p") + a["o"], F.lit("kind"), a["k"], F.lit("old"), b["w"], F.lit("new"), a["w"]))
    judged = F.when(F.col("mode") == INNER, F.array(F.lit(INNER), F.lit(ALL))).otherwise(F.array("mode"))
    rows = pairs.select("doc_id", "rid", "item_id", "tid", (F.col("p") - F.col("q")).alias("diagonal"), F.struct("p", "size").alias("at"), met.alias("met"), F.explode(judged).alias("mode"))
    key = ["doc_id", "rid", "item_id", "tid", "diagonal"]
    per = rows.groupBy(*key, "mode").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("met"))).alias("slots"))
    # one old value, one new value: as many pairs as old values (kind for kind, since templates are equal)
    olds = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["old"]))))
    met = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["old"].alias("old"), s["new"].alias("new"))))
    changed = F.size(F.filter(met, lambda s: s["old"] != s["new"]))
    good = per.withColumn("changed", changed).where((F.col("mode") == EXACT) | (olds == F.size(met)) | (F.col("changed") == 0))
    # a window found in several modes is one
    one = good.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.max(F.size("slots")).alias("slots"), F.max("changed").alias("changed"))
    return one.groupBy("doc_id", "item_id").agg(F.sum("n").cast("long").alias("n_windows"), F.max("slots").cast("long").alias("n_slots"), F.max("changed").cast("long").alias("n_changed"))


def drop_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that share template windows with the benchmark."""
    f = fresh(docs, "leak")
    found = materialize(matches(docs, bench, id_col, text_col, **options).select(F.col("doc_id").alias(f)).distinct(), "leaks")
    return docs.join(found, col(id_col).eqNullSafe(col(f)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
