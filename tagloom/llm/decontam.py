"""Benchmark decontamination by canonical templates.

Texts become tokens; a number, a unit after a number and a capitalised word inside a
sentence become typed placeholders that keep their value, other words go to lower case.  Windows of `width`
canonical tokens are hashed and hash-joined with the benchmark's.  A document that
holds at least `share` of an item's distinct windows is a candidate.  A candidate's
placeholders must then bind consistently: each value of the item (say, 12 in two
places) must stand for one value of the document in all windows where it occurs, for
at least `share` of the item's values.  That keeps questions asked again with other
numbers or names and drops texts that merely share a pattern.

A capitalised word that begins a sentence may be a name or not.  Windows that hold one
are hashed in both readings, as the plain word and as a name, on both sides, and a
window of the item counts as held if either is.  A document leaks if the plain readings
alone suffice, or both together.

Windows with fewer than three plain words carry too little to match and are left out
on both sides.  An item shorter than a window is one window of its own length; one
without any window of three plain words, such as a single word or a row of numbers,
would match by chance and is not looked for: unmatchable() reports those items.

Benchmark windows are broadcast only while they number at most `broadcast_rows`;
beyond that the same join shuffles.

Cases: null and empty texts and items match nothing; an item without an eligible
window is never reported; repeated rows report alike, once per distinct (doc_id,
text); equal items each report; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, of_user, row_key, text_of, with_user

#: Fixed values.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "usd", "eur", "dollars", "euros", "percent", "inches", "inch", "feet", "ft", "miles", "mile", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "years", "year", "meters", "metres", "grams", "liters", "litres", "degrees"]
#: What marks a placeholder; texts' own are blanked.
MARK = "\x01"
#: What marks a capitalised word that begins a sentence, while tokens are cut.
MAYBE = "\x02"
#: What stands for a point and a comma between digits, while tokens are cut.
POINT, COMMA = "\x03", "\x04"
NUMBER, UNIT, NAME = MARK + "n", MARK + "u", MARK + "p"
# No expression repeats a group: the engine would need a stack as deep as the text is long.
_WORD = r"\p{L}\p{N}_"
_CAPITAL = rf"(\p{{Lu}}(?<![{_WORD}]\p{{Lu}})[\p{{Ll}}\p{{N}}_]*\p{{Ll}}[\p{{Ll}}\p{{N}}_]*)(?![{_WORD}])"
#: A capitalised word after another word with no end of a sentence between.
_INSIDE = rf"{MAYBE}(?<=[{_WORD}][^{_WORD}.!?\n]{{1,8}}{MAYBE})"
#: Digits that belong to no word; a unit after a number; what stands between tokens.
_NUMBER = rf"([0-9](?<![{_WORD}{POINT}{COMMA}][0-9])[0-9{POINT}{COMMA}]*)"
_UNIT = rf"({NUMBER}[0-9{POINT}{COMMA}]+ {{1,2}})((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![{_WORD}])"
_BETWEEN = rf"[^{_WORD}{MARK}{MAYBE}{POINT}{COMMA}]+"


def _numbered(text: Column) -> Column:
    for sign, mark in ((".", POINT), (",", COMMA)):
        between = rf"[{sign}](?<=[0-9].)(?=[0-9])"
        text = F.regexp_replace(text, between, mark)
    text = F.regexp_replace(text, _NUMBER, f" {NUMBER}$1 ")
    text = F.regexp_replace(text, _UNIT, f"$1{UNIT}$2 ")
    return F.regexp_replace(text, rf"({NUMBER}[0-9{POINT}{COMMA}]+ {{1,2}})%", f"$1{UNIT}percent ")


def _sign(token: Column) -> Column:
    return F.when(token.startswith(MARK), F.substring(token, 1, 2)).otherwise(token)


def canonical(docs: DataFrame) -> DataFrame:
    """Adds __t, the tokens (a placeholder is a mark, its type, and the value it stands
    for), and __q, which of them may be names (null if none).  Each step is a column,
    so that texts pay only for what they hold."""
    out = docs.withColumn("__a", text_of())
    out = out.withColumn("__a", F.when(F.col("__a").rlike(f"[{MARK}-{COMMA}]"), F.translate("__a", MARK + MAYBE + POINT + COMMA, "    ")).otherwise(F.col("__a")))
    out = out.withColumn("__a", F.regexp_replace(F.regexp_replace("__a", _CAPITAL, f"{MAYBE}$1"), _INSIDE, NAME))
    out = out.withColumn("__digits", F.col("__a").rlike("[0-9]"))
    out = out.withColumn("__a", F.when(F.col("__digits"), _numbered(F.col("__a"))).otherwise(F.col("__a")))
    out = out.withColumn("__raw", F.array_remove(F.split(F.lower("__a"), _BETWEEN), ""))
    out = out.withColumn("__raw", F.when(F.col("__digits"), F.transform("__raw", lambda t: F.translate(t, POINT + COMMA, ".,"))).otherwise(F.col("__raw")))
    maybe = F.col("__a").contains(MAYBE)
    return out.withColumns({
        "__t": F.when(maybe, F.transform("__raw", lambda t: F.ltrim(t, F.lit(MAYBE)))).otherwise(F.col("__raw")),
        "__q": F.when(maybe, F.transform("__raw", lambda t: F.when(t.startswith(MAYBE), 1).otherwise(0))),
        "__some": F.col("__a").contains(MARK),
    }).drop("__raw", "__a", "__digits")


def signs() -> Column:
    """The canonical tokens."""
    return F.transform("__t", _sign)


def _runs(df: DataFrame, name: str, widths: list[int], both) -> DataFrame:
    """Adds {name}_{width}: both() folded over every `width` neighbours of the array
    `name`, by doubling; each step is a column, so that none is computed twice."""
    later = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    step, size, done = name, 1, {w: None for w in widths}  # done: so far, and how long
    while size <= max(widths):
        for w in widths:
            if w & size:
                df = df.withColumn(f"{name}_to{w}_{size}", F.col(step) if done[w] is None else F.zip_with(done[w][0], later(step, done[w][1]), both))
                done[w] = (f"{name}_to{w}_{size}", size if done[w] is None else done[w][1] + size)
        if 2 * size <= max(widths):
            df = df.withColumn(f"{name}_by{2 * size}", F.zip_with(step, later(step, size), both))
            step = f"{name}_by{2 * size}"
        size *= 2
    return df.withColumns({f"{name}_{w}": F.slice(done[w][0], 1, F.greatest(F.size(name) - w + 1, F.lit(0))) for w in widths})


def windows(docs: DataFrame, widths: list[int], strong: bool = False) -> DataFrame:
    """Adds __h, an array of (width, hashes, others) for the canonical texts: the hash of
    every window, and the hash of every window that holds a word that may be a name,
    with that read as a name, else null.  strong: only of windows with three plain words
    or more; equal windows have as many, so one side of a join can see to that."""
    name = F.xxhash64(F.lit(NAME))
    out = canonical(docs)
    out = out.withColumn("__g", F.when(F.col("__some"), F.transform("__t", lambda t: F.xxhash64(_sign(t)))).otherwise(F.transform("__t", lambda t: F.xxhash64(t))))
    out = out.withColumn("__g2", F.when(F.col("__q").isNotNull(), F.zip_with("__g", "__q", lambda g, q: F.when(q == 1, name).otherwise(g))))
    for array in ("__g", "__g2"):
        out = _runs(out, array, widths, lambda a, b: F.xxhash64(a, b))
    if strong:
        out = out.withColumn("__w", F.transform("__t", lambda t: F.when(t.startswith(MARK), 0).otherwise(1)))
        out = out.withColumn("__w2", F.zip_with("__w", F.coalesce("__q", F.transform("__t", lambda t: F.lit(0))), lambda w, q: w - q))
        for array in ("__w", "__w2"):
            out = _runs(out, array, widths, lambda a, b: a + b)
    none = F.array().cast("array<bigint>")

    def of(w: int) -> Column:
        hashes = F.col(f"__g_{w}")
        others = F.zip_with(hashes, f"__g2_{w}", lambda a, b: F.when(a != b, b))
        if strong:
            hashes, others = (F.zip_with(h, f"{n}_{w}", lambda a, n: F.when(n >= 3, a)) for h, n in ((hashes, "__w"), (others, "__w2")))
        return F.struct(F.lit(w).alias("width"), hashes.alias("hashes"), F.when(F.col("__q").isNull(), none).otherwise(others).alias("others"))

    return out.withColumn("__h", F.array(*[of(w) for w in widths])).select(*docs.columns, "__t", "__q", "__h")


def _readings(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, ix, plain (the hash of the plain reading), named (whether this row is
    the other one), h and slots (type and value) for every window."""
    def token(i: Column, named: bool) -> Column:
        t = F.get("__t", i)
        return F.when(F.get("__q", i) == 1, F.concat(F.lit(NAME), t)).otherwise(t) if named else t

    def window(width: Column, plain: Column, h: Column, i: Column, named: bool) -> Column:
        # not slice(), which copies the whole array each time
        at = F.transform(F.sequence(i, i + width - 1), lambda j: token(j, named))
        slots = F.when(h.isNotNull(), F.filter(at, lambda t: t.startswith(MARK)))
        return F.struct(width.alias("width"), i.alias("ix"), plain.alias("plain"), F.lit(named).alias("named"), h.alias("h"), slots.alias("slots"))

    # windows are made in the array, so that the rows do not carry the whole text along
    made = F.flatten(F.transform("__h", lambda x: F.concat(
        F.transform(x["hashes"], lambda h, i: window(x["width"], h, h, i, False)),
        F.transform(x["others"], lambda h, i: window(x["width"], F.get(x["hashes"], i), h, i, True)),
    )))
    each = table.select(*keys, F.filter(made, lambda w: w["h"].isNotNull()).alias("made"))
    return each.select(*keys, F.explode_outer("made").alias("w")).where("w.h is not null").select(*keys, "w.*")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, n_slots, n_consistent and row_key
    (the document's) for every document that leaks an item."""
    items = canonical(benchmark.select("item_id", "text")).drop("__some").withColumn("__n", F.size("__t"))
    short = sorted(r[0] for r in items.where(f"__n between 3 and {width - 1}").select("__n").distinct().collect())  # fewer than `width` rows
    widths = [width, *short]
    cut = materialize(windows(benchmark.select("item_id", "text"), widths, strong=True).withColumn("__n", F.size("__t")))
    held = _readings(cut, ["item_id", "__n"]).where(f"width = least(__n, {width})")
    wanted = materialize(held.select("item_id", "plain", "h").distinct())
    hint = F.broadcast if wanted.count() <= broadcast_rows else (lambda t: t)

    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("__row"))
    every = F.array_distinct(F.flatten(F.transform("__h", lambda x: F.concat(x["hashes"], x["others"]))))
    # outer: else a filter on the array's size is pushed down and computes it inside itself
    found = windows(keyed, widths).select("doc_id", "__row", F.explode_outer(every).alias("h"))
    matched = found.where("h is not null").join(hint(wanted), "h").groupBy("__row", "doc_id", "item_id").agg(F.countDistinct("plain").alias("n_matched"))
    totals = wanted.groupBy("item_id").agg(F.countDistinct("plain").alias("n_windows"))
    near = materialize(matched.join(totals, "item_id").where(F.col("n_matched") >= share * F.col("n_windows")))

    asked = near.select("__row", "item_id")
    texts = keyed.join(asked.select("__row").distinct(), "__row", "left_semi").dropDuplicates(["__row"])
    ours = _readings(windows(texts, widths), ["__row"]).join(asked, "__row").select("__row", "item_id", "h", "named", "slots")
    theirs = _readings(cut, ["item_id", "__n"]).select(
        "item_id", "h", F.when(F.col("width") == F.least("__n", F.lit(width)), F.col("plain")).alias("counted"), F.col("named").alias("also"), F.col("ix").alias("at"), F.col("slots").alias("wanted")
    )
    # way 0: plain readings only; 1: both
    ways = F.when(F.col("named") | F.col("also"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = materialize(ours.join(hint(theirs), ["item_id", "h"]).select("__row", "item_id", "at", "counted", "wanted", "slots", F.explode(ways).alias("way")).distinct())
    each = ["__row", "item_id", "way"]
    counted = met.groupBy(*each).agg(F.countDistinct("counted").alias("n_matched"))
    bound = (
        met.select(*each, "at", F.explode(F.arrays_zip("wanted", "slots")).alias("z"))
        .select(*each, "at", F.col("z.wanted").alias("slot"), F.col("z.slots").alias("value"))
        .distinct()
    )
    where = [*each, "slot"]
    best = bound.groupBy(*where, "value").count().groupBy(*where).agg(F.max("count").alias("best"))
    every_at = bound.select(*where, "at").distinct().groupBy(*where).agg(F.count(F.lit(1)).alias("all"))
    steady = best.join(every_at, where).groupBy(*each).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count(F.when(F.col("best") == F.col("all"), 1)).alias("n_consistent")
    )
    zero = F.lit(0).cast("long")
    found = (
        near.drop("n_matched").join(counted, ["__row", "item_id"]).join(steady, each, "left")
        .withColumns({"n_slots": F.coalesce("n_slots", zero), "n_consistent": F.coalesce("n_consistent", zero)})
        .where((F.col("n_matched") >= share * F.col("n_windows")) & (F.col("n_consistent") >= share * F.col("n_slots")))
    )
    figures = F.struct("way", "n_matched", "n_windows", "n_slots", "n_consistent")
    return found.groupBy("doc_id", "item_id", "__row").agg(F.min(figures).alias("f")).select(
        "doc_id", "item_id", "f.n_matched", "f.n_windows", "f.n_slots", "f.n_consistent", F.col("__row").alias("row_key")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that leak no item."""
    dirty = materialize(leaks(docs, benchmark, **options).select(F.col("row_key").alias("leak")).distinct())
    return with_user(docs).join(dirty, F.col("row") == F.col("leak"), "left_anti").select(of_user(docs.columns))


def unmatchable(benchmark: DataFrame, width: int = 5) -> DataFrame:
    """item_id of the items that leaks() cannot find: without a window of three plain
    words, so that any text might hold them by chance."""
    items = benchmark.select("item_id", "text")
    cut = windows(items, [width, *range(3, width)], strong=True).withColumn("__n", F.size("__t"))
    held = _readings(cut, ["item_id", "__n"]).where(f"width = least(__n, {width})").select("item_id").distinct()
    return items.select("item_id").join(held, "item_id", "left_anti")
