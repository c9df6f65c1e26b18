"""Benchmark decontamination by typed templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.session import materialize

#: Words of a window.
WINDOW = 8
#: A window whose template has fewer literal words says too little; see :func:`benchmark_windows`.
MIN_LITERALS = 4
#: A document leaks an item if its windows cover this share of the item's words, or are so many (19 words in a row).
MIN_SHARE, MIN_WINDOWS = 0.5, 12
#: Or so many words of it in a row, in upper or lower case.
MIN_RUN = 13
#: In a consistent occurrence, this share of the item's slot values has one counterpart in so much of its places, and so the other way round.
MIN_CONSISTENT = 0.8
#: More windows than this are joined by a shuffle instead of a broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 500_000

# Words taken for a unit after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz kb mb gb tb bit bits byte bytes w kw mw kwh j kj cal kcal v volt volts "
    "a amp amps ohm ohms n newton newtons pa kpa bar psi c f k degree degrees percent cent cents dollar dollars euro euros usd eur gbp yen"
).split()

NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


def words_of(text: Column) -> Column:
    """Runs of letters and digits; a number's inner points, commas, colons and strokes are dropped, so that it stays one word."""
    joined = F.when(F.rlike(text, F.lit("[0-9]")), F.regexp_replace(text, r"(?<=[0-9])[.,:/](?=[0-9])", "")).otherwise(text)
    return F.array_remove(F.split(joined, r"[^\p{L}\p{N}]+"), "")


def template_of(words: Column) -> Column:
    """Numbers, capitalised words and units after numbers become typed placeholders; other words stay as they are."""

    def number(w: Column) -> Column:
        return (w >= "0") & (w < ":")

    def one(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        unit = (i > 0) & number(F.get(words, i - 1)) & F.array_contains(F.array(*map(F.lit, UNITS)), w)
        return F.when(number(w), F.lit(NUM)).when(first != F.lower(first), F.lit(NAME)).when(unit, F.lit(UNIT)).otherwise(w)

    return F.transform(words, one)


def _slots(template: Column) -> Column:
    return F.size(F.filter(template, lambda c: F.startswith(c, F.lit("<"))))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(key, item_id, at, n, words, template, width, form) of every window of every item.

    Items shorter than ``window`` words have one window of all their words. Each
    window has its lower-case words as a key (form literal) and, if it has
    enough literals, its template (form template). An item whose such windows
    cover less than ``MIN_SHARE`` of its words, but that says something as a whole (form whole), has the window with the most
    literals as key too; words and template are then the whole item's, and the rest
    is compared there. Names alone say nothing: two literals, or one and two numbers. n is the item's number of words.
    """
    parsed = items.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    parsed = parsed.withColumn("c", template_of(F.col("w"))).withColumn("width", F.least(F.size("w"), F.lit(window)))
    cut = parsed.select("item_id", "w", "c", "width", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"))).alias("at")).select(
        "item_id", "w", "c", "at", "width", F.slice("w", F.col("at") + 1, F.col("width")).alias("words"), F.slice("c", F.col("at") + 1, F.col("width")).alias("template")
    )
    counted = cut.withColumn("literals", F.col("width") - _slots(F.col("template"))).withColumn("strong", F.col("literals") >= F.least(F.lit(MIN_LITERALS), F.col("width")))
    text = Window.partitionBy("item_id", "w").orderBy("at")
    covers = _covered(counted.where("strong"), text).groupBy("item_id", "w").agg(F.sum("new").alias("covered"))
    kept = counted.join(covers, ["item_id", "w"], "left")
    rest = ["words", "template", "width"]
    literal = kept.select(_key(_lower(F.col("words"))).alias("key"), "item_id", "at", F.size("w").cast("long").alias("n"), *rest, F.lit("literal").alias("form"))
    strong = kept.where("strong").select(_key(F.col("template")).alias("key"), "item_id", "at", F.size("w").cast("long").alias("n"), *rest, F.lit("template").alias("form"))
    said = F.size("c") - _slots(F.col("c"))
    numbers = F.size(F.filter("c", lambda c: c == NUM))
    weak = kept.where((F.coalesce("covered", F.lit(0)) < MIN_SHARE * F.size("w")) & ((said >= 2) | ((said >= 1) & (numbers >= 2))))
    # An id with several texts has the best window of each.
    best = weak.groupBy("item_id", "w", "c", "width").agg(F.max(F.struct("literals", (-F.col("at")).alias("back"), "template")).alias("b"))
    whole = best.select(_key(F.col("b.template")).alias("key"), "item_id", (-F.col("b.back")).alias("at"), F.size("w").cast("long").alias("n"), F.col("w").alias("words"), F.col("c").alias("template"), "width", F.lit("whole").alias("form"))
    return literal.unionByName(strong).unionByName(whole)


def _covered(windows: DataFrame, order) -> DataFrame:
    """Adds ``new``: the words of each window (at, width) that the one before it in ``order`` does not cover."""
    return windows.withColumn("new", F.least(F.col("width"), F.coalesce(F.col("at") - F.lag("at").over(order), F.col("width"))))


def _key(words: Column) -> Column:
    return F.xxhash64(words)


def _lower(words: Column) -> Column:
    return F.transform(words, F.lower)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, min_windows: int = MIN_WINDOWS, min_run: int = MIN_RUN) -> DataFrame:
    """Documents (doc_id, text) that hold benchmark items (item_id, text), as they are or with other numbers, names or units.

    Every window of every whole document is looked up among the items' windows,
    by its template and by its lower-case words. Matches of one document and
    item with the same distance between their places form a diagonal; diagonals
    less than a window apart, as a word put in or left out makes them, are one
    occurrence of the item. Templates of an occurrence count if its slots are
    consistent: a value of the item stands for one value in the document
    throughout, and no two for the same. Windows that only share a template by chance fail that. Words need
    no such check, and ``min_run`` of them in a row are enough; on a diagonal
    whose slots are not consistent (another question of the same form), it takes
    as many as ``min_windows`` windows have.

    Returns doc_id, item_id, windows (of the item found in consistent
    occurrences), of (its windows in all), share (of its words that they cover), and kind: exact if every slot
    holds the item's own value, else reparameterised. What only the words show is
    exact, with the windows found by words. Null texts and ids match nothing;
    repeated rows count once.
    """
    spark = docs.sparkSession
    bench = materialize(benchmark_windows(items, window), "windows")
    forms = [(r["width"], r["form"], r["n"]) for r in bench.groupBy("width", "form").agg(F.count("*").alias("n")).collect()]  # at most 3 x window rows
    parsed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("w")).withColumn("c", template_of(F.col("w"))).withColumn("l", _lower(F.col("w")))
    found = None
    for width, form, n in sorted(forms):
        own = bench.where((F.col("width") == width) & (F.col("form") == form))
        at = F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("pos")
        windows = parsed.where(F.size("w") >= width).select("doc_id", "w", "c", "l", at)
        key = _key(F.slice("l" if form == "literal" else "c", F.col("pos") + 1, width)).alias("key")
        if form == "whole":
            # Only places travel with a window until it is found; words are cut out for those, one more in front as a unit is told by it.
            shapes = own.select("key", "at", F.size("template").alias("size")).distinct()
            parts = -(-n // BROADCAST_WINDOWS)
            for part in range(parts):  # one of these for each item, and each part is small enough
                some = shapes.where(F.pmod("key", F.lit(parts)) == part)
                start = F.col("pos") - F.col("at")
                lead = (start > 0).cast("int")
                cut = F.slice("w", start + 1 - lead, F.col("size") + lead)
                near = windows.select("doc_id", "w", "pos", key).join(F.broadcast(some), "key").where((start >= 0) & (start + F.col("size") <= F.size("w"))).select("doc_id", "key", start.alias("pos"), F.col("at").alias("back"), lead.alias("lead"), cut.alias("cut"))
                typed_cut = near.select("doc_id", "key", "pos", "back", F.slice("cut", F.col("lead") + 1, F.size("cut")).alias("dw"), F.slice(template_of(F.col("cut")), F.col("lead") + 1, F.size("cut")).alias("dt"))
                told = own.select(F.col("key").alias("own_key"), F.col("at").alias("own_at"), "template", "item_id", "n", "words")
                # A plain equality of the templates would be known not to be null, and tested so in the join above, with every window's words at hand.
                fits = (F.col("key") == F.col("own_key")) & (F.col("back") == F.col("own_at")) & F.col("dt").eqNullSafe(F.col("template"))
                hits = typed_cut.join(told, fits).select("doc_id", "item_id", "n", "pos", F.lit(0).alias("at"), "words", "template", "dw", F.size("template").alias("width"), F.lit(form).alias("form"))
                found = hits if found is None else found.unionByName(hits)
            continue
        keys = own.select("key").distinct()
        cut = F.slice("w", F.col("pos") + 1, width) if form == "template" else F.lit(None).cast("array<string>")
        if n > BROADCAST_WINDOWS:
            hits = windows.select("doc_id", "pos", key, cut.alias("dw")).join(keys, "key", "left_semi")
        else:  # the number of windows has just been checked
            hits = windows.select("doc_id", "pos", "w", key).join(F.broadcast(keys), "key", "left_semi").select("doc_id", "pos", "key", cut.alias("dw"))
        told = ["words", "template"] if form == "template" else [F.lit(None).cast("array<string>").alias(k) for k in ("words", "template")]
        hits = hits.join(own.select("key", "item_id", "at", "n", *told), "key").select("doc_id", "item_id", "n", "pos", "at", "words", "template", "dw", F.lit(width).alias("width"), F.lit(form).alias("form"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, windows long, of long, share double, kind string")
    found = materialize(found.withColumn("diagonal", F.col("pos") - F.col("at")), "matches")

    one = ["doc_id", "item_id", "diagonal"]
    typed, worded = found.where("form <> 'literal'"), found.where("form = 'literal'")
    along = Window.partitionBy("doc_id", "item_id").orderBy("diagonal")
    apart = (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(0)) >= window).cast("int")
    # A row for each diagonal of a document and item.
    placed = typed.select(*one).distinct().withColumn("apart", apart).select(*one, F.sum("apart").over(along).alias("occurrence"))
    strength = typed.groupBy(*one).agg(F.count("*").alias("strength"))
    typed = materialize(typed.join(placed, one).join(strength, one), "typed")
    here = ["doc_id", "item_id", "occurrence"]
    # Each slot of the item has the counterpart that the strongest diagonal over it shows.
    slots = typed.select(*here, "at", "strength", "diagonal", F.posexplode(F.arrays_zip("template", "words", "dw")).alias("k", "z")).where(F.startswith("z.template", F.lit("<")))
    told = slots.groupBy(*here, (F.col("at") + F.col("k")).alias("slot")).agg(F.max_by("z", F.struct("strength", "diagonal")).alias("z"))
    pairs = materialize(told.groupBy(*here, F.col("z.words").alias("value"), F.col("z.dw").alias("other")).agg(F.count("*").alias("n")), "slots")
    steady = F.max("n") >= MIN_CONSISTENT * F.sum("n")
    forth = pairs.groupBy(*here, "value").agg(steady.cast("double").alias("steady"), F.max_by("other", F.struct("n", "other")).alias("main")).groupBy(*here).agg(F.avg("steady").alias("forth"), F.min(F.col("main") == F.col("value")).alias("same"))
    back = pairs.groupBy(*here, "other").agg(steady.cast("double").alias("steady")).groupBy(*here).agg(F.avg("steady").alias("back"))
    by_place = forth.join(back, here).select(*here, F.least("forth", "back").alias("consistent"), "same")
    by_value = placed.join(by_place, here).drop("occurrence")
    good = typed.join(by_place, here, "left").where(F.coalesce("consistent", F.lit(1.0)) >= MIN_CONSISTENT)
    # How often an item window is found in good occurrences is at most its document's length.
    per_window = good.groupBy("doc_id", "item_id", "at").agg(F.max("n").alias("n"), F.max("width").alias("width"), F.max(F.coalesce("same", F.lit(True))).alias("same"))
    counted = _covered(per_window, Window.partitionBy("doc_id", "item_id").orderBy("at"))
    scored = counted.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.sum("new").alias("covered"), (F.max("n") - F.max("width") + 1).alias("of"), F.max("n").alias("n"), F.min("same").alias("same"))
    share = F.least(F.col("covered") / F.col("n"), F.lit(1.0)).alias("share")
    by_type = scored.where((share >= min_share) | (F.col("windows") >= min_windows)).select("doc_id", "item_id", F.struct(F.lit(0).alias("rank"), "windows", "of", share, "same").alias("b"))

    # Places that follow each other on a diagonal, at most an item's length, are a run.
    place = worded.groupBy(*one, "at").agg(F.max("n").alias("n"), F.max("width").alias("width"))
    runs = place.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*one).orderBy("at"))).groupBy(*one, "run").agg(F.count("*").alias("long"))
    long_runs = runs.join(by_value.where(F.col("consistent") < MIN_CONSISTENT).select(*one, F.lit(True).alias("mixed")), one, "left")
    ran = long_runs.where(F.col("long") >= F.when(F.col("mixed"), min_windows).otherwise(min_run - window + 1)).select("doc_id", "item_id", F.lit(True).alias("ran")).distinct()
    steps = Window.partitionBy("doc_id", "item_id").orderBy("at")
    clear = place.join(by_value.where(F.col("consistent") < MIN_CONSISTENT).select(*one), one, "left_anti").groupBy("doc_id", "item_id", "at").agg(F.max("width").alias("width"))
    clear = _covered(clear, steps).groupBy("doc_id", "item_id").agg(F.sum("new").alias("clear"))
    every = _covered(place.groupBy("doc_id", "item_id", "at").agg(F.max("n").alias("n"), F.max("width").alias("width")), steps)
    every = every.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.sum("new").alias("covered"), (F.max("n") - F.max("width") + 1).alias("of"), F.max("n").alias("n"))
    in_words = every.join(ran, ["doc_id", "item_id"], "left").join(clear, ["doc_id", "item_id"], "left")
    by_words = in_words.where(F.col("ran") | (F.coalesce("clear", F.lit(0)) / F.col("n") >= min_share)).select("doc_id", "item_id", F.struct(F.lit(1).alias("rank"), "windows", "of", share, F.lit(True).alias("same")).alias("b"))
    best = by_type.unionByName(by_words).groupBy("doc_id", "item_id").agg(F.min("b").alias("b")).select("doc_id", "item_id", "b.*")
    return best.select("doc_id", "item_id", "windows", "of", F.round("share", 6).alias("share"), F.when(F.col("same"), "exact").otherwise("reparameterised").alias("kind"))
