"""Benchmark questions in documents, re-parameterised ones too.

Texts become templates: numbers, units after a number and names turn into typed
placeholders that keep their value, all other words stand for themselves, without
regard to case.  A name is what the benchmark never uses as a plain word, so that it
needs no capital: the benchmark's vocabulary is the words that begin with a small
letter somewhere in it, and any other word, of an item or of a document, is taken
for a name.  A word of the vocabulary with a
capital may be a name as well: documents have windows with all of those within
sentences as names and with none, and windows of items come with every choice.  A placeholder without a plain word beside it keeps its value, so
lists of names or numbers match word for word only.

Windows of the benchmark's templates are joined by hash with the windows of all
documents.  A window counts if a third of its words stand as they are.  Where an item
stands in a document, the values of the slots of windows that differ must correspond
both ways: one benchmark value, one document value.  A document whose slots all agree
holds the question itself; where some differ, but as such a mapping, it holds the
question with other parameters.

Everything is Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ship, workspace

#: Runs of letters, with the space before them if they begin with a capital within a sentence; numbers with marks between their digits.
TOKEN = r"(?<=[a-z0-9,;\p{Ll}]) [A-Z\p{Lu}][a-zA-Z\p{L}\p{M}]*|[a-zA-Z\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*"
#: Symbols of a window that are looked up before all of them are.
FIRST = 3
#: Symbols of placeholders; other words are their hash.
NUMBER, UNIT, NAME = 0, 1, 2
#: Number words of four languages.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
#: Words that count as units directly after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mile miles meter meters metre metres inch inches feet foot yard yards kilometer kilometers kilometre kilometres mg g kg t ton tons gram grams gramm oz ounce ounces lb lbs pound pounds "
    "ml cl dl l liter liters litre litres gal gallon gallons s sec secs second seconds min mins minute minutes minuten h hr hrs hour hours stunden day days tage week weeks wochen month months monate year years jahre hz khz mhz ghz w kw mw v kv "
    "ma j kj cal kcal pa kpa bar kmh kph mph b kb mb gb tb usd eur gbp dollar dollars cents euro euros percent prozent degree degrees grad heures jours semaines mois ans horas días semanas meses años"
).split()
#: Words of a window; least share of an item's windows.
WINDOW, LEAST_SHARE = 8, 0.5
#: Windows of items that are in a plan and broadcast at once (some 300 bytes each), a benchmark of more is met in parts; plain words that a benchmark may have, for they are in the plan.
PART_WINDOWS, VOCABULARY = 50_000, 100_000


def _list(values) -> str:
    """For IN: numbers, or words, which hold letters only, so that nothing has to be escaped."""
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in values) + ")"


def _slot(x: str) -> str:
    return f"{x} BETWEEN {NUMBER} AND {NAME}"


def _settled(symbols: str, i: str) -> str:
    """Symbol ``i`` of an array: a placeholder between others, or at an end beside one, is its word's hash."""
    beside = " AND ".join(_slot(f"coalesce(get({symbols}, {i} {d} 1), {NAME})") for d in "-+")
    return f"IF({_slot(f'get({symbols}, {i})')} AND {beside}, xxhash64(get(low, {i})), get({symbols}, {i}))"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` computed once: the optimiser puts no expression in place of a lambda's variable."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(coalesce(cast({text} AS string), ''), '{TOKEN.replace(chr(92), chr(92) * 2)}', 0)"


def template(text: str, vocabulary: list[str], use: str) -> Column:
    """The expression ``use`` over a text's words, ``words``, those in lower case, ``low``, and their symbols, ``plain``."""
    special = {*NUMBER_WORDS, *UNITS}
    sure, unsure = [w for w in vocabulary if w not in special], [w for w in vocabulary if w in special]
    number = lambda w: f"(({w} < ':' AND {w} >= '0') OR {w} IN {_list(NUMBER_WORDS)})"
    known = lambda words: f"w IN {_list(words)}" if words else "false"
    rare = f"CASE WHEN w IN {_list(NUMBER_WORDS)} THEN {NUMBER}L WHEN {number('get(low, i - 1)')} THEN {UNIT}L WHEN {known(unsure)} THEN xxhash64(w) ELSE {NAME}L END"
    plain = f"transform(low, (w, i) -> CASE WHEN {known(sure)} THEN xxhash64(w) WHEN w < ':' AND w >= '0' THEN {NUMBER}L WHEN w IN {_list(sorted(special))} THEN {rare} ELSE {NAME}L END)"
    return F.expr(_let("words", _tokens(text), _let("low", "transform(words, w -> lower(IF(w < '!', substring(w, 2), w)))", _let("plain", plain, use))))


def _named(where: str) -> str:
    """``plain`` with words in mixed case as names ``where`` a condition of w, the word as it stands, holds."""
    return f"zip_with(plain, words, (s, w) -> IF({where} AND NOT {_slot('s')} AND w != upper(w), {NAME}L, s))"


def _hash(symbols: str, size: int, at: str = "0") -> str:
    return "xxhash64(" + ", ".join(f"get({symbols}, {at} + {k})" for k in range(size)) + ")"


def _hits(size: int, firsts: list[int], hashes: list[int]) -> str:
    """Over a template: array<struct<size, at, hash, stands>> of the runs of ``size`` words, in either form, whose hash is one of these; ``firsts`` are those of their first symbols."""
    hit = f"transform(filter(x.starts, i -> {_hash('f', min(size, FIRST), 'i')} IN {_list(firsts)} AND {_hash('f', size, 'i')} IN {_list(hashes)}), i -> named_struct('size', {size}, 'at', i, 'hash', {_hash('f', size, 'i')}, 'stands', slice(low, i + 1, {size})))"
    form = lambda of, starts: f"named_struct('f', transform({of}, (s, i) -> {_settled(of, 'i')}), 'starts', {starts})"
    # Runs that hold or touch a word that is a name in the second form only.
    touched = f"array_distinct(flatten(transform(filter(sequence(0, size(low) - 1), i -> get(named, i) != get(plain, i)), i -> sequence(greatest(0, i - {size}), least(size(low) - {size}, i + 1)))))"
    second = _let("named", _named("w < '!'"), f"array({form('named', touched)})")
    forms = f"concat(array({form('plain', f'sequence(0, size(low) - {size})')}), IF(exists(words, w -> w < '!'), {second}, array()))"
    none = "cast(array() AS array<struct<size: int, at: int, hash: bigint, stands: array<string>>>)"
    return f"IF(size(low) >= {size}, flatten(transform({forms}, x -> {_let('f', 'x.f', hit)})), {none})"


def item_windows(items: DataFrame) -> DataFrame:
    """Rows (item, size, item_at, hash, first, run, slots) of items(item, low, plain, named): all forms of all windows.

    The words beside a window decide what its outer placeholders are; beyond the
    item's ends those of the document do, which may be either.
    """
    pad = NAME + 1  # a symbol that is no placeholder
    padded = items.select("item", "low", F.expr(f"concat(array({pad}L), plain, array({pad}L))").alias("plain"), F.expr(f"concat(array({NAME}L), named, array({NAME}L))").alias("named"), F.least(F.lit(WINDOW), F.size("low")).alias("size"))
    at = padded.select("*", F.explode(F.expr("sequence(0, size(low) - size)")).alias("item_at"))
    part = at.select("item", "size", "item_at", *(F.slice(c, F.col("item_at") + 1, F.col("size") + extra).alias(c) for c, extra in (("low", 0), ("plain", 2), ("named", 2))))
    part = part.withColumn("open", F.expr("filter(sequence(0, size + 1), k -> get(plain, k) != get(named, k))"))
    chosen = part.withColumn("choice", F.explode(F.expr("sequence(0, shiftleft(1, size(open)) - 1)")))
    around = "transform(plain, (s, k) -> IF(array_contains(open, k) AND (shiftright(choice, cast(array_position(open, k) AS int) - 1) & 1) = 1, get(named, k), s))"
    # Places of the neighbourhood are one more than the window's.
    chosen = chosen.withColumn("around", F.expr(around)).withColumn("symbols", F.expr("transform(low, (w, i) -> " + _settled("around", "(i + 1)").replace("get(low, (i + 1))", "w") + ")"))
    hashed = F.coalesce(*(F.when(F.col("size") == s, F.expr(_hash("symbols", s))) for s in range(1, WINDOW + 1)))
    first = F.coalesce(*(F.when(F.col("size") == s, F.expr(_hash("symbols", s))) for s in range(1, FIRST)), F.expr(_hash("symbols", FIRST)))
    return chosen.select("item", "size", "item_at", hashed.alias("hash"), first.alias("first"), F.col("low").alias("run"), F.expr(f"transform(symbols, s -> {_slot('s')})").alias("slots")).dropDuplicates(["item", "size", "item_at", "hash"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Rows (id, item_id, share, n_slots, n_changed, kind): benchmark items that documents hold.

    share: of the item's windows (an item shorter than ``WINDOW`` words is one
    window), those that the document has in some place, ``least_share`` or more.
    n_slots, n_changed: distinct pairs of placeholders in the place with most
    windows, and those with another value.  kind: 'exact', or 're-parameterised'
    if values differ.  Windows whose values differ don't count in places where one
    value of the item meets several in such windows, or several meet one; windows
    with equal values do.

    Null and empty texts, documents shorter than a window and items without words
    hold nothing and are held by nothing.  Rows that repeat a document's or an
    item's id are taken together; rows with a null id are left out.  Further
    columns are ignored; an empty table on either side gives an empty result.  A
    benchmark of more than ``VOCABULARY`` plain words raises ValueError; run it
    in parts then, where names are what a part never uses as a plain word.
    """
    spark = docs.sparkSession
    ship(spark)
    at = workspace(spark, "decontam")
    asked = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL")
    spoken = asked.select(F.explode(F.expr(_tokens("text"))).alias("w")).where("w = lower(w) AND NOT (w < ':' AND w >= '0')")
    vocabulary = sorted(r.w for r in spoken.distinct().limit(VOCABULARY + 1).collect())
    if len(vocabulary) > VOCABULARY:
        raise ValueError(f"the benchmark has more than {VOCABULARY} plain words")
    items = asked.select("item", template("text", vocabulary, f"named_struct('low', low, 'plain', plain, 'named', {_named('ltrim(w) != lower(ltrim(w))')})").alias("t")).select("item", "t.*").where("size(low) > 0")
    parts = materialize(item_windows(items), f"{at}/windows")
    n_parts = -(-parts.count() // PART_WINDOWS) or 1
    held = None
    for k in range(n_parts):
        part = parts.where(F.expr(f"pmod(xxhash64(item), {n_parts}) = {k}"))
        found = _held(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL"), part, vocabulary, least_share, f"{at}/hits-{k}")
        held = found if held is None else held.unionByName(found)
    return held.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_id if item_id != id_col else "item_id"), (F.col("n") / F.col("of")).alias("share"), "best.n_slots", "best.n_changed",
        F.when(F.col("best.n_changed") > 0, "re-parameterised").otherwise("exact").alias("kind"),
    )


def _held(docs: DataFrame, parts: DataFrame, vocabulary: list[str], least_share: float, at: str) -> DataFrame:
    """Rows (doc, item, n, of, best) of docs(doc, text) that hold ``least_share`` of an item's windows ``of``."""
    sizes: dict[int, tuple[set, set]] = {}
    for r in parts.select("size", "first", "hash").distinct().collect():  # some ``PART_WINDOWS``
        firsts, hashes = sizes.setdefault(r["size"], (set(), set()))
        firsts.add(r["first"])
        hashes.add(r["hash"])
    hits = [_hits(size, sorted(firsts), sorted(hashes)) for size, (firsts, hashes) in sorted(sizes.items())] or [_hits(WINDOW, [0], [0])]
    # Written, so that the driver goes over thousands of literals once, not with every step below.
    placed = materialize(docs.select("doc", F.explode(template("text", vocabulary, f"concat({', '.join(hits)})")).alias("h")).select("doc", "h.*"), at)
    total = parts.groupBy("item").agg(F.count_distinct("item_at").alias("of"))
    met = placed.join(F.broadcast(parts.drop("first")), ["hash", "size"]).withColumn("offset", F.col("at") - F.col("item_at"))
    met = met.withColumn("pairs", F.expr("transform(filter(transform(run, (w, i) -> named_struct('item', w, 'doc', get(stands, i), 'slot', get(slots, i))), p -> p.slot), p -> named_struct('item', p.item, 'doc', p.doc))"))
    # What stands word for word counts in any case; only values that differ must be a mapping, over the windows they are in.
    met = met.withColumn("equal", F.expr("size(filter(run, (w, i) -> w = get(stands, i)))")).where("3 * equal >= size").withColumn("differs", F.col("equal") < F.col("size"))
    # An item's windows bound what is collected for a place where it stands.
    distinct = lambda pairs: F.array_distinct(F.flatten(F.collect_set(pairs)))
    place = met.groupBy("doc", "item", "offset").agg(F.collect_set("item_at").alias("all"), F.collect_set(F.when(~F.col("differs"), F.col("item_at"))).alias("literal"), distinct(F.col("pairs")).alias("pairs"), distinct(F.when(F.col("differs"), F.col("pairs"))).alias("other"))
    one_to_one = F.expr("size(array_distinct(transform(other, p -> p.item))) = size(other) AND size(array_distinct(transform(other, p -> p.doc))) = size(other)")
    place = place.withColumn("windows", F.when(one_to_one, F.col("all")).otherwise(F.col("literal"))).where(F.size("windows") > 0)
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    best = F.max_by(F.struct(F.size("pairs").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed")), F.struct(F.size("windows"), -F.col("offset")))
    counted = place.groupBy("doc", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("n"), best.alias("best"))
    return counted.join(total, "item").where(F.col("n") >= least_share * F.col("of"))
