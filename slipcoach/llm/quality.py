"""Quality rules by distribution divergence; DataFrame functions only.

Each document's histograms of character classes and of common words are compared with those of its declared language by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The references are the summed histograms of all
documents of the language. Documents shorter than a minimum length have too coarse histograms and pass that test.

Defined results: a null or blank text has no words and fails the base rules; a null language is a language of its own;
repeated rows are judged alike; a language with a single document is its own reference; an empty table gives an empty
one; other columns pass through `keep`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

#: Frequent function words of the languages that the references know, in no particular order.
COMMON = (
    "the of and to in a is that for it as was with be by on not are this from at or an "
    "de la le et les des en un du une que est pour qui dans par plus au sur il ne ce "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine für als "
    "el y los se del las con no su al lo como más o pero sus"
).split()
COMMON = tuple(dict.fromkeys(COMMON))
#: The classes of characters, taken out of the text one after the other; what is left is the last class.
CLASSES = (r"[a-z]+", r"[A-Z]+", r"[\x20\x09-\x0D]+", r"[0-9]+", r"[.,;:!?'\"()\-]+", r"[#*$%&|<>]+", r"\p{L}+")
#: Places of two of them.
SPACE_CLASS, SYMBOL_CLASS = 2, 5
#: Letters that stand for common words (none of them a separator), and lists by which their hashes are looked up.
FIRST_LETTER, GROUPS = 0x100, 32
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Least length for the distances, and the largest distances that pass. A histogram of n words is off by about 1 / sqrt(n).
SURE_WORDS, CHAR_LIMIT, WORD_LIMIT, WORD_NOISE = 50, 0.23, 0.18, 1.4


def _words(text: str) -> Column:
    body = F.trim(F.col(text), F.lit("\t\n\x0b\x0c\r "))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACES))


def _letters(spark: SparkSession, hashes: str) -> Column:
    """The common words among hashed words, in order, as one letter each.

    Words are looked up by hash: in one of GROUPS short lists, so that no word is compared with all of them.
    """
    spelled = [(x, chr(FIRST_LETTER + k)) for k, c in enumerate(COMMON) for x in dict.fromkeys((c, c.capitalize(), c.upper()))]
    hashed = spark.range(1).select(F.array(*(F.xxhash64(F.lit(x)) for x, _ in spelled))).first()[0]
    known = {h: letter for h, (_, letter) in zip(hashed, spelled, strict=True)}
    keys: list[list[int]] = [[] for _ in range(GROUPS)]
    for h in known:
        keys[h % GROUPS].append(h)
    longs = F.array(*(F.array(*(F.lit(h).cast("long") for h in group)) if group else F.array().cast("array<bigint>") for group in keys))
    shown = F.array(*(F.array(*(F.lit(known[h]) for h in group)) if group else F.array().cast("array<string>") for group in keys))

    def letter(h: Column) -> Column:
        group = F.pmod(h, F.lit(GROUPS)).cast("int")
        return F.get(F.get(shown, group), (F.array_position(F.get(longs, group), h) - 1).cast("int"))

    return F.array_join(F.transform(F.filter(hashes, lambda h: h.isin(list(known))), letter), "")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, __length, and __chars and __common, arrays of counts.

    The last count of each array is that of all the rest. Every text is split once; each word is hashed once, and windows
    are hashes of five hashes.
    """
    out = docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("__w", _words("__t"))
    # what each class takes out of the text is the number of its characters
    out = out.withColumn("__r0", F.col("__t"))
    for k, kind in enumerate(CLASSES):
        out = out.withColumn(f"__r{k + 1}", F.regexp_replace(f"__r{k}", kind, ""))
    left = [F.length(f"__r{k}") for k in range(len(CLASSES) + 1)]
    chars = F.array(*(a - b for a, b in zip(left, left[1:], strict=False)), left[-1])
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        *(F.col(f"`{c}`") for c in docs.columns), "__t", F.size("__w").cast("long").alias("n_words"), chars.alias("__chars"), lines.alias("__l"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h")
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("__h") - WINDOW), lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(WINDOW))))
    out = out.withColumn("__v", F.when(F.size("__h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).withColumn("__hits", _letters(docs.sparkSession, "__h"))
    placed = F.sort_array(F.transform("__v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__v")) < F.size("__v"), placed))
    same = lambda x, j: F.get("__s", j)["x"].eqNullSafe(x["x"])
    twice = F.filter("__s", lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1))
    out = out.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window adds the words that the one before it does not cover yet
    start = F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct((a["c"] + F.least(F.lit(WINDOW), p - a["at"])).alias("c"), p.alias("at")), lambda a: a["c"])
    letters = [chr(FIRST_LETTER + k) for k in range(len(COMMON))]
    known = F.array(*(F.length("__hits") - F.length(F.replace("__hits", F.lit(x), F.lit(""))) for x in letters))
    out = (
        out.withColumn("__length", F.length("__t"))
        .withColumn("word_chars", (F.col("__length") - F.get("__chars", SPACE_CLASS)).cast("long"))
        .withColumn("n_symbols", F.get("__chars", SYMBOL_CLASS).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("__common", F.array_append(known, (F.col("n_words") - F.length("__hits")).cast("int")))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__t", "__l", "__h", "__v", "__s", "__p", "__hits")


def references(histograms: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(lang, chars, common): the shares over all documents of a language."""
    sums = lambda name, n: [F.sum(F.col(name)[k]).cast("double").alias(f"{name}{k}") for k in range(n)]
    chars, common = sums("__chars", len(CLASSES) + 1), sums("__common", len(COMMON) + 1)
    total = histograms.groupBy(F.col(lang_col).cast("string").alias("__lang")).agg(*chars, *common)

    def shares(name: str, n: int) -> Column:
        every = reduce(lambda a, b: a + b, (F.col(f"{name}{k}") for k in range(n)))
        return F.array(*(F.col(f"{name}{k}") / F.greatest(every, F.lit(1.0)) for k in range(n)))

    return scratch.save(total.select("__lang", shares("__chars", len(chars)).alias("__of_chars"), shares("__common", len(common)).alias("__of_common")), "references")


def distance(counts: str, shares: str, total: str | None = None) -> Column:
    """Jensen-Shannon distance of an array of counts from an array of shares that sum to 1; 0 if nothing is counted.

    What is not counted gives its share, so only counts above 0 are worked out. total: a column with the sum of the counts,
    which saves adding them up for every one of them.
    """
    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) if total is None else F.col(total)

    def part(x: Column) -> Column:
        p, q = x["p"] / whole, x["q"]
        return p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0) - q

    held = F.filter(F.zip_with(counts, shares, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda x: x["p"] > 0)
    return F.when(whole > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(held, F.lit(1.0), lambda a, x: a + part(x)) / 2))).otherwise(0.0)


def judge(histograms: DataFrame, refs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Rows of with_counts, with char_distance, word_distance and kept."""
    out = histograms.join(refs, F.col(lang_col).cast("string").eqNullSafe(F.col("__lang")))
    out = out.withColumn("char_distance", distance("__chars", "__of_chars", "__length")).withColumn("word_distance", distance("__common", "__of_common", "n_words"))
    near = (F.col("n_words") < SURE_WORDS) | ((F.col("char_distance") <= CHAR_LIMIT) & (F.col("word_distance") <= WORD_LIMIT + WORD_NOISE / F.sqrt("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("__lang", "__of_chars", "__of_common", "__chars", "__common", "__length")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, n_words, the four counts, base_failed, both distances, kept. The texts are read once."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`"))
    seen = scratch.save(with_counts(rows, text_col).drop(text_col), "histograms")
    return judge(seen, references(seen, lang_col), lang_col).drop(lang_col)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns. The texts are read once: rows and histograms are saved side by side."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang_col}`").cast("string").alias("__of"))
    seen = scratch.save(with_counts(whole, "__text").select("__row", "__of", "n_words", "base_failed", "__chars", "__common", "__length"), "judged")
    return judge(seen, references(seen, "__of"), "__of").filter("kept").select("__row.*")
