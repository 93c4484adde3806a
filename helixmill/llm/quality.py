"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over its language's common words and all other words are compared with the language's reference by
Jensen-Shannon distance (base 2, so 0 to 1). A language's common words are the `COMMON_WORDS` most frequent words of all its labelled documents; its references are
the summed histograms of all its labelled documents that pass the base rules. A document is compared with its own language, one without a language with the nearest. It is rejected if a distance is over its limit; a text of too few characters or words is no evidence (minimum-length guards).

The limit of the word distance comes from the reference documents' own distances. These shrink with the root of the number of words, so per octave of that
number they are scaled to the octave's least length; there the limit is the upper quartile plus FENCE interquartile ranges, which junk among
the references hardly moves. An octave of fewer than LEAST_REFERENCES of them is pooled with shorter, then longer ones; while all pooled are
fewer, there is no limit.

Everything is built-in SQL functions. 5-word windows are compared by 64-bit hashes of their words' hashes, within one document only; texts
whose windows are all distinct (one hash set shows it) skip the sort that finds where windows repeat.

Scale: one pass over all labelled texts counts words, which tasks sum before they are shuffled; one pass over all texts makes a narrow table of counts; words and references are one row a language, and reach the rows as a
one-row table.

Cases: null text has no words and fails the base rules. A table without languages has no references: the base rules alone decide. Rows
are independent, so ties and repeated rows need no rule; words of equal frequency go by code point. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._base import SPACE, WORD, durable, text_or_empty

WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = "[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
#: Words of a language's histogram.
COMMON_WORDS = 32
#: Common words of all languages together are part of the plan up to so many; beyond it the same words are found more slowly.
LITERAL_WORDS = 5_000
MIN_CHARS, MIN_COMMON_WORDS = 80, 30
MAX_CLASS_DISTANCE = 0.25
FENCE, LEAST_REFERENCES, DISTANCE_BINS = 3, 30, 4000


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def common_words(docs: DataFrame) -> DataFrame:
    """language, words: the most frequent words, in lower case, of all documents of each language."""
    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("language"), F.lower("text").alias("text"))
    found = labelled.select("language", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''").groupBy("language", "word").agg(F.count("*").alias("n"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).where(F.col("r") <= COMMON_WORDS)
    return best.groupBy("language").agg(F.array_sort(F.collect_list("word")).alias("words"))


def listed(rows: DataFrame, name: str) -> DataFrame:
    """All rows, one a language, as one row with an array of them."""
    return F.broadcast(rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name)))


def own(name: str) -> Column:
    """The language's own entry of an array; all entries for a document without one."""
    mine = F.filter(name, lambda x: x["language"] == F.col("lang"))
    return F.when(F.size(mine) > 0, mine).otherwise(F.col(name))


def features(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Counts per document: the base rules' and the two histograms, that of words for its own language or for all."""
    one = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).join(listed(words, "languages")).withColumn("languages", own("languages"))
    # of all words only those in some list are looked up further: by a hash set, or in the document's own lists where the set would be too large a part of the plan
    found = words.select(F.explode("words")).distinct().limit(LITERAL_WORDS + 1).collect()
    one = one.withColumn("every", F.flatten(F.transform("languages", lambda x: x["words"])))
    listed_in = (lambda w: w.isin([x[0] for x in found])) if 0 < len(found) <= LITERAL_WORDS else (lambda w: F.array_contains("every", w))
    two = one.select(
        "doc_id", "lang", "text", "languages", "every", F.regexp_replace("text", r"\p{L}+", "").alias("rest"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines")
    )
    begins = F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - (WINDOW - 1)))
    three = two.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").alias("chars"),
        _count(F.col("text"), r"\p{Lu}+").alias("upper"),
        F.length("rest").alias("not_letters"),
        _count(F.col("rest"), "[0-9]+").alias("digit"),
        _count(F.col("rest"), SPACE).alias("space"),
        _count(F.col("rest"), SYMBOLS + "+").alias("symbol"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter(F.transform("words", lambda w: F.lower(w)), listed_in).alias("common"),
        "languages",
        F.transform(begins, lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, WINDOW)))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    five = three.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).drop("windows")
    near = lambda x, j: (F.get("sorted", j + 1)["w"] == x["w"]) | (F.when(j > 0, F.get("sorted", j - 1))["w"] == x["w"])
    twice = F.array_sort(F.filter(F.transform("sorted", lambda x, j: F.when(near(x, j), x["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )
    six = five.withColumn("twice", twice).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))

    def histogram(words: Column) -> Column:
        """Counts of these words among the document's, then of all others."""
        counts = F.transform(words, lambda k: (F.size("common") - F.size(F.array_remove("common", k))).cast("double"))
        return F.transform(F.array(counts), lambda c: F.concat(c, F.array(F.col("n_words") - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))[0]

    lower = F.col("chars") - F.col("not_letters") - F.col("upper")
    other = F.col("not_letters") - F.col("digit") - F.col("space") - F.col("symbol")
    return six.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.transform(F.array(lower, "upper", "digit", "space", "symbol", other), lambda x: x.cast("double")).alias("classes"),
        F.transform("languages", lambda x: F.struct(x["language"].alias("language"), histogram(x["words"]).alias("counts"))).alias("common"),
    )


def shares(counts: Column) -> Column:
    """A histogram's shares; null if it counts nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(F.nullif(total, F.lit(0.0))), lambda of: F.when(of > 0, F.transform(counts, lambda x: x / of)))[0]


def entropy(chances: Column) -> Column:
    return F.aggregate(chances, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def references(counts: DataFrame) -> DataFrame:
    """language, classes, common: shares of the summed histograms of the documents that pass the base rules."""
    sums = lambda array, n: F.array(*(F.sum(F.get(array, F.lit(i))) for i in range(n)))
    mine = F.get(F.filter("common", lambda x: x["language"] == F.col("lang")), F.lit(0))["counts"]
    good = counts.where("lang is not null and not base_failed").select(F.col("lang").alias("language"), "classes", mine.alias("common")).where("common is not null")
    summed = good.groupBy("language").agg(sums("classes", len(CLASSES)).alias("classes"), sums("common", COMMON_WORDS + 1).alias("common"))
    # a language of fewer words than COMMON_WORDS has nulls at the end
    full = summed.withColumn("common", F.filter("common", lambda x: x.isNotNull()))
    return full.select("language", shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common"))


def js_distance(share: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms' shares: the mean's entropy less the mean of the entropies."""
    mean = F.zip_with(share, reference, lambda x, y: (x + y) / F.lit(2.0))
    return F.sqrt(F.greatest(F.lit(0.0), entropy(mean) - (entropy(share) + entropy(reference)) / F.lit(2.0)))


def distances(counts: DataFrame) -> DataFrame:
    """Adds class_distance and common_distance: to the own language's reference, or to the nearest; null under the guards or without a reference."""
    met = counts.join(listed(references(counts), "references")).withColumn("references", own("references"))
    met = met.select("*", shares(F.col("classes")).alias("class_share"), F.transform("common", lambda x: F.struct(x["language"].alias("language"), shares(x["counts"]).alias("share"))).alias("word_shares"))
    to_classes = F.transform("references", lambda r: js_distance(F.col("class_share"), r["classes"]))
    words_of = lambda r: F.get(F.filter("word_shares", lambda x: x["language"] == r["language"]), F.lit(0))["share"]
    to_words = F.transform("references", lambda r: js_distance(words_of(r), r["common"]))
    chars = F.aggregate("classes", F.lit(0.0), lambda s, x: s + x)
    return met.withColumn("class_distance", F.when(chars >= MIN_CHARS, F.array_min(to_classes))).withColumn("common_distance", F.when(F.col("n_words") >= MIN_COMMON_WORDS, F.array_min(to_words)))


def fences(measured: DataFrame) -> dict[int, float]:
    """Octave of n_words to the limit of the scaled word distance: by the binned distances of the reference documents, at most 1.5 * DISTANCE_BINS rows an octave."""
    binned = measured.where("lang is not null and not base_failed and common_distance is not null").groupBy("octave", F.floor(F.col("scaled") * DISTANCE_BINS).alias("bin")).count()
    per: dict[int, dict[int, int]] = {}
    for row in binned.collect():
        per.setdefault(row["octave"], {})[row["bin"]] = row["count"]
    out = {}
    for octave in per:
        pooled: dict[int, int] = {}
        # this octave, then shorter ones, then longer ones
        for other in sorted(per, key=lambda o: (o > octave, abs(o - octave))):
            for k, n in per[other].items():
                at = math.ceil(k * max(1.0, 2.0 ** ((other - octave) / 2)))  # longer texts lie nearer
                pooled[at] = pooled.get(at, 0) + n
            if sum(pooled.values()) >= LEAST_REFERENCES:
                break
        total = sum(pooled.values())
        if total < LEAST_REFERENCES:
            continue
        below, quartiles = 0, []
        for k in sorted(pooled):
            below += pooled[k]
            while len(quartiles) < 3 and 4 * below >= (len(quartiles) + 1) * total:
                quartiles.append((k + 1) / DISTANCE_BINS)
        out[octave] = quartiles[2] + FENCE * (quartiles[2] - quartiles[0])
    return out


def quality(docs: DataFrame, *, max_class_distance: float = MAX_CLASS_DISTANCE, max_common_distance: float | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, common_distance, kept. max_common_distance: in place of the references' fences."""
    counts = durable(features(docs, durable(common_words(docs), "words")), "features")
    octave = F.length(F.bin("n_words"))
    scaled = F.col("common_distance") * F.sqrt(F.col("n_words") / F.pow(F.lit(2.0), octave - 1))
    measured = durable(distances(counts).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", octave.alias("octave"), scaled.alias("scaled")), "measured")
    limits = fences(measured) if max_common_distance is None else {}
    limit = F.lit(math.inf)
    for octave in sorted(limits):
        # octaves without references take the limit of the next shorter one
        limit = F.when(F.col("octave") >= octave, F.lit(limits[octave])).otherwise(limit)
    far = F.col("scaled") > limit if max_common_distance is None else F.col("common_distance") > max_common_distance
    bad = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | F.coalesce(far, F.lit(False))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "class_distance", "common_distance")
