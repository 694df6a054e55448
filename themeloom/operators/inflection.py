"""Regular inflection undone by evidence: a stem counts only if the corpus itself has it as a word.

Each word of the vocabulary proposes stems for its ending; the stems are looked up in the same vocabulary,
and the most frequent one that occurs wins. The vocabulary is a distributed table of words and counts, so
that the lookup is one join on words, which are unique there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators import lemmas
from themeloom.staging import stage

SHORTEST_STEM = 3
# Words whose last letters look like an ending but are none.
UNINFLECTED = """
anything beijing blessed bleed breed building ceiling conquest contest creed deed during earring embed evening
everything exceed feed forest greed guest harvest heed hundred indeed interest kindred manifest meeting modest morning
naked need nothing offspring overseas priest proceed pudding quest reed request sacred seed sibling something speed
spring sterling string succeed suggest wedding weed wicked wretched
""".split()
# Fixed value: stems of one short vowel and one consonant, which is doubled before an ending.
DOUBLING = "^[^aeiouy]*[aeiou][^aeiouwxy]$"
NO_STEMS = "array<struct<stem:string,rank:int>>"


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each token occurs; counts combine before the shuffle."""
    words = docs.select(F.explode("tokens").alias("word")).where("word IS NOT NULL")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _cut(word: str, letters: int) -> Column:
    return F.expr(f"left({word}, length({word}) - {letters})")


def _stems(*stems: Column) -> Column:
    """The stems with their rank; those too short or without a vowel become null."""
    found = []
    for rank, stem in enumerate(stems):
        sound = (F.length(stem) >= SHORTEST_STEM) & stem.rlike("[aeiouy]")
        found.append(F.when(sound, F.struct(stem.alias("stem"), F.lit(rank).alias("rank"))))
    return F.array(*found)


def _undoubled(word: str, letters: int) -> Column:
    """The word without so many last letters and without the second of two equal letters before them."""
    stem = _cut(word, letters)
    return F.when(F.right(stem, F.lit(1)) == F.expr(f"substring({word}, length({word}) - {letters + 1}, 1)"), _cut(word, letters + 1))


def _open_stems(word: str, letters: int, silent: Column) -> Column:
    """For an ending of so many letters: with a silent e, as it stands, and without a doubled letter.

    A short stem such as hop doubles its letter, so hoping cannot be its form.
    """
    plain = _cut(word, letters)
    return _stems(silent, F.when(~plain.rlike(DOUBLING), plain), _undoubled(word, letters))


def plural_stems(word: str) -> Column:
    """What a word in -s may be the plural or third person of."""
    w = F.col(word)
    regular = ~F.right(w, F.lit(2)).isin("ss", "us", "is") & w.endswith("s")
    return (
        F.when(~regular, F.array().cast(NO_STEMS))
        .when(w.endswith("ies"), _stems(F.concat(_cut(word, 3), F.lit("y")), _cut(word, 1)))
        .when(w.endswith("ves"), _stems(_cut(word, 1), F.concat(_cut(word, 3), F.lit("f")), F.concat(_cut(word, 3), F.lit("fe"))))
        .when(w.endswith("es"), _stems(_cut(word, 1), _cut(word, 2)))
        .otherwise(_stems(_cut(word, 1)))
    )


def inflected_stems(word: str) -> Column:
    """What a word in -ed, -ing, -er or -est may be a form of."""
    w = F.col(word)
    y = F.lit("y")
    return (
        F.when(w.isin(UNINFLECTED), F.array().cast(NO_STEMS))
        .when(w.endswith("ied"), _stems(F.concat(_cut(word, 3), y), _cut(word, 1)))
        .when(w.endswith("eed"), F.when(F.length(w) > 4, _stems(_cut(word, 1))).otherwise(F.array().cast(NO_STEMS)))
        .when(w.endswith("ed"), _open_stems(word, 2, _cut(word, 1)))
        .when(w.endswith("ing"), _open_stems(word, 3, F.concat(_cut(word, 3), F.lit("e"))))
        .when(w.endswith("iest"), _stems(F.concat(_cut(word, 4), y)))
        .when(w.endswith("est"), _open_stems(word, 3, _cut(word, 2)))
        .when(w.endswith("ier"), _stems(F.concat(_cut(word, 3), y)))
        .when(w.endswith("er"), _open_stems(word, 2, _cut(word, 1)))
        .otherwise(F.array().cast(NO_STEMS))
    )


def _partner(word: str) -> Column:
    """The other degree of comparison, which a word in -er or -est needs: agents such as lawyer have none."""
    return F.when(F.col(word).endswith("est"), F.concat(_cut(word, 3), F.lit("er"))).when(
        F.col(word).endswith("er"), F.concat(_cut(word, 2), F.lit("est"))
    )


def _best_stems(words: DataFrame, stems: Column, vocabulary: DataFrame) -> DataFrame:
    """``word, stem``: of the stems that occur the most frequent one, of equals the one named first."""
    proposed = words.select("word", F.explode(F.filter(stems, lambda s: s.isNotNull())).alias("one"))
    proposed = proposed.select("word", F.col("one.stem").alias("stem"), F.col("one.rank").alias("rank"))
    known = vocabulary.select(F.col("word").alias("stem"), "n")
    best = F.max_by("stem", F.struct("n", -F.col("rank")))
    return proposed.join(known, "stem").groupBy("word").agg(best.alias("stem"))


def attested_forms(vocabulary: DataFrame) -> DataFrame:
    """``form, lemma`` of the words of a vocabulary ``word, n`` whose lemma the corpus attests.

    First an -s ending is undone: the most frequent stem that occurs, else the regular rule. What is left
    loses -ed, -ing, -er or -est if one of its stems occurs: with a silent e, as it stands, without a doubled
    letter, or with y for i. -er and -est also need each other, so that ``larger`` becomes ``large`` and
    ``lawyer`` stays. Irregular forms come first and are final. Only words that change are listed, a null word
    never is; the size is at most that of the vocabulary.
    """
    irregular = lemmas.irregular_forms()
    table = vocabulary.where(~F.col("word").isin(list(irregular)))
    singular = _best_stems(table.where(F.col("word").endswith("s")), plural_stems("word"), vocabulary)
    base = F.coalesce("stem", F.expr(lemmas.regular_lemma("word")))
    bases = table.select("word").join(singular, "word", "left").select(F.col("word").alias("form"), base.alias("word"))
    bases = stage(bases, "lemma-bases")
    ends = reduce(Column.__or__, (F.col("word").endswith(end) for end in ("ed", "ing", "er", "est")))
    inflected = bases.select("word").where(ends).distinct()
    compared = _partner("word")
    partners = vocabulary.select(F.col("word").alias("partner"))
    plain = inflected.where(compared.isNull())
    degrees = inflected.where(compared.isNotNull()).withColumn("partner", compared).join(partners, "partner", "left_semi").select("word")
    stems = _best_stems(plain.unionByName(degrees), inflected_stems("word"), vocabulary)
    found = bases.join(stems, "word", "left").select("form", F.coalesce("stem", "word").alias("lemma"))
    known = [(form, lemma) for form, lemma in irregular.items()]
    fixed = vocabulary.sparkSession.createDataFrame(known, "form string, lemma string")
    return found.where("form <> lemma").unionByName(fixed)


def attested_lemmas(docs: DataFrame) -> DataFrame:
    """Replace each token by the lemma that the documents themselves attest, in place and in order.

    ``docs`` holds its key and tokens. It is staged, since it is read twice: for its vocabulary, and for
    the replacement, which moves no token while the table of changed forms fits to each executor.
    """
    docs = stage(docs, "lemma-tokens")
    forms = stage(attested_forms(stage(vocabulary_of(docs), "lemma-vocabulary")), "lemma-forms")
    return lemmas.lemmatised(docs, forms, regular=False)
