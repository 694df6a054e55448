"""Lemmas by table and by rule, and a hook for a user's own lemmatiser."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.text import sql_list
from themeloom.operators.joins import looked_up, salted_join
from themeloom.staging import stage

# Irregular English forms, given as lemma: surface forms.
IRREGULAR = {
    "bad": "worse worst", "begin": "began begun", "bind": "bound", "break": "broke broken",
    "bring": "brought", "build": "built", "buy": "bought", "catch": "caught", "child": "children",
    "choose": "chose chosen", "come": "came", "deal": "dealt", "draw": "drew drawn",
    "drive": "drove driven", "eat": "ate eaten", "fall": "fell fallen", "feel": "felt",
    "fight": "fought", "find": "found", "flee": "fled", "foot": "feet", "forbid": "forbade forbidden",
    "forget": "forgot forgotten", "get": "got gotten", "give": "gave given", "go": "went gone goes",
    "good": "better best", "grow": "grew grown", "half": "halves", "hear": "heard", "hide": "hid hidden",
    "hold": "held", "keep": "kept", "knife": "knives", "know": "knew known", "lay": "laid",
    "lead": "led", "leaf": "leaves", "leave": "left", "lend": "lent", "life": "lives", "lose": "lost",
    "make": "made", "man": "men", "mean": "meant", "meet": "met", "mouse": "mice", "pay": "paid",
    "person": "people", "rise": "rose risen", "run": "ran", "say": "said", "see": "saw seen",
    "seek": "sought", "sell": "sold", "send": "sent", "shelf": "shelves", "shoot": "shot",
    "show": "shown", "sit": "sat", "speak": "spoke spoken", "spend": "spent", "stand": "stood",
    "steal": "stole stolen", "swear": "swore sworn", "take": "took taken", "teach": "taught",
    "tell": "told", "think": "thought", "throw": "threw thrown", "tooth": "teeth",
    "understand": "understood", "wear": "wore worn", "wife": "wives", "win": "won",
    "withdraw": "withdrew withdrawn", "withhold": "withheld", "woman": "women",
    "write": "wrote written",
    "analysis": "analyses", "basis": "bases", "crisis": "crises", "hypothesis": "hypotheses", "thesis": "theses",
    "diagnosis": "diagnoses", "index": "indices", "appendix": "appendices", "matrix": "matrices", "vertex": "vertices",
    "criterion": "criteria", "phenomenon": "phenomena", "datum": "data", "wolf": "wolves", "thief": "thieves",
    "calf": "calves", "loaf": "loaves", "ox": "oxen", "goose": "geese", "die": "dying dies", "lie": "lying lies",
    "tie": "tying ties", "quiz": "quizzes",
}

# Words that end in -s and are their own lemma.
INVARIANT = """
series species news always perhaps besides afterwards towards hence thus alias atlas bias canvas christmas gas
texas kansas arkansas dallas vegas thomas james charles jones williams davis harris lewis morris nicholas douglas
lucas marcus brussels athens paris wales physics mathematics economics politics ethics statistics athletics
headquarters means premises proceeds
""".split()
# Words in -uses and -oes whose singular keeps the e.
KEEP_E = ("uses", "abuses", "accuses", "amuses", "excuses", "fuses", "muses", "refuses", "reuses", "misuses",
          "confuses", "infuses", "diffuses", "toes", "shoes", "foes", "woes", "canoes", "does")
IN_PLAN_FORMS = 1_000
BROADCAST_FORMS = 2_000_000


def irregular_forms() -> dict[str, str]:
    """Surface form -> lemma; words that never change are their own lemma."""
    irregular = {form: lemma for lemma, forms in IRREGULAR.items() for form in forms.split()}
    return irregular | {word: word for word in INVARIANT}


def regular_lemma(token: str) -> str:
    """SQL expression that undoes a regular English -s ending; other words stay as they are."""
    return f"""CASE
        WHEN {token} LIKE '%ies' AND length({token}) > 4
            THEN concat(substring({token}, 1, length({token}) - 3), 'y')
        WHEN (right({token}, 4) IN ('sses', 'shes', 'ches', 'uses') OR right({token}, 3) IN ('xes', 'oes'))
            AND length({token}) > 4 AND right({token}, 5) NOT IN ('auses', 'ouses') AND {token} NOT IN ({sql_list(KEEP_E)})
            THEN substring({token}, 1, length({token}) - 2)
        WHEN {token} LIKE '%s' AND right({token}, 2) NOT IN ('ss', 'us', 'is') AND length({token}) > 3
            THEN substring({token}, 1, length({token}) - 1)
        ELSE {token} END"""


def lemmatised(
    docs: DataFrame, forms: Mapping[str, str] | DataFrame | None = None, regular: bool = True
) -> DataFrame:
    """Replace each token by its lemma, in place and in order. ``docs`` holds its key and tokens.

    ``forms`` maps surface forms to lemmas: a mapping, or a table ``form, lemma``; of several lemmas of a
    form the least counts. By default the built-in irregular forms apply. Tokens not found there get ``regular_lemma``
    unless switched off.
    """
    if forms is None:
        forms = irregular_forms()
    if isinstance(forms, DataFrame):
        return _lemmatised_by_table(docs, forms, regular)
    if len(forms) > IN_PLAN_FORMS:
        table = docs.sparkSession.createDataFrame(
            pd.DataFrame({"form": list(forms), "lemma": list(forms.values())})
        )
        return _lemmatised_by_table(docs, table, regular)

    lemma = regular_lemma("token") if regular else "token"
    if forms:
        # The hashed membership test runs for every token, the map lookup for the few irregular ones.
        pairs = sql_list(part for pair in sorted(forms.items()) for part in pair)
        known = f"token IN ({sql_list(sorted(forms))})"
        lemma = f"CASE WHEN {known} THEN element_at(map({pairs}), token) ELSE {lemma} END"
    return docs.withColumn("tokens", F.expr(f"transform(tokens, token -> {lemma})"))


def _lemmatised_by_table(docs: DataFrame, table: DataFrame, regular: bool) -> DataFrame:
    """Use a table of any size. Of a large one only the forms that occur in the corpus matter."""
    table = table.groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("value")).where("word IS NOT NULL AND value IS NOT NULL")
    size = table.count()
    if size > BROADCAST_FORMS:
        vocabulary = docs.select(F.explode("tokens").alias("word")).distinct()
        table = stage(table.join(vocabulary, "word", "left_semi"), "forms")
        size = table.count()
    if size > BROADCAST_FORMS:
        return _lemmatised_by_join(docs, table, regular)
    rows = table.toArrow()
    if size <= IN_PLAN_FORMS:
        forms = dict(zip(rows["word"].to_pylist(), rows["value"].to_pylist()))
        return lemmatised(docs, forms, regular)
    lemma = f"coalesce(lemma, {regular_lemma('token') if regular else 'token'})"
    return (
        looked_up(docs, "tokens", rows, "_lemmas")
        .withColumn("tokens", F.expr(f"zip_with(tokens, _lemmas, (token, lemma) -> {lemma})"))
        .drop("_lemmas")
    )


def _lemmatised_by_join(docs: DataFrame, table: DataFrame, regular: bool) -> DataFrame:
    """Shuffle join for a table too large for every executor; tokens are put back in order."""
    names, key = docs.columns, [name for name in docs.columns if name != "tokens"]
    # rows may share their key, so each has a number of its own, fixed by writing it
    docs = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "lemma-rows")
    words = docs.select("_row", *key, F.posexplode_outer("tokens").alias("pos", "word"))
    rule = F.expr(regular_lemma("word")) if regular else F.col("word")
    placed = salted_join(words, table, "word", ["_row"], "left").select(
        "_row", *key, F.struct("pos", F.coalesce("value", rule).alias("token")).alias("placed")
    )
    ordered = F.filter(F.sort_array(F.collect_list("placed")), lambda p: p["pos"].isNotNull())
    merged = placed.groupBy("_row", *key).agg(F.transform(ordered, lambda p: p["token"]).alias("tokens"))
    return merged.select(*names)


def lemmatised_by(docs: DataFrame, make_worker: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Run a user's own lemmatiser on each token list.

    ``make_worker`` runs once per Spark task, so a language model loads once and serves all batches.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = make_worker()
        for batch in batches:
            yield batch.map(lambda tokens: list(worker(list(tokens))))

    return docs.withColumn("tokens", run("tokens"))


def table_worker() -> Callable[[list[str]], list[str]]:
    """The built-in table and rule as a plain Python worker for ``lemmatised_by``."""
    forms = irregular_forms()

    def lemma(token: str) -> str:
        if token in forms:
            return forms[token]
        if token.endswith("ies") and len(token) > 4:
            return token[:-3] + "y"
        es = token.endswith(("sses", "shes", "ches", "uses", "xes", "oes")) and len(token) > 4
        if es and not token.endswith(("auses", "ouses")) and token not in KEEP_E:
            return token[:-2]
        if token.endswith("s") and token[-2:] not in ("ss", "us", "is") and len(token) > 3:
            return token[:-1]
        return token

    return lambda tokens: [lemma(token) for token in tokens]
