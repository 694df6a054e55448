import pytest

from themeloom.operators import inflection as inf
from themeloom.operators import lemmas as lem

# lemma: forms; 200 and more forms of regular verbs, adjectives and nouns
CHECKED = {
    "file": "files filed filing filings", "argue": "argues argued arguing", "decide": "decides decided deciding",
    "rule": "rules ruled ruling rulings", "hope": "hopes hoped hoping", "hop": "hops hopped hopping",
    "stop": "stops stopped stopping", "plan": "plans planned planning", "try": "tries tried trying",
    "deny": "denies denied denying", "apply": "applies applied applying", "carry": "carries carried carrying",
    "play": "plays played playing", "stay": "stays stayed staying", "appeal": "appeals appealed appealing",
    "grant": "grants granted granting", "remand": "remands remanded remanding", "claim": "claims claimed claiming",
    "agree": "agrees agreed agreeing", "free": "frees freed", "pass": "passes passed passing",
    "process": "processes processed processing", "access": "accesses accessed accessing", "call": "calls called calling",
    "fill": "fills filled filling", "control": "controls controlled controlling", "refer": "refers referred referring",
    "occur": "occurs occurred occurring", "admit": "admits admitted admitting", "commit": "commits committed committing",
    "permit": "permits permitted permitting", "limit": "limits limited limiting", "visit": "visits visited visiting",
    "order": "orders ordered ordering", "offer": "offers offered offering", "issue": "issues issued issuing",
    "use": "uses used using", "cause": "causes caused causing", "change": "changes changed changing",
    "judge": "judges judged judging", "charge": "charges charged charging", "force": "forces forced forcing",
    "place": "places placed placing", "require": "requires required requiring", "state": "states stated stating",
    "violate": "violates violated violating", "create": "creates created creating", "fix": "fixes fixed fixing",
    "tax": "taxes taxed taxing", "watch": "watches watched watching", "reach": "reaches reached reaching",
    "push": "pushes pushed pushing", "establish": "establishes established establishing", "jump": "jumps jumped jumping",
    "walk": "walks walked walking", "work": "works worked working", "talk": "talks talked talking", "tie": "tied",
    "large": "larger largest", "big": "bigger biggest", "happy": "happier happiest", "high": "higher highest",
    "late": "later latest", "early": "earlier earliest", "old": "older oldest", "strong": "stronger strongest",
    "box": "boxes", "party": "parties", "case": "cases", "bus": "buses", "leaf": "leaves", "elf": "elves",
    "move": "moves moved moving", "serve": "serves served serving", "leave": "leaving", "hold": "held holding",
}
STAY = "lawyer officer paper number under other water king thing morning evening building during hundred feed need interest".split()


def vocabulary(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_two_hundred_forms(spark):
    pairs = {form: lemma for lemma, forms in CHECKED.items() for form in forms.split()}
    assert len(pairs) >= 200
    words = dict.fromkeys([*CHECKED, *pairs, *STAY], 5)
    found = {r.form: r.lemma for r in inf.attested_forms(vocabulary(spark, words)).collect()}
    irregular = lem.irregular_forms()
    expected = pairs | {form: lemma for form, lemma in irregular.items() if form in pairs}
    assert {form: found.get(form, form) for form in pairs} == expected
    assert {word: found.get(word, word) for word in STAY} == {word: word for word in STAY}
    assert not {lemma: found[lemma] for lemma in CHECKED if lemma in found}


def test_the_more_frequent_stem_wins(spark):
    def lemma(**words):
        rows = inf.attested_forms(vocabulary(spark, words)).collect()
        return {r.form: r.lemma for r in rows}.get("planing", "planing")

    assert lemma(planing=1, plane=2, plan=9) == "plane"  # plan does not double its letter
    assert lemma(planing=1, plan=9) == "planing"
    assert lemma(planing=1) == "planing"
    rated = vocabulary(spark, {"barred": 1, "bar": 4, "barr": 9})
    assert {r.form: r.lemma for r in inf.attested_forms(rated).collect()}["barred"] == "barr"


def test_degrees_need_each_other(spark):
    one = {r.form: r.lemma for r in inf.attested_forms(vocabulary(spark, {"large": 1, "larger": 1, "law": 3, "lawer": 3})).collect()}
    assert "larger" not in one and "lawer" not in one
    two = {r.form: r.lemma for r in inf.attested_forms(vocabulary(spark, {"large": 1, "larger": 1, "largest": 2})).collect()}
    assert (two["larger"], two["largest"]) == ("large", "large")


def test_unattested_plurals_follow_the_rule(spark):
    found = {r.form: r.lemma for r in inf.attested_forms(vocabulary(spark, {"widgets": 1, "glass": 1, "filings": 1})).collect()}
    assert found["widgets"] == "widget" and found["filings"] == "filing" and "glass" not in found


@pytest.mark.parametrize("in_plan, broadcast", [(5_000, 5_000), (1, 5_000), (0, 0)])
def test_documents_by_their_own_words(spark, docs_of, tokens_of, monkeypatch, in_plan, broadcast):
    monkeypatch.setattr(lem, "IN_PLAN_FORMS", in_plan)
    monkeypatch.setattr(lem, "BROADCAST_FORMS", broadcast)
    docs = docs_of(["filed", "filing", "file", "children", "claims"], [], ["filed", "filed", "claim", "held"])
    out = tokens_of(inf.attested_lemmas(docs))
    assert out == {0: ["file", "file", "file", "child", "claim"], 1: [], 2: ["file", "file", "claim", "hold"]}


def test_no_documents(spark, docs_of, tokens_of):
    assert tokens_of(inf.attested_lemmas(docs_of(["a"]).limit(0))) == {}
