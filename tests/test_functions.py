"""Properties and edge cases of scalar functions, matching and rules against plain Python."""

import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import arabic, text
from wordloom.operators import matching, mining, rules, terms


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


@pytest.mark.parametrize("level", arabic.LEVELS)
def test_normalize_levels(spark, level):
    words = ["كِتَابٌ", "آمَن أحمد إلى ٱلبيت", "مدرسة مؤمن قائل", "كـــتاب", "abc", "", "   ", "٠١٢٣"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "t string")
    once = df.select(arabic.normalize(F.col("t"), level).alias("t"))
    again = once.select(arabic.normalize(F.col("t"), level).alias("t"))
    assert [r.t for r in once.collect()] == [r.t for r in again.collect()]
    assert not any(set(arabic.MARKS) & set(r.t) for r in once.collect())


def test_normalize_values(spark):
    get = lambda t, *a: _one(spark, arabic.normalize(F.col("t"), *a), t)
    assert get("آأإٱ ى", "medium") == "اااا ي"
    assert get("ة ؤ ئ ء", "aggressive") == "ه و ي ء"
    assert get("ة ؤ ئ", "light") == "ة ؤ ئ"
    assert get("١٢3", "light", "western") == "123"
    assert get("12٣", "light", "arabic_indic") == "١٢٣"
    assert get(None, "light") == ""
    assert get("ٓٔٙ", "light") == "ٓٔ"
    with pytest.raises(ValueError):
        arabic.normalize(F.col("t"), "heavy")


def test_ratio(spark):
    get = lambda t: _one(spark, arabic.arabic_char_ratio(F.col("t")), t)
    assert get("كتاب") == 1.0 and get("book") == 0.0 and get("123 !") == 0.0 and get("") == 0.0
    assert 0 < get("كتاب book") < 1


def test_unicode_strip(spark):
    assert _one(spark, text.strip(F.col("t")), "\t  x y \n ") == "x y"


def test_html_unescape(spark):
    texts = ["&lt;p&gt; &eacute;&#233;&#xe9; &amp;lt; &nbsp;x &unknown; &", None, ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.html_unescape("t").alias("t")).collect()]
    assert got == [html.unescape(t) if t is not None else None for t in texts]


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT normalize_aggressive('مدرسةٌ') AS t").first().t == "مدرسه"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab c", max_size=30), min_size=1, max_size=8), st.lists(st.text("abc ", min_size=0, max_size=5), max_size=5))
def test_matches_like_brute_force(spark, texts, patterns):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, m, m + len(p), p) for i, t in enumerate(texts) for p in patterns if p for m in range(len(t)) if t.startswith(p, m))
    assert sorted(map(tuple, matching.match_all(docs, patterns).collect())) == want
    assert sorted(map(tuple, matching.match_automaton(docs, patterns).collect())) == want
    first = {i: min((x for x in want if x[0] == i), key=lambda x: (x[2], x[1])) for i, *_ in want}
    assert sorted(map(tuple, matching.first_match(matching.match_automaton(docs, patterns)).collect())) == sorted(first.values())


def test_whole_phrase(spark):
    docs = spark.createDataFrame([(0, "cafés and café!"), (1, "C++ and C++x"), (2, "the_and the and")], "doc_id long, text string")
    got = {(r.doc_id, r.phrase) for r in matching.phrase_hits(docs, ["café", "C++", "the and", ""]).collect()}
    assert got == {(0, "café"), (1, "C++"), (2, "the and")}


def test_long_phrases_join(spark):
    nine = "a b c d e f g h i"
    docs = spark.createDataFrame([(1, f"x {nine}. y")], "doc_id long, text string")
    phrases = spark.createDataFrame([(nine,), ("c d",), (None,)], "phrase string")
    assert {r.phrase for r in matching.phrase_join(docs, phrases).collect()} == {nine, "c d"}
    with pytest.raises(Exception, match="more than 3 words"):
        matching.phrase_join(docs, phrases, longest=3).collect()


def test_contexts_from_all_documents(spark):
    docs = spark.createDataFrame([(i, "before term after") for i in (5000, 300, 7, 9000)], "doc_id long, text string")
    terms_ = spark.createDataFrame([("term",)], "term string")
    assert sorted(r.doc_id for r in mining.contexts(docs, terms_).collect()) == [7, 300, 5000]
    assert [r.doc_id for r in mining.contexts(docs, terms_, first_docs=200).collect()] == [7]


def test_contexts_are_ranked_without_their_texts(spark):
    docs, terms_ = spark.createDataFrame([(1, "a term")], "doc_id long, text string"), spark.createDataFrame([("term",)], "term string")
    plan = mining.contexts(docs, terms_)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "plain" not in plan[: plan.index("Window")]


def test_substitution_is_leftmost_longest(spark):
    swaps = {"a": "1", "ab": "2", "abc": "3", "c": ""}
    for t in ("abcab", "xacabx", "", "ccc", "zz"):
        keys = sorted(swaps, key=len, reverse=True)
        assert _one(spark, matching.substitute(F.col("t"), swaps), t) == re.sub("|".join(keys), lambda m: swaps[m[0]], t)


def test_rotation(spark):
    assert _one(spark, rules.rotate(F.col("t"), "said", ["A", "B"]), "he said she said, they said: unsaid") == "he A she B, they A: unsaid"
    assert _one(spark, rules.rotate(F.col("t"), "said", ["A", "B"]), "none") == "none"


def test_registers():
    assert rules.applies("applies_calque_dictionary", "news") and rules.applies("calque_dictionary", "opinion") and not rules.applies("calque_dictionary", "classical")
    assert not rules.applies("unheard", "news")
    with pytest.raises(rules.UnknownRegisterError):
        rules.applies("calque_dictionary", "nowhere")


def test_gates_are_near_their_probability(spark):
    for gate in (rules.gate(F.col("id"), 3, 0.7), rules.hashed_gate(F.col("id"), 3, F.lit(1), 0.7)):
        n = spark.range(10_000).filter(gate).count()
        assert 6500 < n < 7500


def test_typography_order(spark):
    got = _one(spark, rules.typography(F.col("t"), "news"), "كـتب text ,قال ( نعم ) ، لأن الوقت")
    assert "ـ" not in got and "( " not in got and " )" not in got


def test_proposals_without_retry(spark):
    df = spark.createDataFrame([('{"x": [{"ar":"a"}]}',), ('say [{"ar":"a"}]',)], "response string")
    sizes = lambda retry: [r.n for r in terms.proposals_of(df, retry=retry).select(F.size("proposals").alias("n")).collect()]
    assert sizes(True) == [1, 1] and sizes(False) == [0, 1]


def test_candidate_rules(spark):
    stop = ["من", "هذا"]
    words = {"كتاب": True, "من": False, "ال": False, "المن": False, "الكتاب": True, "هذا": False}
    listed = F.array(*map(F.lit, stop))
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem_is_term(F.col("w"), listed).alias("ok"))
    assert {r.w: r.ok for r in df.collect()} == words


def test_random_ngrams(spark):
    random.seed(0)
    rows = [(i, [random.choice("xyz") for _ in range(random.randrange(6))]) for i in range(20)]
    got = spark.createDataFrame(rows, "id long, k array<string>").select("id", F.explode(text.ngrams(F.col("k"))).alias("g")).select("id", "g.*").collect()
    want = sorted((i, n, p + 1, " ".join(k[p : p + n])) for i, k in rows for n in (1, 2, 3) for p in range(len(k) - n + 1))
    assert sorted(map(tuple, got)) == want
