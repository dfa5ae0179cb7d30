import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomtext.functions.analyze import RAW
from loomtext.operators import index as ix
from loomtext.operators import search
from loomtext.plans.query import And, Not, Or, Phrase, Term, holds_without_terms, parse, rewrite, words_of


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ('"a" "b"', 'Term("a")'),
        ('"a" NOT "b"', 'Term("a")'),
        ('NOT NOT "a"', 'NOT(Term("a"))'),
        ('"a" AND NOT NOT "b"', '(NOT(Term("a")) AND NOT(Term("b")))'),
        ('"a" AND', 'Term("a")'),
        ('"a" and "b"', 'Term("a")'),
        ("foo", 'Term("")'),
        ("", 'Term("")'),
        ('BAND "x"', 'Term("x")'),
        ('"" AND "x"', 'Term("AND")'),
        ('"a" OR "b" AND "c"', '(Term("a") OR (Term("b") AND Term("c")))'),
        ('("a" OR "b") AND "c"', '((Term("a") OR Term("b")) AND Term("c"))'),
        ('"a" OR "b" OR "c"', '((Term("a") OR Term("b")) OR Term("c"))'),
        ('"a b  c"', "Phrase(['a', 'b', 'c'])"),
        ('" "', 'Term("")'),
        ('("a" AND "b"', '(Term("a") AND Term("b"))'),
        ('"a") OR "b"', '(Term("a") OR Term("b"))'),
    ],
)
def test_parse(query, tree):
    assert repr(parse(query)) == tree


def test_rewrite_drops_words_without_terms():
    assert rewrite(parse('"state of art"'), {"state": ["state"], "of": [], "art": ["art"]}) == Phrase(("state", "art"))
    assert rewrite(parse('"the"'), {"the": []}) == Term("")


DOCS = {"d1": "a b c a", "d2": "b a", "d3": "", "d4": "c c b", "d10": "a b b a c", "d5": None}

leaf = st.one_of(st.sampled_from("abcz").map(Term), st.lists(st.sampled_from("abc"), min_size=2, max_size=3).map(lambda w: Phrase(tuple(w))), st.just(Term("")))
trees = st.recursive(leaf, lambda x: st.one_of(x.map(Not), st.tuples(x, x).map(lambda p: And(*p)), st.tuples(x, x).map(lambda p: Or(*p))), max_leaves=5)


def naive(tree):
    match tree:
        case Not(c):
            return set(DOCS) - naive(c)
        case And(a, b):
            return naive(a) & naive(b)
        case Or(a, b):
            return naive(a) | naive(b)
        case Phrase(w):
            n = len(w)
            return {d for d, t in DOCS.items() if any(tuple((t or "").split()[i : i + n]) == w for i in range(len((t or "").split())))}
    return {d for d, t in DOCS.items() if tree.word and tree.word in (t or "").split()}


@pytest.fixture(scope="module")
def small(spark):
    built = ix.build(spark.createDataFrame(list(DOCS.items()), "doc_id string, content string"), RAW).persist()
    built.postings.count()
    return built


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_single_pass_equals_set_algebra(small, tree):
    assert {r[0] for r in search.matching(small, tree).collect()} == naive(tree)
    assert holds_without_terms(tree) == ("d3" in naive(tree))
    assert all(words_of(tree))


def test_positions_are_read_only_for_phrases(small, spark, tmp_path):
    small.postings.write.parquet(f"{tmp_path}/p")
    stored = ix.Index(spark.read.parquet(f"{tmp_path}/p"), small.term_stats, small.doc_catalog, RAW)
    plan = search.boolean_search(stored, '"a" AND "b"')._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan.split("ReadSchema")[1]
    assert "In(term, [a,b])" in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    plan = search.boolean_search(stored, '"a b"')._jdf.queryExecution().executedPlan().toString()
    assert "positions" in plan.split("ReadSchema")[1]
