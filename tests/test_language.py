"""Lexer, parser and their inverses."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.lang import ast as A
from quillon.lang import parser as P
from quillon.lang import unparse as U

names = st.sampled_from(["a", "b", "Nav/c", "Nav/Deep/d"]).map(lambda s: A.Path(tuple(s.split("/"))))
lits = st.one_of(
    st.integers(-(2**31), 2**31 - 1).map(lambda v: A.Lit(v, "int")),
    st.integers(-(2**62), 2**62).map(lambda v: A.Lit(v, "long")),
    st.floats(allow_nan=False, allow_infinity=False).map(lambda v: A.Lit(v, "double")),
    st.text(max_size=8).map(lambda v: A.Lit(v, "string")),
    st.booleans().map(lambda v: A.Lit(v, "bool")),
    st.just(A.Lit(None, "null")),
    st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)).map(lambda v: A.Lit(v, "datetime")),
    st.timedeltas(dt.timedelta(0), dt.timedelta(9999)).map(lambda v: A.Lit(v, "duration")),
)
values = st.recursive(names | lits, lambda x: st.builds(A.Arith, st.sampled_from(["add", "sub", "mul", "div", "divby", "mod"]), x, x) | x.map(lambda v: A.Func("length", (v,))), max_leaves=4)
leaf = st.one_of(
    st.builds(A.Cmp, st.sampled_from(["eq", "ne", "gt", "ge", "lt", "le", "has"]), values, values),
    st.builds(A.In, names, st.lists(lits, min_size=1, max_size=3).map(tuple)),
    st.builds(lambda p, v: A.Func("contains", (p, v)), names, lits),
)
predicates = st.recursive(
    leaf,
    lambda x: st.lists(x, min_size=2, max_size=3).map(lambda i: A.And(tuple(i))) | st.lists(x, min_size=2, max_size=3).map(lambda i: A.Or(tuple(i))) | x.map(A.Not) | st.builds(lambda k, p: A.Quant(("Nav",), k, "o", p), st.sampled_from(["any", "all"]), x),
    max_leaves=6,
)




@settings(max_examples=150, deadline=None)
@given(predicates)
def test_filter_round_trip(e):
    text = U.text(e)
    again = P.parse_filter(text)
    assert P.parse_filter(U.text(again)) == again
    assert U.text(again) == text


@pytest.mark.parametrize(
    "url",
    [
        "/Orders?$filter=a eq 1 and b ne 'it''s'&$select=a,b,Nav/c&$orderby=a desc,length(b)&$top=5&$skip=2&$count=true",
        "/Orders(5)/Lines?$expand=Nav($filter=x gt 1;$orderby=y desc;$top=3;$expand=Deep($select=z)),Other/$ref",
        "/Set(k1=1,k2='x')/Nav?groupby=(a,Nav/b,rollup(c,d))&aggregate=x with sum as s,(y with max) divby (z with min) as r,* with count as n&having=s gt 3",
        "/Set?compute=a mul 2 as b&where=b gt 1&shard=1,2&user=me&concurrency=true&@p='v'&mine=yes",
        "/Set?aggregate=x with sum as t from y with max&shard=all",
    ],
)
def test_url_and_xml_round_trip(url):
    q = P.parse_url(url)
    assert P.parse_url(U.url(q)) == q
    assert U.from_xml(U.to_xml(q)) == q


def test_precedence():
    assert P.parse_filter("a eq 1 and b eq 2 or c eq 3 and d eq 4") == A.Or((P.parse_filter("a eq 1 and b eq 2"), P.parse_filter("c eq 3 and d eq 4")))
    assert P.parse_filter("1 add 2 mul 3 eq 7") == A.Cmp("eq", A.Arith("add", A.Lit(1, "int"), A.Arith("mul", A.Lit(2, "int"), A.Lit(3, "int"))), A.Lit(7, "int"))
    assert P.parse_filter("not a eq 1 or b eq 2") == A.Or((A.Not(P.parse_filter("a eq 1")), P.parse_filter("b eq 2")))


def test_literals():
    kinds = {"5": "int", "5L": "long", "5000000000": "long", "1.5": "double", "1.5m": "decimal", "true": "bool", "null": "null", "'null'": "string", "2020-01-02": "datetime", "2020-01-02T03:04:05Z": "datetimeoffset", "duration'PT5M'": "duration", "Ns.E'A,B'": "enum", "01234567-89ab-cdef-0123-456789abcdef": "guid", "0xDEAD": "binary"}
    for text, kind in kinds.items():
        assert P.parse_filter(f"a eq {text}").right.kind == kind, text


def test_quantifier_against_boolean():
    any_ = P.parse_filter("Nav/any(o: o/x eq 1)")
    assert P.parse_filter("Nav/any(o: o/x eq 1) eq true") == any_
    assert P.parse_filter("Nav/any(o: o/x eq 1) eq false") == A.Not(any_)


@pytest.mark.parametrize("url", ["/S?$filter=a eq", "/S?$top=x", "/S?$filter=a = 1", "/S?compute=a as b&groupby=(a)", "/S?$filter=(a eq 1", "/S?aggregate=x with nothing as y", "/S?$top=1&$top=2", "/S?$expand=Nav($levels=max)", "/S?$filter=Nav/all()", "/S?$apply=nothing(a)"])
def test_errors(url):
    with pytest.raises(P.QuerySyntaxError):
        P.parse_url(url)


def test_helpers():
    e = P.parse_filter("a eq 1 and (b in (2,3) or a eq 4) and not c gt 5")
    assert A.comparisons(e, "a") == [1, 4]
    assert A.name_values(e) == {"a": [1, 4], "b": [2, 3]}
    assert len(A.flatten(e)) == 4
