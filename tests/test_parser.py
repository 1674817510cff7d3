import pytest

from wayfind.plans.query_parser import Parser, edits_allowed, osa_distance

PT, EN = Parser(("pt", "en")), Parser(("en",))


def test_misspelled_aliases_and_ranges():
    p = PT.parse_normal("trtor jon dere entre 200 e 300 cv por menos de 150 mil")
    assert [(c["value"], round(c["confidence"], 4)) for c in p.concepts] == [("TRACTORS*", 0.8333), ("JOHNDEERE", 0.8)]
    assert [(c["quantity"], c["low"] and round(c["low"], 3), c["high"] and round(c["high"], 3)) for c in p.constraints] == [("power", 147.1, 220.65), ("money", None, 150000)]
    assert p.terms == []


@pytest.mark.parametrize(
    "parser, token, value",
    [(PT, "1.2.3.4.5", 1234.5), (EN, "40,000", 40000), (PT, "40,000", 40), (EN, "1.234.567", 1234.567), (EN, "1,234,56", 1234.56), (EN, "1,23,456", None), (EN, "abc", None), (EN, ".5", None), (EN, "5.", None)],
)
def test_numbers(parser, token, value):
    assert parser.number_value(token) == value


def test_number_without_unit():
    assert EN.parse_normal("over 900 thing").warnings == ["number without unit dropped"]
    assert EN.parse_normal("over 1000").constraints[0]["quantity"] == "money"
    assert EN.parse_normal("over 2 k").constraints[0]["quantity"] == "money"
    assert EN.parse_normal("150 thousand").constraints == []


def test_context_takes_the_rest():
    p = PT.parse_normal("carreta para o fendt 200 cv")
    assert (p.context, p.target, p.constraints) == ("query", ["fendt", "200", "cv"], [])
    assert EN.parse_normal("trailer compatible with this tractor").context == "selected"


def test_osa_against_its_definition():
    assert osa_distance(b"tratro", b"trator") == 1 and osa_distance(b"ca", b"abc") == 3 and osa_distance(b"", b"abc") == 3
    assert [edits_allowed(n) for n in (3, 4, 5, 6, 9, 10)] == [0, 1, 1, 2, 2, 3]


def test_every_token_is_accounted_for():
    import random

    rng, words = random.Random(5), "blue 200 cv over tractor jon dere e entre 5 k the xyzzy r$ 3".split()
    for _ in range(500):
        tokens = rng.choices(words, k=rng.randrange(1, 9))
        p = PT.parse_normal(" ".join(tokens))
        used = len(p.terms) + sum(c["words"] for c in p.concepts)
        assert used <= len(tokens) and all(c["quantity"] for c in p.constraints)
