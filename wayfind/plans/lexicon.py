"""Vocabulary of the query language by locale, in normalised spelling. Earlier locales win where they differ."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words, their meanings and the factors of units.
BRANDS = """
JOHNDEERE: john deere, jd, deere, jhon deere
NEWHOLLAND: new holland, nh
CASEIH: case ih, case
MASSEYFERGUSON: massey ferguson, massey, mf
FENDT: fendt
CLAAS: claas
VALTRA: valtra
KUHN: kuhn
HORSCH: horsch
AMAZONE: amazone
LEMKEN: lemken
KRONE: krone
VADERSTAD: vaderstad
JACTO: jacto
STARA: stara
BALDAN: baldan
JAN: jan
TATU: tatu
KVERNELAND: kverneland
POTTINGER: pottinger
"""
ALIASES = {
    "en": """
category TRACTORS*: tractor, tractors
category SPRAYERS*: sprayer, sprayers, self propelled sprayer
category SEEDERS*: seeder, seeders
category PLANTERS*: planter, planters
category TRAILERS*: trailer, trailers, cart
category HARVESTERS*: harvester, harvesters, combine
category BALERS*: baler, balers
category CULTIVATORS*: cultivator, disc harrow
category PLOWS*: plow, plough
category SUBSOILERS*: subsoiler
category WHEELLOADERS*: wheel loader, loader
category TELELOADERS*: telehandler
category TRUCKS*: truck, trucks
species PLACEABLE: placeable, construction
origin dlc: dlc, expansion
origin mod: mod, mods
origin base: base, vanilla
""",
    "pt": """
category TRACTORS*: trator, tratores, trator agricola
category SPRAYERS*: pulverizador, pulverizadores, autopropelido
category SEEDERS*: semeadeira, semeadeiras, semeadora
category PLANTERS*: plantadeira, plantadeiras
category TRAILERS*: reboque, reboques, carreta, carretas, trailer
category HARVESTERS*: colheitadeira, colheitadeiras, colhedora, ceifadeira
category BALERS*: enfardadeira, enfardadeiras
category CULTIVATORS*: grade, grades
category PLOWS*: arado, arados
category SUBSOILERS*: subsolador, subsoladores
category WHEELLOADERS*: pa carregadeira, carregadeira
category TELELOADERS*: telescopica, carregadeira telescopica
category TRUCKS*: caminhao, caminhoes
species PLACEABLE: construcao, construcoes, placeable
origin dlc: dlc, expansao
origin mod: mod, mods
origin base: original, base
""",
    "de": """
category TRACTORS*: traktor, schlepper, traktoren
category SPRAYERS*: spritze, feldspritze
category TRAILERS*: anhanger, anhaenger
category HARVESTERS*: mahdrescher, maehdrescher
category BALERS*: ballenpresse
origin dlc: dlc, erweiterung
origin mod: mod, mods
origin base: original, basisspiel
""",
    "fr": """
category TRACTORS*: tracteur, tracteurs
category SPRAYERS*: pulverisateur
category TRAILERS*: remorque, remorques
category HARVESTERS*: moissonneuse
category BALERS*: presse a balles
origin dlc: dlc, extension
origin mod: mod, mods
origin base: original, base
""",
}
COMPARATORS = {
    "en": "gt: over, more than, above, greater than; gte: at least, from; lt: under, below, less than; lte: up to, at most; approx: about, approximately, around",
    "pt": "gt: acima de, mais de, maior que, mais que, superior a; gte: a partir de, no minimo, pelo menos; lt: abaixo de, menos de, menor que, inferior a; "
    "lte: ate, no maximo; approx: cerca de, aproximadamente, uns",
    "de": "gt: ueber, mehr als; lt: unter, weniger als",
    "fr": "gt: plus de, au dessus de; lt: moins de, en dessous de",
}
RANGES = {
    "en": "between {a} and {b}, from {a} to {b}, {a} to {b}, {a} {b}",
    "pt": "entre {a} e {b}, de {a} a {b}, {a} a {b}, {a} {b}",
    "de": "zwischen {a} und {b}, {a} {b}",
    "fr": "entre {a} et {b}, {a} {b}",
}
SEPARATORS = {"en": (".", ","), "pt": (",", "."), "de": (",", "."), "fr": (",", " ")}
MULTIPLIERS = {
    "en": "k 1000, thousand 1000, million 1000000",
    "pt": "mil 1000, k 1000, mi 1000000, milhao 1000000, milhoes 1000000",
    "de": "tausend 1000, k 1000, million 1000000",
    "fr": "mille 1000, k 1000, million 1000000",
}
SPELLED = {
    "en": "one 1, two 2, three 3, four 4, five 5, six 6, seven 7, eight 8, nine 9, ten 10, twenty 20, thirty 30, forty 40, fifty 50, hundred 100",
    "pt": "um 1, uma 1, dois 2, duas 2, tres 3, quatro 4, cinco 5, seis 6, sete 7, oito 8, nove 9, dez 10, vinte 20, trinta 30, quarenta 40, cinquenta 50, "
    "cem 100, cento 100, duzentos 200, trezentos 300, quatrocentos 400, quinhentos 500",
}
#: quantity: unit factor, ...; the first unit is the one that values are kept in.
UNITS = """
power: kw 1, cv 0.7355, ps 0.7355, hp 0.7457
volume: l 1, lt 1, m3 1000, gal 3.785
length: m 1, ft 0.3048
speed: kmh 1, mph 1.609
mass: kg 1, t 1000, ton 1000
money: r$ 1, $ 1, € 1
"""
LOCAL_UNITS = {
    "en": "liter l, liters l, litre l, litres l, meter m, meters m, metre m, metres m, ton t, tons t, tonne t, tonnes t, feet ft, foot ft, horsepower hp",
    "pt": "litro l, litros l, metro m, metros m, tonelada t, toneladas t, quilo kg, quilos kg, cavalo cv, cavalos cv, pes ft, pe ft, reais r$, real r$",
    "de": "liter l, meter m, tonne t, tonnen t, pferdestaerken ps",
    "fr": "litre l, litres l, metre m, metres m, tonne t, tonnes t, chevaux cv",
}
STOPWORDS = {
    "en": "the a an of with for in on at to and",
    "pt": "de do da dos das e com para por o a os as um uma em no na que",
    "de": "der die das und mit fuer von ein eine",
    "fr": "le la les de du des et avec pour un une",
}
COMPAT = {
    "en": "compatible with, fits, works with, for this, for the",
    "pt": "compativel com, compativeis com, serve no, serve na, para o, para a",
    "de": "kompatibel mit, passt zu, fuer diesen",
    "fr": "compatible avec, pour ce, convient a",
}
SELECTED = {
    "en": "this, this tractor, selected",
    "pt": "este, esta, esse, essa, este trator, selecionado",
    "de": "diesen, ausgewaehlt",
    "fr": "ce, selectionne",
}


def _entries(text: str) -> list[tuple[str, list[str]]]:
    rows = [line.partition(":") for line in text.strip().splitlines()]
    return [(head.strip(), [x.strip() for x in rest.split(",")]) for head, _, rest in rows if rest]


def _pairs(text: str) -> dict[str, str]:
    return dict(reversed([x.strip().rsplit(" ", 1) for x in text.split(",")])) if text else {}


@dataclass
class Lexicon:
    aliases: list[tuple[tuple[str, ...], tuple[str, str]]] = field(default_factory=list)
    operators: list[tuple[str, list[str]]] = field(default_factory=list)
    ranges: list[list[str]] = field(default_factory=list)
    decimal: str = "."
    thousands: str = ","
    multipliers: dict[str, float] = field(default_factory=dict)
    spelled: dict[str, float] = field(default_factory=dict)
    units: dict[str, tuple[str, float, str]] = field(default_factory=dict)
    local_units: dict[str, str] = field(default_factory=dict)
    stopwords: set[str] = field(default_factory=set)
    compat: list[tuple[str, ...]] = field(default_factory=list)
    selected: list[tuple[str, ...]] = field(default_factory=list)

    @classmethod
    def load(cls, locales: tuple[str, ...]) -> Lexicon:
        """The union of the locales' vocabularies; number separators are the first one's. Unknown locales add nothing; brands are in English."""
        out = cls()
        out.decimal, out.thousands = next((SEPARATORS[x] for x in locales if x in SEPARATORS), (".", ","))
        for quantity, units in _entries(UNITS):
            out.units |= {u: (quantity, float(f), u) for u, f in (x.rsplit(" ", 1) for x in units)}
        split = lambda table, x: [tuple(p.split()) for p in map(str.strip, table.get(x, "").split(",")) if p]
        for x in locales:
            concepts = [(("brand", head), terms) for head, terms in _entries(BRANDS)] if x == "en" else []
            concepts += [(tuple(head.split()), terms) for head, terms in _entries(ALIASES.get(x, ""))]
            out.aliases += [(tuple(t.split()), concept) for concept, terms in concepts for t in terms]
            for part in filter(None, COMPARATORS.get(x, "").split(";")):
                op, _, phrases = part.partition(":")
                out.operators += [(op.strip(), p.split()) for p in phrases.split(",")]
            out.ranges += [list(p) for p in split(RANGES, x) if list(p) not in out.ranges]
            out.multipliers = {k: float(v) for k, v in _pairs(MULTIPLIERS.get(x, "")).items()} | out.multipliers
            out.spelled = {k: float(v) for k, v in _pairs(SPELLED.get(x, "")).items()} | out.spelled
            out.local_units = _pairs(LOCAL_UNITS.get(x, "")) | out.local_units
            out.stopwords |= set(STOPWORDS.get(x, "").split())
            out.compat += split(COMPAT, x)
            out.selected += split(SELECTED, x)
        return out

    def unit(self, text: str) -> tuple[str, float, str] | None:
        """(quantity, factor, unit)."""
        return self.units.get(text) or self.units.get(self.local_units.get(text, ""))

    def is_money_sign(self, text: str) -> bool:
        return text in self.units and self.units[text][0] == "money"


def data_locales(game_language: str) -> tuple[str, ...]:
    """A game's language as vocabularies to load: Brazilian is Portuguese, and English always comes along."""
    first = {"br": "pt", "pt": "pt"}.get(game_language, game_language)
    return (first,) if first == "en" else (first, "en")
