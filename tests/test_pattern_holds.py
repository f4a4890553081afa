"""What patterns' texts hold: with and without looking for it first, the same matches, and most patterns aren't searched for."""

import random

import pytest

from bazaarlake.functions import spans

WORDS = """rok výroby r.v. rv r v r. v výroba vyrobeno rč do provozu uveden k zařazena první 1. registrace reg. majitel provoz německo ( ) itálie / , : . - _ km kw tdi škoda octavia
 vw bmw stk technická emise emisní kontrola platná servis serviska oprava výměna vyměněn pneu kola z motor nové od nov rozvody řemen brzdové destičky olej filtry dělané při tel. telefon mobil
 PSČ psc IČO číslo cislo inzerát id najeto nájezd aktuální skutečných počet celkem je Km: tis tisíc k t xxx *** tkm t.km kkm dojezd range denně ročně Kč kc CZK ,- cena sleva výkon power
 2004 1998 09 96 220 150 000 150.000 12345 1.5 05/2007 15 220tis 150xxx 85 110 2027 999 ſtk naj\tetO provoZu İd ıč KM""".split(" ")


def plain(tiers):
    return {name: [(p, ()) for p, _ in found] for name, found in tiers.items()}


def made(seed):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 14))]
    text = "".join(w.upper() if rng.random() < 0.2 else w for x in words for w in (x, rng.choice(["", " ", " ", " ", "\xa0", "\t"])))
    return text


def test_holds_change_no_match(monkeypatch):
    texts = [made(k) for k in range(6000)]
    every = {f: [f(t) for t in texts] for f in (spans.years, spans.mileages, spans.powers)}
    for name in ("YEAR", "MILEAGE", "POWER"):
        for tier, found in getattr(spans, name).items():
            for pattern, holds in found:
                kept = [t for t in texts if pattern.search(t)]
                assert all(not holds or any(w in spans.folded(t) for w in holds) for t in kept), (name, tier, pattern.pattern)
        monkeypatch.setattr(spans, name, plain(getattr(spans, name)))
    assert {f: [f(t) for t in texts] for f in every} == every and all(any(x) for x in every.values())


@pytest.mark.parametrize("text", ["NATION_22; rok výroby 1997; najeto 936 tis km; výkon 304 kW; benzín", "NATION_20; r.v. 2000; 171tkm; výkon 242 kW"])
def test_most_patterns_are_not_searched_for(text):
    tried = [not holds or any(w in spans.folded(text) for w in holds) for found in (*spans.YEAR.values(), *spans.MILEAGE.values()) for _, holds in found]
    assert sum(tried) < len(tried) / 2
