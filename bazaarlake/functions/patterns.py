"""Patterns and word lists that decide what is found in a listing's text, best evidence first."""

from __future__ import annotations

# They must be as they are for results to match. All are read without regard to case.

YEAR_HIGH = [
    r"(?:rok\s+výroby|r\.?\s?v\.?|výroba|vyrobeno)\s*[:.]?\s*(\d{4})",
    r"rok\s*[:]\s*(\d{4})",
    r"(\d{4})\s*(?:rok\s+výroby|r\.?\s?v\.?)",
    r"rč\.?\s*(\d{4})",
    r"(?:do\s+provozu|v\s+provozu|ve\s+provozu)\s*(?:od)?\s*[:.]?\s*(?:\d{1,2}[/.])?\s*(?:\d{1,2}[/.])?\s*(\d{4})",
    r"(?:uveden|uvedena|uvedeno|zařazen|zařazena|zařazeno)\s+(?:do\s+provozu|k\s+provozu)\s*[:.]?\s*(?:\d{1,2}[/.])?\s*(?:\d{1,2}[/.])?\s*(\d{4})",
    r"(?:první|1\.)\s+(?:registrace|majitel|provoz)\s*[:.]?\s*(?:\d{1,2}[/.])?\s*(?:\d{1,2}[/.])?\s*(\d{4})",
    r"(?:r\.?\s?v\.?|rok\s+výr(?:oby)?\.?)\s*[:.]?\s*\d{1,2}/(\d{4})",
    r"(?:první|1\.?)\s*(?:registrace|reg\.?)\s*[:.]?\s*\d{1,2}/(\d{4})",
    r"\d{1,2}/(\d{4})\s*\([^)]*(?:německo|austria|švýcarsko|francie|itálie)[^)]*\)",
    r"(?:rok\s+výroby|r\.?\s?v\.?|výroba)\s*[:.]?\s*(\d{2})(?!\d)",
    r"(?<!\d)(\d{2})\s+rok\b",
]
YEAR_MEDIUM = [
    r"(?:^|\s)(\d{4})\s*(?:km|kw|tdi|tsi)",
    r"(?:škoda|vw|audi|bmw|toyota|ford|mazda)\s+\w+\s+(\d{4})",
    r",\s*(19[89]\d|20[0-2]\d)\s*,",
    r"(?:0[1-9]|1[0-2])/(19[89]\d|20[0-2]\d)\b",
]
YEAR_EXCLUDED = [
    r"(?:stk|technick[aá]|emise|emisn[ií])\s*(?:kontrola)?\s*(?:platn[aáé]?)?\s*(?:do|platnost|konec)?\s*:?\s*(?:\d{1,2}[/.])?(\d{4})",
    r"(?:servis|serviska|oprava|výměna|vyměněn)\s+(\d{4})",
    r"(?:pneumatiky|pneu|kola|brzdy|motor|převodovka)\s+(?:z|z\s+roku)?\s*(\d{4})",
    r"nové?\s+(?:od|z)\s+(\d{4})",
    r"(?:rozvody|rozvodový|řemen|řemeny|brzdy|brzdové|destičky|kotouče|olej|filtr|filtry)\s+(?:dělané?|dělaný|vyměněné?|vyměněn[yoa]?|při|z|ze)\s*(\d{4})",
    r"(?:dělané?|vyměněné?|vyměněn[yoa]?|oprava|opraveno)\s+(?:při|v|ve|z)?\s*(\d{4})",
    r"(?:tel\.?|telefon|mobil|PSČ|PS[CČ]|I[ČC]O?|[čc][ií]slo|inzer[aá]t[u]?|ID)\s*:?\s*(\d{4})",
    r"(\d{4})\s*\d{2,}",
]
YEAR_LOW = [
    r"\b(19\d{2}|20[0-2]\d)\b",
]
MILEAGE_HIGH = [
    r"(?:najeto|nájezd|aktuální\s+nájezd|skutečných|počet\s+km|km\s+celkem)\s*(?:skutečných|jasně|doložených|je)?\s*[:.]?\s*((\d{1,3}(?:[\s._]?\d{3})+)\s?km)",
    r"((\d{1,3}(?:[\s._]?\d{3})+)\s?km)\s+(?:najeto|celkem)",
    r"[Kk][Mm]\s*:\s*((\d{1,3}(?:[\s._]?\d{3})+))",
    r"[Kk][Mm]\s*:\s*((\d{4,6}))",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*(?:skutečných|je)?\s*[:.]?\s*((\d{1,3}[\s._]\d{3}(?:[\s._]\d{3})?)(?!\s?km))",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*[:.]?\s*((\d{1,3}(?:[.,]\d+)?)\s?(?:tis|tisíc)\.?\s?(?:km)?)",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*[:.]?\s*((\d{1,3})\s?k(?:\s?km)?)",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*[:.]?\s*((\d{1,3})\s?t\.?(?:\s?km)?)",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*[:.]?\s*((\d{1,3})\s?xxx(?:\s?km)?)",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s*[:.]?\s*((\d{1,3})\s?\*{3}(?:\s?km)?)",
    r"(?:najeto|nájezd|aktuální\s+nájezd)\s+(?:skutečných|je)?\s*[:.]?\s*((\d{4,6})(?:\s?km)?)",
]
MILEAGE_MEDIUM = [
    r"\b((\d{1,3}(?:[\s._]\d{3})+)\s?km)(?!.*\bkw\b)",
    r"\b((\d{5,6})\s?km)(?!.*\bkw\b)",
    r"\b((\d{1,3}(?:[.,]\d+)?)\s?(?:tis|tisíc)\.?\s?km)",
    r"\b((\d{1,3}(?:[.,]\d+)?)\s?k\s?km)",
    r"\b((\d{1,3}(?:[.,]\d+)?)\s?t(?!d|s|i|e)\s?km)",
    r"\b((\d{1,3})\s?xxx\s?km)",
    r"\b((\d{1,3})\s?\*{3}\s?km)",
    r"\b((\d{1,3}(?:[.,]\d+)?)\s?(?:tis|tisíc)\.?)(?!\w)",
    r"\b((\d{1,3}(?:[.,]\d+)?)k)(?!w|m|\w)",
    r"\b((\d{1,3}(?:[.,]\d+)?)\s?t)(?!d|s|i|e|a|\w)",
    r"\b((\d{1,3})t\.?km)\b",
    r"\b((\d{1,3})\s?xxx)(?!\w)",
    r"\b((\d{1,3})\s?\*{3})(?!\w)",
    r"\b((\d{2,3}\.\d{3}(?:\.\d{3})?))\s*(?!km|kw)\b",
    r"\b((\d{1,3}[\s._]\d{3}(?:[\s._]\d{3})?))(?!\s?k[mw]|\w)",
    r"\b((\d{5,6}))(?!\s?k[mw]|\d)",
]
MILEAGE_EXCLUDED = [
    r"(?:dojezd|dosah|range)\s+(\d+)\s?km",
    r"(\d+)\s?km\s+(?:denně|měsíčně|ročně)",
    r"(?:servis|serviska|poslední\s+servis|oprava|výměna|vyměněn|dělané?)\s+(?:při|v|ve|na)?\s*[:.]?\s*(\d{1,3}(?:[\s.]?\d{3})*)\s?km",
    r"(?:rozvody|rozvodový|řemen|brzdy|olej|filtr|filtry)\s+(?:při|dělané?|vyměněné?)\s+(\d{1,3}(?:[\s.]?\d{3})*)\s?km",
    r"(\d{1,3}(?:[\s.]\d{3})+)\s*(?:K[čc]|CZK|EUR|korun|,-)",
    r"(?:cena|sleva|doplatek)\s*[:.]?\s*(\d{1,3}(?:[\s.]\d{3})*)",
    r"(?:PS[ČC]|ps[čc])\s*:?\s*(\d[\s.]?\d{3})",
]
POWER_HIGH = [
    r"(?:výkon|power|motor)\s*[:.]?\s*((\d{1,3})\s?kw)",
    r"((\d{1,3})\s?kw)\s+(?:výkon|motor)",
]
POWER_MEDIUM = [
    r"\b((\d{1,3})\s?kw)\b",
]

# Of each pattern above, in its order: what a text in small letters, all runs of white space as one space, holds if the pattern fits it, one of
# them at least; an empty tuple where nothing can be said. Looking for these first spares most searches.
_RV, _DRIVEN = ("rv", "r.v", "r v", "r. v"), ("najeto", "nájezd")
YEAR_HIGH_HOLDS = [
    ("výroby", "výroba", "vyrobeno", *_RV), ("rok:", "rok :"), ("výroby", *_RV), ("rč",), ("provozu",), ("provozu",), ("registrace", "majitel", "provoz"),
    ("/",), ("reg",), ("(",), ("výroby", "výroba", *_RV), ("rok",),
]
YEAR_MEDIUM_HOLDS = [("km", "kw", "tdi", "tsi"), ("škoda", "vw", "audi", "bmw", "toyota", "ford", "mazda"), (",",), ("/",)]
YEAR_EXCLUDED_HOLDS = [
    ("stk", "technick", "emis"), ("servis", "oprava", "výměna", "vyměněn"), ("pneu", "kola", "brzdy", "motor", "převodovka"), ("nov",),
    ("rozvod", "řemen", "brzd", "destičky", "kotouče", "olej", "filtr"), ("dělan", "vyměněn", "oprava", "opraveno"),
    ("tel", "mobil", "psč", "psc", "ič", "ic", "slo", "inzer", "id"), (),
]
YEAR_LOW_HOLDS = [()]
MILEAGE_HIGH_HOLDS = [
    (*_DRIVEN, "skutečných", "počet", "celkem"), ("km najeto", "km celkem"), ("km:", "km :"), ("km:", "km :"), _DRIVEN, ("tis",), _DRIVEN, _DRIVEN, ("xxx",), ("***",), _DRIVEN,
]
MILEAGE_MEDIUM_HOLDS = [
    ("km",), ("km",), ("tis",), ("kkm", "k km"), ("tkm", "t km"), ("xxx",), ("***",), ("tis",), ("k",), ("t",), ("tkm", "t.km"), ("xxx",), ("***",),
    (".",), (" ", ".", "_"), (),
]
MILEAGE_EXCLUDED_HOLDS = [
    ("dojezd", "dosah", "range"), ("denně", "měsíčně", "ročně"), ("servis", "oprava", "výměna", "vyměněn", "dělan"), ("rozvod", "řemen", "brzdy", "olej", "filtr"),
    ("kč", "kc", "czk", "eur", "korun", ",-"), ("cena", "sleva", "doplatek"), ("psč", "psc"),
]
POWER_HIGH_HOLDS, POWER_MEDIUM_HOLDS = [("kw",), ("kw",)], [("kw",)]

FUEL_WORDS = r"\b(benzin(?:ový|ového|ovým|ové|ovém)?|benzín(?:ový|ového|ovým|ové|ovém)?|nafta|naftový(?:ho|mu|m|ém)?|diesel(?:ový|ového|ovým|ové)?|dýzl|naftak|turbodiesel|hybrid(?:ní|ním|ního)?|phev|mhev|elektro|electric|ev|bev|lpg|cng|plyn|e85)\b"
ENGINE_CODES = ("tdi", "tsi", "hdi", "cdti", "crdi", "dci", "jtd", "jtdm", "tdci", "dti", "tce", "gti", "gdi", "mpi", "fsi", "tfsi")
#: Exact words of each fuel; then parts of words, in order; then engine codes.
FUEL_EXACT = {
    "diesel": (
        "diesel", "nafta", "tdi", "td", "motorová nafta", "motorova nafta", "disel", "naftový", "naftovým", "dieselový",
        "dieselovým", "hdi", "cdti", "crdi", "dci", "jtd", "jtdm", "tdci", "turbodiesel", "naftak", "dýzl", "naftového",
        "naftovému", "naftovém",
    ),
    "benzín": (
        "benzín", "benzin", "gas", "gasoline", "b", "benzínový", "benzínovým", "benzínového", "benzínovém", "benzinový",
        "benzinového", "benzinovým", "tsi", "e85",
    ),
    "lpg": ("lpg", "plyn",),
    "cng": ("cng",),
    "elektro": ("elektro", "electric", "ev", "elektřina", "bev",),
    "hybrid": ("hybrid", "hybridní", "hybridním", "hybridního", "phev", "mhev",),
}
FUEL_PARTS = {"diesel": "diesel|naft|disel|diesl", "benzín": "benz|bezín|bezin", "hybrid": "hybrid", "lpg": "lpg|plyn", "cng": "cng", "elektro": "elek"}
FUEL_CODES = {"diesel": "tdi|hdi|cdti|crdi|dci|jtdm?|tdci|dti", "benzín": "tsi|tce|gti|gdi|mpi|fsi|tfsi"}
#: Rules of the bulk rewrite of fuels, in order.
FUEL_REWRITES = {"benzin.*": "benzin", "lpg.*": "lpg", "diesel.*": "diesel", "nafta.*": "diesel", "elektr.*": "elektro", "electric.*": "elektro", "hybrid.*": "hybrid", "cng.*": "cng", "zemní plyn.*": "cng"}
POWER_UNITS = {"kw": "kw", "kilowatt": "kw", "kilowatts": "kw", "ps": "ps", "hp": "ps", "koní": "ps", "koně": "ps", "kon": "ps", "horsepower": "ps"}
DISTANCE_UNITS = {"km": "km", "kilometer": "km", "kilometers": "km", "kilometre": "km", "kilometres": "km", "mi": "mi", "mile": "mi", "miles": "mi"}
THOUSANDS = ("tkm", "tis", "xxx")
YEARS, POWERS, MOST_KM = (1990, 2027), (30, 500), 1_000_000
#: How sure a value is that patterns found, by their tier, and whether a second opinion confirms it; and what is enough.
SURE = {("high", True): 0.95, ("high", False): 0.80, ("medium", True): 0.85, ("medium", False): 0.55, ("low", True): 0.70, ("low", False): 0.30}
ENOUGH = 0.65
FUELS_KNOWN = ("diesel", "benzín", "lpg", "elektro", "benzin", "nafta", "plyn")
