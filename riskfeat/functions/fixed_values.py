"""Lists and ranges that results depend on and that are therefore stated as they are."""

# Stop words removed from cleaned payment texts.
STOP_WORDS = [
    "ab", "sv", "pa", "ql", "tr", "fi", "de", "ek", "va", "se", "ma", "as", "ce", "nr", "ko", "kb",
    "mm", "hb", "av", "oc",
    "maj", "juni", "april", "juli", "mars", "apr", "jun", "feb", "jan", "mar", "maj17", "jul", "apri",
    "aug", "may", "juni17", "august", "mar17", "april17", "apr17", "june", "augusti", "jun17", "sept",
    "juli17", "maj2017", "mars17", "september", "februari", "juni2017", "july", "april2017",
    "sverig", "sverige", "sveri", "ocr", "faktu", "faktnr", "faktura", "betala", "delbetalning",
    "inbetalning", "avbetalning", "sthlm", "svensk", "stockholm", "sweden", "stockholms", "no", "sk",
]

# Two-letter tokens that carry meaning and are left out of the short-token review.
KEPT_SHORT_TOKENS = [
    "ab", "ok", "q8", "on", "ki", "el", "sv", "tv", "pa", "ql", "tr", "fi", "de", "ek", "if", "va",
    "b2", "ag", "mc", "gs", "ge", "st", "hm", "se", "ka", "ma", "as", "gb", "sj", "ce", "nr", "tj",
    "fa", "ij", "ba", "er", "la", "ko", "kb", "mm", "lf", "sg", "hb", "sl", "br", "av", "oc", "gr",
    "no", "bo", "dn", "sk",
]

# Category of a cleaned, upper-cased payee text; the first rule with a hit wins.
# "SWEDBANK" has to stand at the start or after white space, and be followed by white space or the end.
PAYEE_RULES = [
    ("mortgage", ["BOLAON", "FASTIGH", "BOSTAD", "HYPOTEK"]),
    ("card", ["KORT", "CARD", "VISA", "MASTER"]),
    ("Swedbank", [r"(^|\s)SWEDBANK(\s|$)", "ENTERCARD", "PAYEX"]),
    ("insurance", ["FOERSAEKRING", "PENSION", "LIV", "FOLKSAM"]),
    ("petrostation", ["OKQ8", "PREEM", "CIRCLE", "STATOIL", "EQUINOR"]),
    ("mobil", ["TELIASONERA", "TELENOR", "TELE2", "HI3G", "TELIA MOBIL", "COMVIQ", "BREDBAND", "CANAL DIGITAL"]),
    ("government", ["RADIOTJAENST", "CENTRALA STUDIES", "SKATTEVERKET", "TRANSPORTSTYRELS", "INTELEON AB",
                    "ARBETSLOESHETSKAS"]),
    ("electricity", ["VATTENFALL", "ENERGI", "FORTUM"]),
]

# Clearing-number ranges per bank as (match on, first, last, bank), first hit wins.
# "full" compares the whole trimmed code, "prefix4" its first four characters.
CLEARING_RANGES = [
    ("full", 9550, 9569, "Avanza"),
    ("prefix4", 8000, 8999, "Swedbank"),
    ("prefix4", 6000, 6999, "Handelsbanken"),
    ("prefix4", 9270, 9279, "ICA Banken"),
    ("prefix4", 9170, 9179, "IKANO Banken"),
    ("prefix4", 9100, 9109, "Nordnet"),
    ("prefix4", 9280, 9289, "Resurs Bank"),
    ("prefix4", 9250, 9259, "SBAB"),
    ("prefix4", 9150, 9169, "Skandiabanken"),
    ("prefix4", 9400, 9449, "Forex Bank"),
    ("prefix4", 9460, 9469, "GE Money Bank"),
    ("prefix4", 2300, 2399, "Ålandsbanken"),
    ("prefix4", 9190, 9199, "DNB"),
    ("prefix4", 9680, 9689, "Bluestep"),
    ("prefix4", 9230, 9239, "Marginalen Bank"),
    ("prefix4", 9640, 9649, "Nordax Bank"),
    ("prefix4", 9460, 9469, "Santander"),
    ("prefix4", 9570, 9579, "Sparbanken Syd"),
    ("prefix4", 9300, 9349, "Sparbanken Öresund"),
    ("prefix4", 1200, 1399, "Danske Bank"),
    ("prefix4", 2400, 2499, "Danske Bank"),
    ("prefix4", 9180, 9189, "Danske Bank"),
    ("prefix4", 5000, 5999, "SEB"),
    ("prefix4", 9120, 9124, "SEB"),
    ("prefix4", 9130, 9149, "SEB"),
    ("prefix4", 9020, 9029, "Länsförsäkningar"),
    ("prefix4", 3400, 3409, "Länsförsäkningar"),
    ("prefix4", 9060, 9069, "Länsförsäkningar"),
    ("prefix4", 1100, 1199, "Nordea"),
    ("prefix4", 1449, 1999, "Nordea"),
    ("prefix4", 3410, 3999, "Nordea"),
    ("prefix4", 4000, 4999, "Nordea"),
    ("prefix4", 9500, 9549, "Nordea"),
    ("prefix4", 9960, 9969, "Nordea"),
    ("prefix4", 3000, 3399, "Nordea"),
    ("full", 0, 0, "0"),
]
OTHER_COUNTERPARTY = "Other"

# Characters of the text cleaner.
# [^A-Za-zÀ-ÿ0-9]+ written as the ranges it takes in: Java looks these up, where the negated class costs ten times as long.
NOT_LETTER_OR_DIGIT = r"[\x00-/:-@\[-`{-\xBF\x{100}-\x{10FFFF}]+"
SPELLED_OUT = [("å", "ao"), ("ä", "ae"), ("ö", "oe")]
WHOLE_NUMBER = "[0-9](?<![^ ][0-9])[0-9]+(?![^ ])"

# Fixed value: probability above which an applicant counts as a defaulter.
DECISION_LIMIT = 0.4
