"""Personal data in texts, with DataFrame functions only.

Method: regular expressions propose spans; checks confirm them (number ranges, digit counts, Luhn for cards, mod 97 for
account numbers); words shortly before or after a span raise or lower its score, which each span carries. Email, ip, card and
phone spans that pass their check stay whatever their score (`base`); account numbers and national ids are added where the
score reaches `threshold`: a confirmed account number unless words speak against it, a national id only with words for it.

The patterns are possessive and start only where a run of their first characters starts, so a scan is linear in the text
and needs no recursion, however long a run is; the matches of the `BASE` kinds are those of the plain patterns. An account
number is looked for at every start of a run, with the exact length of its country (`IBAN_LENGTHS`), so neither the words
after it nor a false start before it can hide it. Codes without a known length are taken as far as their signs go.

Defined cases: a null text counts as empty and has no spans. Repeated rows and null doc_id are searched as they stand. Other
columns are ignored here; `redact` keeps every column and replaces only the text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.llm.native import blocks_of, let, matches, piece, scan

_RUN = "[A-Za-z0-9._%+-]"
#: Account number lengths by country: the registry, then countries that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
_IBAN = "|".join([*(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()),
                  rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"])
#: Fixed patterns. A match may also start where the last one ended (\G), in the middle of a run.
PATTERNS = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN})(?![A-Za-z0-9]))[A-Z]",  # the number is group 1: numbers may overlap
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Words that support a kind when they stand close to a span, and the score of a confirmed span without them.
CONTEXT = {
    "email": r"e-?mail|contact|write to", "ip": r"\bip\b|address|server|host", "card": r"card|visa|credit|payment|cc",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|account|bank|konto|compte|cuenta", "national_id": r"ssn|social security|national id|insurance",
}
#: Words that speak against a span being personal, whatever its kind.
AGAINST = r"part (?:no|number)|serial|isbn|version|tracking|\bsample\b|example"
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
#: Code points looked at before and after a span, and what words in them add or take away.
NEAR, AFTER, BONUS, PENALTY = 40, 20, 0.3, 0.4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled, nines cast out."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    total = F.aggregate(F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.translate(d, "0123456789", "0246813579").cast("int"))),
                        F.lit(0), lambda s, d: s + d)
    return total % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number leaves 1 after division by 97: first four signs last, letters as 10 to 35."""
    signs = F.regexp_replace(value, " ", "")
    signs = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, F.lit(1), F.lit(4)))
    rest = F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(
        c.between("0", "9"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _proposed(text: Column, kind: str) -> Column:
    """The matches of a kind as array<struct<start, end, value>>."""
    found = matches(text, PATTERNS[kind])
    if kind != "iban":
        return found
    numbers = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
    return F.zip_with(found, numbers, lambda m, n: F.struct(m["start"].alias("start"), (m["start"] + F.length(n)).alias("end"), n.alias("value")))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod_97(value)).otherwise(F.lit(False))
    return F.lit(True)


def spans(text: Column, threshold: float = 0.5) -> Column:
    """All spans by start, then kind, as array<struct<start, rank, end, kind, score>>."""
    text = F.coalesce(text, F.lit(""))

    def confirmed(kind: str) -> Column:
        return F.filter(_proposed(text, kind), lambda m: _valid(kind, m["value"])).alias(kind)

    def of(x: Column, rank: int, kind: str) -> Column:
        def scored(m: Column) -> Column:
            # what stands around a span comes from the block it lies in: cutting it from the whole text would walk there each time
            before = piece(x["blocks"], F.greatest(m["start"] - NEAR, F.lit(0)), m["start"])
            near = F.lower(F.concat(before, F.lit("\n"), piece(x["blocks"], m["end"], m["end"] + AFTER)))
            score = (F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), PENALTY).otherwise(0.0))
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                            F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))).alias("score"))

        found = F.transform(x["found"][kind], scored)
        return found if kind in BASE else F.filter(found, lambda s: s["score"] >= threshold)

    def all_of(found: Column) -> Column:
        some = sum((F.size(found[kind]) for kind in PATTERNS), F.lit(0)) > 0
        both = F.struct(found.alias("found"), blocks_of(text).alias("blocks"))
        return F.when(some, let(both, lambda x: F.array_sort(F.concat(*(of(x, i, k) for i, k in enumerate(PATTERNS)))))).otherwise(
            F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>"))

    return let(F.struct(*map(confirmed, PATTERNS)), all_of)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): every row's spans in code points of its whole text."""
    return docs.select(F.col(key).alias("doc_id"), spans(F.col(text), threshold).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(found: Column) -> Column:
    """The spans' scores in hundredths, joined by commas in the same order."""
    return F.array_join(F.transform(found, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns, with each span of the text replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, under the kind of the first. A null text stays null.
    """
    t, found = F.col(text), "__pii_spans"

    def masked(x: Column) -> Column:
        parts = F.transform(x["spans"], lambda s, i: let(F.get(x["reach"], i), lambda done: F.concat(
            piece(x["blocks"], done, s["start"]), F.when(s["start"] >= done, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))))
        tail = piece(x["blocks"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length(t))
        return F.concat(F.array_join(parts, ""), tail)

    ends = F.transform(F.col(found), lambda s: s["end"])
    state = F.struct(F.col(found).alias("spans"), scan(ends, lambda a, b: F.greatest(a, b), F.lit(0)).alias("reach"), blocks_of(t).alias("blocks"))
    marked = docs.withColumn(found, spans(t, threshold))
    return marked.withColumn(text, F.when(F.size(found) > 0, let(state, masked)).otherwise(t)).select(*(F.col(f"`{c}`") for c in docs.columns))
