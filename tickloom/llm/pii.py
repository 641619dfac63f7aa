"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) are regular expressions with a check; their
matches stay as found, and matches that fail the check are dropped as spans.  Looser
patterns propose further candidates: secrets after a keyword, social security numbers
and account numbers.  Every match, base ones and failed ones included, gets votes
(for, against, none) of four labelers: the check of its form, a regex for placeholders,
a gazetteer (fixed sets of top-level domains, reserved networks, card issuers, country
codes, placeholder words) and the words before it.  The corpus counts of every
combination of kind and votes, a table of fixed size, go through
expectation-maximisation, which estimates how reliable each labeler is and how likely
each combination is personal data.  A logistic span classifier is then trained against
those likelihoods, from a table of counts too, on features that no labeler looks at:
length, share of digits, number of different characters, number of parts, and the
character before.  Candidates beyond the base kinds that it scores ``threshold`` or
more become spans.

One scan of the texts finds the candidates, which are stored without the texts (with
the rows for ``redact``); one partial aggregate with a bounded number of groups.

Positions are code points.  They come from splitting the text at the pattern: the
lengths of gaps and matches add up, in blocks of ``BLOCK`` matches, so the work grows
with the text also where it is full of numbers.  Patterns are written with possessive
loops and look-arounds that find what the plain pattern finds, but in linear time and
constant stack.

Defined cases: null text is empty: no spans, and stays null in ``redact``.  Added spans
never overlap base spans.  Repeated rows are treated alike, no documents give no rows,
extra columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

# The kinds, in output order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}](?:(?!\.(?![{_LABEL}]))[{_LABEL}.])*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Patterns beyond the base kinds; group-free, matched like the others.
EXTRA = {
    "secret": r"(?<=(?i:token|secret|api_key|apikey|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/-]{12,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}+(?![A-Za-z0-9])",
}
NAMES = (*KINDS, *EXTRA)
#: Words before a candidate that speak for personal data.
CONTEXT = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|ip|host|address|token|secret|key|password|ssn|account|iban)\W{0,4}(?:\w+\W{1,3})?$"
# The gazetteer.
DOMAINS = "com org net edu gov mil int io info biz dev app ai co de fr es it nl be at ch se no dk fi pl cz pt ie uk us ca au nz jp cn in br mx ru eu".split()
#: First numbers of networks that are nobody's address: this host, loopback, multicast and reserved.
NO_ADDRESS = [0, 127, *range(224, 256)]
#: First digits of card numbers by issuer.
ISSUERS = ["34", "37", "36", "38", "300", "301", "302", "303", "304", "305", "35", "4", "51", "52", "53", "54", "55", *map(str, range(2221, 2721)), "6011", "644", "645", "646", "647", "648", "649", "65", "62", "50", "56", "57", "58", "67"]
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 852 853 886 961 962 965 966 971 972 974".split()
PLACEHOLDERS = "example sample placeholder changeme dummy your test none null todo undefined abcdef 123456 qwerty xxxx".split()
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()
#: Matches whose places are added up at a time.
BLOCK = 256
#: Probabilities of a labeler's right, wrong and no vote before any data, and of personal data.
PRIOR = (0.7, 0.1, 0.2)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The form check of a match."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "secret":
        return m.rlike("[0-9].*[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that any match passes."""
    tests = {
        "email": text.contains("@"),
        "phone": text.contains("+"),
        "secret": text.rlike("(?i)token|secret|api_?key|passw"),
    }
    return tests.get(kind, text.rlike("[0-9]"))


def _gazetteer(kind: str, m: Column) -> Column:
    """1 or -1: what the fixed sets say of a match."""
    digits = _digits(m)
    starts = lambda known: reduce(or_, (F.substring(digits, 1, n).isin([x for x in known if len(x) == n]) for n in sorted(set(map(len, known)))))
    tests = {
        "email": lambda: F.lower(F.substring_index(m, ".", -1)).isin(DOMAINS),
        "ip": lambda: ~F.coalesce(F.substring_index(m, ".", 1).try_cast("int"), F.lit(0)).isin(NO_ADDRESS),
        "card": lambda: starts(ISSUERS),
        "phone": lambda: starts(CALLING),
        "secret": lambda: ~F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda w: F.lower(m).contains(w)),
        "ssn": lambda: ~(F.substring(digits, 1, 3).isin(["000", "666"]) | (F.substring(digits, 1, 1) == "9") | (F.substring(digits, 4, 2) == "00") | (F.substring(digits, 6, 4) == "0000")),
        "account": lambda: F.substring(m, 1, 2).isin(COUNTRIES),
    }
    return F.when(tests[kind](), 1).otherwise(-1)


_SPAN = "array<struct<start:bigint,end:bigint,m:string,before:string>>"


def _blocks(items: Column) -> Column:
    """An array in pieces of ``BLOCK`` elements."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 2, 1))


def _sums_before(numbers: Column) -> Column:
    """For every number of a (short) array the sum of those before it."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(numbers, zero, lambda s, x: F.struct((s["at"] + x).cast("long").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``df`` with an array<struct<start, end, m, before>> of all leftmost non-overlapping matches of each pattern."""

    def add(state, x):
        start = state["at"] + F.char_length(x["gap"])
        end = (start + F.char_length(x["m"])).cast("long")
        span = F.struct(start.cast("long").alias("start"), end.alias("end"), x["m"].alias("m"), F.substring(x["gap"], -30, 30).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    text, others = F.col("text"), df.columns
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))
    pairs, relative, placed = {}, {}, {}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        both = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
        pairs[kind] = F.when(_worth(kind, text), both).otherwise(F.array().cast("array<struct<m:string,gap:string>>"))
        relative[kind] = F.transform(_blocks(F.col(f"{kind}_pairs")), lambda p: F.aggregate(p, zero, add))
        shift = _sums_before(F.transform(f"{kind}_blocks", lambda r: r["at"]))
        moved = F.zip_with(f"{kind}_blocks", shift, lambda r, o: F.transform(r["spans"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["m"].alias("m"), x["before"].alias("before"))))
        placed[kind] = F.flatten(moved)
    out = df.select(*others, *(v.alias(f"{k}_pairs") for k, v in pairs.items()))
    out = out.select(*others, *(v.alias(f"{k}_blocks") for k, v in relative.items()))
    return out.select(*others, *(v.alias(k) for k, v in placed.items()))


def candidates(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """id, text and for each kind the array of its candidates: start, end, kind, base, votes, features."""
    df = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = _with_matches(df, PATTERNS | EXTRA)

    def described(kind: str):
        def one(x: Column) -> Column:
            m, valid = x["m"], _valid(kind, x["m"])
            size, digits = F.char_length(m), F.char_length(_digits(m))
            votes = [
                F.when(valid, 1).otherwise(-1),
                F.when(m.rlike(r"^([0-9A-Za-z])\1*$|^[0 .-]*$|(.)\2{7}"), -1).otherwise(1 if kind in KINDS else 0),
                _gazetteer(kind, m),
                F.when(x["before"].rlike(CONTEXT), 1).otherwise(0),
            ]
            last = F.substring(x["before"], -1, 1)
            features = [
                F.least(F.floor(size / 6), F.lit(7)),
                F.floor(4 * digits / F.greatest(size, F.lit(1))),
                F.least(F.floor(F.size(F.array_distinct(F.split(m, ""))) / 4), F.lit(4)),
                F.least(F.size(F.split(m, r"[^0-9A-Za-z]+")), F.lit(6)),
                F.when(last == "", 0).when(last.rlike("[0-9A-Za-z]"), 1).when(last.rlike(r"\s"), 2).when(last.rlike("[\"'=:]"), 3).otherwise(4),
            ]
            return F.struct(
                x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), (valid & F.lit(kind in KINDS)).alias("base"),
                F.concat_ws(",", *(v.cast("string") for v in votes)).alias("votes"), F.concat_ws(",", *(v.cast("string") for v in features)).alias("features"),
            )

        return F.transform(kind, one)

    return raw.select("id", "text", *(described(k).alias(k) for k in NAMES))


def vote_counts(found: DataFrame) -> list[tuple]:
    """(kind, votes, features, count) over the corpus: of each kind at most 36 combinations of votes and some hundred of features."""
    spans = found.select(F.explode(F.concat(*NAMES)).alias("s"))
    return sorted(tuple(r) for r in spans.groupBy("s.kind", "s.votes", "s.features").count().collect())


def reliabilities(counts: list[tuple], rounds: int = 40):
    """Expectation-maximisation over vote combinations.

    Returns P(personal | kind, votes) for each combination and the labelers' vote
    probabilities by kind.  Each vote is independent given the truth.
    """
    posterior: dict[tuple[str, str], float] = {}
    tables = {}
    for kind in sorted({c[0] for c in counts}):
        rows: dict[str, int] = {}
        for k, votes, _, n in counts:
            if k == kind:
                rows[votes] = rows.get(votes, 0) + n
        ways = {v: tuple(map(int, v.split(","))) for v in rows}
        size = len(next(iter(ways.values())))
        right, wrong, none = PRIOR
        like = {y: [{1: right if y else wrong, -1: wrong if y else right, 0: none} for _ in range(size)] for y in (0, 1)}
        share = 0.5
        for _ in range(rounds):
            for v, w in ways.items():
                p = [(1 - share) * math.prod(like[0][j][x] for j, x in enumerate(w)), share * math.prod(like[1][j][x] for j, x in enumerate(w))]
                posterior[kind, v] = p[1] / sum(p)
            total = sum(rows.values())
            share = min(max((sum(n * posterior[kind, v] for v, n in rows.items()) + 1) / (total + 2), 0.01), 0.99)
            for y in (0, 1):
                mass = {v: n * (posterior[kind, v] if y else 1 - posterior[kind, v]) for v, n in rows.items()}
                for j in range(size):
                    prior = {1: right if y else wrong, -1: wrong if y else right, 0: none}
                    like[y][j] = {x: (10 * prior[x] + sum(m for v, m in mass.items() if ways[v][j] == x)) / (10 + sum(mass.values())) for x in (-1, 0, 1)}
        tables[kind] = like
    return posterior, tables


def _indicators(kind: str, features: str) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{kind}:{j}={x}" for j, x in enumerate(features.split(",")))]


def classifier(counts: list[tuple], posterior: dict, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[tuple[str, str], float]:
    """Logistic regression on span features against the EM likelihoods: P(personal | kind, features)."""
    rows = [(_indicators(k, f), posterior[k, v], math.log1p(n)) for k, v, f, n in counts]
    weights: dict[str, float] = {}
    total = sum(n for *_, n in rows) or 1.0
    p = lambda names: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in names)))))
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, y, n in rows:
            gap = n * (y - p(names))
            for x in names:
                slope[x] = slope.get(x, 0.0) + gap
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) + rate * (20 * g / total - ridge * weights.get(x, 0.0))
    return {(k, f): p(_indicators(k, f)) for k, _, f, _ in counts}


def _spans(found: DataFrame, threshold: float) -> DataFrame:
    """``found``, stored candidates, as id, text (if there) and the arrays ``base`` and ``found`` of spans."""
    counts = vote_counts(found)
    posterior, _ = reliabilities(counts)
    good = sorted({f"{k}|{f}" for (k, f), p in classifier(counts, posterior).items() if p >= threshold and k in EXTRA})
    accepted = F.array(*map(F.lit, good)).cast("array<string>")
    order = F.create_map(*[x for i, k in enumerate(NAMES) for x in (F.lit(k), F.lit(i))])

    slim = lambda s, added: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(added).alias("added"))
    front = [c for c in found.columns if c not in NAMES]
    base = F.transform(F.filter(F.concat(*KINDS), lambda s: s["base"]), lambda s: slim(s, False))
    added = F.transform(F.filter(F.concat(*EXTRA), lambda s: F.array_contains(accepted, F.concat(s["kind"], F.lit("|"), s["features"]))), lambda s: slim(s, True))
    split = found.select(*front, F.array_sort(base).alias("base"), F.array_sort(F.concat(base, added)).alias("both"))
    plain = lambda spans: F.transform(spans, lambda s: s.dropFields("added"))
    return split.select(*front, plain(F.col("base")).alias("base"), plain(F.array_sort(F.concat("base", _apart(F.col("both"))))).alias("found"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _apart(spans: Column) -> Column:
    """The added ones of spans in order of their starts that no base span overlaps.

    Blocks of ``BLOCK`` spans know how far base spans before them reach and where the next
    one starts after them, so every span is looked at twice, however many there are.
    """
    empty = F.slice(F.transform(spans, lambda s: s), 1, 0)
    of_base = lambda b, name: F.transform(F.filter(b, lambda s: ~s["added"]), lambda s: s[name])

    def after_others(state, s):
        stays = ~s["added"] | F.coalesce(s["start"] >= state["edge"], F.lit(True))
        return F.struct(F.when(s["added"], state["edge"]).otherwise(F.greatest(state["edge"], s["end"])).alias("edge"), F.when(stays, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"))

    def before_others(state, s):
        stays = s["added"] & F.coalesce(s["end"] <= state["edge"], F.lit(True))
        return F.struct(F.when(s["added"], state["edge"]).otherwise(s["start"]).alias("edge"), F.when(stays, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"))

    def judged(x):
        def one(block, i):
            first = F.struct(F.array_max(F.slice(x["tops"], 1, i)).alias("edge"), x["empty"].alias("out"))
            last = F.struct(F.array_min(F.slice(x["lows"], i + 2, F.size(x["lows"]))).alias("edge"), x["empty"].alias("out"))
            return F.aggregate(F.reverse(F.aggregate(block, first, after_others, lambda s: s["out"])), last, before_others, lambda s: s["out"])

        return F.flatten(F.transform(x["blocks"], one))

    facts = lambda blocks: F.struct(blocks.alias("blocks"), F.transform(blocks, lambda b: F.array_max(of_base(b, "end"))).alias("tops"), F.transform(blocks, lambda b: F.array_min(of_base(b, "start"))).alias("lows"), empty.alias("empty"))
    # most texts have no added span
    return F.when(F.exists(spans, lambda s: s["added"]), _bound(_blocks(spans), lambda blocks: _bound(facts(blocks), judged))).otherwise(empty)


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", threshold=0.5) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, n_spans, and ``found`` (kind, start, end of all spans)."""
    out = _spans(stored(candidates(docs, doc_id=doc_id, text=text).drop("text"), "personal"), threshold)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("id").alias(doc_id), *map(number, KINDS), F.sha2(named("base"), 256).alias("base_sha256"), named("found").alias("spans"), F.size("found").cast("long").alias("n_spans"),
        F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )


def redact(docs: DataFrame, *, doc_id="doc_id", text="text", threshold=0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns kept, null text stays null."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    found = candidates(docs.select(row.alias("row"), F.col(f"`{text}`").alias("body")), doc_id="row", text="body").drop("text")
    found = _spans(stored(found, "personal"), threshold)
    whole = F.col("id").getField(text)

    # pieces between spans, in blocks that know how far the blocks before them reach; each cuts its own part of the text
    def add(state, s):
        fresh = s["start"] >= state["at"]  # a span inside an earlier one is gone with it
        piece = F.concat(F.substring(state["part"], (state["at"] - state["from"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["from"].alias("from"), state["part"].alias("part"), F.when(fresh, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    def pieces(x):
        reach = lambda n: F.coalesce(F.array_max(F.slice(x["tops"], 1, n)), F.lit(0).cast("long"))

        def one(block, i):
            part = F.substring(x["whole"], (reach(i) + 1).cast("int"), (reach(i + 1) - reach(i)).cast("int"))
            start = F.struct(reach(i).alias("at"), reach(i).alias("from"), part.alias("part"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(block, start, add, lambda s: s["out"])

        return F.concat(F.array_join(F.flatten(F.transform(x["blocks"], one)), ""), F.substring(x["whole"], (reach(F.size(x["blocks"])) + 1).cast("int"), F.lit(2**31 - 1)))

    cut = found.select("id", whole.alias("whole"), "found")
    tops = lambda blocks: F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    facts = lambda blocks: F.struct(F.col("whole").alias("whole"), blocks.alias("blocks"), tops(blocks).alias("tops"))
    clean = F.when(F.size("found") == 0, F.col("whole")).otherwise(_bound(_blocks(F.col("found")), lambda blocks: _bound(facts(blocks), pieces)))
    return cut.select(*(clean.alias(c) if c == text else F.col("id").getField(c).alias(c) for c in docs.columns))
