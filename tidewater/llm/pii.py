"""Personal data in texts by weak supervision, in DataFrame functions only.

Candidates are spans that a strict or a wide pattern of a kind (``KINDS``) finds in a whole text. Labelers vote on each of
them, for (1), against (-1) or not at all (0): the patterns, the shape, a gazetteer, the words before it and how it is set
off from what stands around it. Expectation-maximisation over the counts of the vote patterns (3 ** 5 a kind at most, one
row a kind) estimates how reliable each labeler is, with no label given, and yields a probability for each vote pattern.
With these as soft labels a naive Bayes span classifier over hashed features (shape, length, words around it) is trained.

The strict spans that pass their kind's check are always kept: for each kind the leftmost matches that don't overlap; those
that fail the check are dropped without another try. The classifier adds wide spans of probability ``SURE`` or more, if they
pass the check too, don't overlap a strict span, and if the gazetteer or the words before them speak for them and no labeler
against; of wide spans that overlap, all are kept.

Places are counted in code points, from 0, ends exclusive. Patterns are possessive and begin where a run begins (or where
the last match ended), so that time grows with the text and not with its square; sums over the matches of a text go in
blocks, for the same reason. No row is ever joined to another or gathered with it: only counts are.

A null text counts as empty and has no spans. Null and repeated ids and repeated rows are rows like any other. Texts of any
length are searched whole. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash

KINDS = ("email", "ip", "card", "phone")
SURE, ROUNDS, AROUND, BUCKETS = 0.95, 30, 40, 4096

_LOCAL = "A-Za-z0-9._%+-"
#: The strict patterns. (?<![...])|\\G: a run's first character, or what follows the last match.
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wide ones: spelt-out or bracketed signs, numbers without a plus, other separators.
WIDE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:[\[({{]at[\])}}]|\x20at\x20)\x20?[A-Z0-9-]++(?:\x20?(?:[\[({{]dot[\])}}]|\x20dot\x20|(?<!\x20)\.(?=[A-Z0-9]))\x20?[A-Z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[(]\.[\])]\x20?|\[dot\])[0-9]{1,3}+(?:\x20?[\[(]\.[\])]\x20?|\[dot\])[0-9]{1,3}+(?:\x20?[\[(]\.[\])]\x20?|\[dot\])[0-9]{1,3}+",
    "card": r"(?<![0-9._/-])[0-9]{4}([./_])[0-9]{4,6}+\1[0-9]{4,5}+(?:\1[0-9]{3,4}+)?+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}+[\x20./-])?+\(?[0-9]{2,5}+\)?[\x20./-]{1,2}[0-9]{3,4}+[\x20./-][0-9]{3,4}+(?![0-9.-])",
}
#: Words that stand before personal data of a kind, in four languages, and words that stand before other numbers.
BEFORE = {
    "email": r"e-?mails?|mails?|correo|courriel|contact\w*|kontakt\w*|contacto|adresse|address|write|schreib\w*|reach",
    "ip": r"ip|address|adresse|dirección|host|server|serveur|servidor|client|login|from",
    "card": r"cards?|karten?|kreditkarten?|tarjetas?|cartes?|visa|mastercard|amex|credit|pan|payment|pago|zahlung|paiement",
    "phone": r"tel|telephone|telefon\w*|teléfono|téléphone|phone|call|mobile|móvil|handy|fax|whatsapp|anruf\w*|appel\w*|llam\w*",
}
OTHER = r"isbn|issn|doi|version|v|order|bestellung|pedido|commande|invoice|rechnung|factura|facture|id|no|nr|ref|page|seite|chapter|section|token|key|hash|sha|build|release|serial|score"
#: Top-level domains, issuer digits, reserved address blocks and dialling prefixes that the gazetteer labeler knows.
DOMAINS = "com org net edu gov int info biz io co eu de fr es uk us ca ch at it nl be pt se no dk fi pl ru jp cn in br mx ar cl au nz ie"
RESERVED = r"^(?:0+|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])[^0-9]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"
DIALLING = r"^(?:1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"

LABELERS = ("pattern", "shape", "gazetteer", "before", "setting")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a text of 14 to 19 digits passes Luhn's check."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def octets(m: Column) -> Column:
    """Whether the four numbers of an address are at most 255, whatever zeros lead them."""
    return F.rlike(m, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"))


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return luhn(digits(m))
    return F.length(digits(m)).between(10, 15) if kind == "phone" else F.lit(True)


def running(lens: Column, block: int = 64) -> Column:
    """The sums of what comes before each element of an array column of longs, block by block."""
    at = lambda i: F.slice(lens, i * block + 1, F.lit(block))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), at)
    sums = lambda xs, first: F.slice(F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(1), F.size(xs))
    each = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(F.size(lens) > 0, F.flatten(F.zip_with(blocks, sums(each, F.lit(0).cast("long")), sums))).otherwise(F.array().cast("array<bigint>"))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, strict: bool, m: Column, before: Column, after: Column, good: Column) -> Column:
    """The labelers' votes on a span m, in the order of LABELERS."""
    has = lambda c, p: F.rlike(c, F.lit(p))
    d = digits(m)
    if kind == "email":
        spelt = has(m, r"(?i)[\[({]at[\])}]|\x20dot\x20|[\[({]dot")
        shape = vote(has(m, r"^[^.].*[^.]@.*\.[A-Za-z]{2,18}$"), F.lit(True)) if strict else vote(spelt, ~spelt)
        gazetteer = vote(has(F.lower(m), rf"[^a-z](?:{DOMAINS.replace(' ', '|')})$"), F.lit(not strict))
    elif kind == "ip":
        zeros = has(m, r"(?:^|[^0-9])0[0-9]")
        shape, gazetteer = vote(~zeros, zeros), vote(~has(m, RESERVED), has(m, RESERVED))
    elif kind == "card":
        even = has(m, r"^[0-9]{14,19}$|^[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?$|^[0-9]{4}([\x20._/-])[0-9]{6}\2[0-9]{5}$")
        shape, gazetteer = vote(even, ~even), vote(has(d, ISSUERS), ~has(d, ISSUERS))
    else:
        cut = has(m, r"\)|[0-9][\x20./-]+[0-9]+[\x20./-]+[0-9]")
        abroad = F.regexp_replace(d, "^00", "")
        shape = vote(cut & F.length(d).between(10, 15), ~cut)
        gazetteer = vote(has(abroad, DIALLING) & (F.lit(strict) | has(d, "^00")), F.lit(strict) & ~has(abroad, DIALLING))
    near = vote(has(before, rf"(?i)\b(?:{BEFORE[kind]})\b\W{{0,3}}(?:\w+\W{{1,3}})?$"), has(before, rf"(?i)\b(?:{OTHER})\b\W{{0,4}}$"))
    apart = ~has(before, r"[\w=/\\#@.+-]$") & ~has(after, r"^[\w=/\\#@]|^[.:-]\w")
    return F.array(*(v.cast("tinyint") for v in (vote(F.lit(strict) & good, ~good), shape, gazetteer, near, vote(apart, ~apart))))


def features(m: Column, before: Column, after: Column, vs: Column) -> Column:
    """Hashed features of a span: votes, shape, length and what stands around it."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"\p{L}+", "a"), 1, 24)
    around = {"shape": shape, "size": F.floor(F.log2(F.length(m) + F.lit(1))).cast("string"), "left": F.regexp_extract(F.lower(before), r"([\p{L}]+)[^\p{L}]*$", 1), "right": F.regexp_extract(F.lower(after), r"^[^\p{L}]*([\p{L}]+)", 1), "l": F.right(before, F.lit(1)), "r": F.left(after, F.lit(1))}
    named = [F.concat(F.lit(f"{k}="), v) for k, v in around.items()] + [F.concat(F.lit(f"{n}="), F.get(vs, F.lit(i)).cast("string")) for i, n in enumerate(LABELERS)]
    return F.array_distinct(F.array(*(F.pmod(F.hash(x), F.lit(BUCKETS)) for x in named)))


SPAN = "array<struct<kind: int, start: bigint, end: bigint, strict: boolean, good: boolean, votes: array<tinyint>, features: array<int>>>"


def candidates(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """docs' columns `keep`, and spans: what the patterns of all kinds find in the text. Of wide spans, those that overlap a
    strict one which passes its check are left out."""
    names = [(k, kind, strict) for k, kind in enumerate(KINDS) for strict in (True, False)]
    pattern = lambda kind, strict: (STRICT if strict else WIDE)[kind]
    key = lambda kind, strict: f"{kind}_{'strict' if strict else 'wide'}"
    df = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.select(*keep, "_text", *(F.regexp_extract_all("_text", F.lit(pattern(kind, s)), F.lit(0)).alias(f"m_{key(kind, s)}") for _, kind, s in names))
    none = F.array().cast("array<string>")
    df = df.select(*keep, *(f"m_{key(kind, s)}" for _, kind, s in names), *(F.when(F.size(f"m_{key(kind, s)}") > 0, F.split("_text", pattern(kind, s), -1)).otherwise(none).alias(f"p_{key(kind, s)}") for _, kind, s in names))
    ends = lambda n: F.zip_with(F.col(f"p_{n}"), F.col(f"m_{n}"), lambda p, m: (F.length(p) + F.length(m)).cast("long"))  # noqa: E731  # the last part has no match: null
    df = df.select("*", *(F.slice(ends(key(kind, s)), F.lit(1), F.size(f"m_{key(kind, s)}")).alias(f"n_{key(kind, s)}") for _, kind, s in names))
    df = df.select("*", *(running(F.col(f"n_{key(kind, s)}")).alias(f"at_{key(kind, s)}") for _, kind, s in names))

    def spans(k: int, kind: str, strict: bool) -> Column:
        n = key(kind, strict)
        parts = F.col(f"p_{n}")
        around = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(f"m_{n}")), lambda p, q: F.struct(F.right(p, F.lit(AROUND)).alias("before"), F.left(q, F.lit(AROUND)).alias("after"), F.length(p).alias("n")))
        placed = F.zip_with(F.col(f"m_{n}"), F.col(f"at_{n}"), lambda m, at: F.struct(m.alias("m"), at.alias("at")))
        there = F.zip_with(placed, F.slice(around, F.lit(1), F.size(f"m_{n}")), lambda x, y: F.struct(x["m"].alias("m"), (x["at"] + y["n"]).alias("start"), y["before"].alias("before"), y["after"].alias("after")))
        if kind == "card" and strict:  # numbers that are no cards at all
            there = F.filter(there, lambda x: F.length(digits(x["m"])) >= 12)

        def judged(x: Column) -> Column:
            return F.struct(x["m"].alias("m"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after"), passes(kind, x["m"]).alias("good"))

        def voted(x: Column) -> Column:
            return F.struct(x.alias("x"), votes(kind, strict, x["m"], x["before"], x["after"], x["good"]).alias("v"))

        def made(y: Column) -> Column:
            x = y["x"]
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).cast("long").alias("end"), F.lit(strict).alias("strict"), x["good"].alias("good"), y["v"].alias("votes"), features(x["m"], x["before"], x["after"], y["v"]).alias("features"))

        return F.transform(F.transform(F.transform(there, judged), voted), made).cast(SPAN)

    df = df.select(*keep, F.concat(*(spans(*n) for n in names if n[2])).alias("_strict"), F.concat(*(spans(*n) for n in names if not n[2])).alias("_wide"))
    base = F.filter("_strict", lambda x: x["good"])
    df = df.select(*keep, "_strict", "_wide", F.when(F.size("_wide") > 0, base).otherwise(F.array().cast(SPAN)).alias("_base"))
    clear = F.filter("_wide", lambda w: ~F.exists("_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return df.select(*keep, F.concat("_strict", clear).alias("spans"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reliabilities(spans: DataFrame, rounds: int = ROUNDS, smoothing: float = 1.0) -> DataFrame:
    """spans (kind, votes) -> kind, votes, n, p: the probability that a span with these votes is personal data.

    Two classes, labelers independent within each: how often a labeler votes for, against or not at all in either class, and
    the classes' shares, by expectation-maximisation over the vote patterns of a kind (3 ** 5 at most, in one row)."""
    counts = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("xs"))
    table = lambda per: F.array(*(F.array(*(F.lit(p) for p in per)) for _ in LABELERS))
    start = F.struct(F.lit(0.5).alias("share"), table((0.1, 0.2, 0.7)).alias("yes"), table((0.7, 0.2, 0.1)).alias("no"))

    def chance(of: Column, vs: Column) -> Column:
        out = F.lit(1.0)
        for j in range(len(LABELERS)):
            out = out * F.get(F.get(of, F.lit(j)), F.get(vs, F.lit(j)).cast("int") + 1)
        return out

    def p(state: Column, vs: Column) -> Column:
        yes, no = state["share"] * chance(state["yes"], vs), (1 - state["share"]) * chance(state["no"], vs)
        return yes / (yes + no)

    def step(state: Column, _: Column) -> Column:
        soft = F.transform("xs", lambda x: F.struct(x["votes"].alias("votes"), (x["n"] * p(state, x["votes"])).alias("yes"), x["n"].alias("n")))

        def estimated(xs: Column) -> Column:
            total = lambda f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

            def share(f, all_: Column) -> Column:
                of = lambda j, v: total(lambda x: F.when(F.get(x["votes"], F.lit(j)) == v, f(x)).otherwise(0.0))
                return F.array(*(F.array(*((of(j, v) + smoothing) / (all_ + 3 * smoothing) for v in (-1, 0, 1))) for j in range(len(LABELERS))))

            yes, every = total(lambda x: x["yes"]), total(lambda x: x["n"])
            return F.struct(((yes + smoothing) / (every + 2 * smoothing)).alias("share"), share(lambda x: x["yes"], yes).alias("yes"), share(lambda x: x["n"] - x["yes"], every - yes).alias("no"))

        return let(soft, estimated)

    fitted = rows.select("kind", "xs", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("state"))
    return fitted.select("kind", "state", F.explode("xs").alias("x")).select("kind", "x.votes", "x.n", p(F.col("state"), F.col("x.votes")).alias("p"))


def classifier(spans: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """One row: weights, an array of log-odds by kind * (BUCKETS + 1) + feature; the last of a kind are its own odds.

    labels has at most 4 * 3 ** 5 rows, which are broadcast, and so is the result."""
    soft = spans.join(F.broadcast(labels.select("kind", "votes", "p")), ["kind", "votes"]).select("kind", F.explode(F.concat("features", F.array(F.lit(BUCKETS)))).alias("f"), "p")
    sums = soft.groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    all_ = sums.filter(F.col("f") == BUCKETS).select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    share = (F.col("all_yes") + smoothing) / (F.col("all_yes") + F.col("all_no") + 2 * smoothing)
    odds = F.log((F.col("yes") + smoothing * share) / (F.col("no") + smoothing * (1 - share)))
    base = F.log(share / (1 - share))  # a feature that is rarely seen says little
    weights = sums.join(F.broadcast(all_), "kind").select((F.col("kind") * (BUCKETS + 1) + F.col("f")).cast("long").alias("at"), F.when(F.col("f") == BUCKETS, base).otherwise(odds - base).alias("w"))
    places = spans.sparkSession.range(len(KINDS) * (BUCKETS + 1)).select(F.col("id").alias("at"))
    dense = places.join(F.broadcast(weights), "at", "left").select("at", F.coalesce("w", F.lit(0.0)).alias("w"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("weights"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, by start, then kind in the order of KINDS."""
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans (arrays of kind, start, end, strict, good, votes, features)."""
    found = Stash(docs.sparkSession).put(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ("doc_id",)))
    each = found.select(F.explode("spans").alias("s")).select("s.*")
    model = classifier(each, reliabilities(each))
    logit = lambda x: F.aggregate(F.concat(x["features"], F.array(F.lit(BUCKETS))), F.lit(0.0), lambda a, f: a + F.get(F.col("weights"), x["kind"] * (BUCKETS + 1) + f))
    backed = lambda x: ~F.array_contains(x["votes"], F.lit(-1).cast("tinyint")) & ((F.get(x["votes"], F.lit(2)) == 1) | (F.get(x["votes"], F.lit(3)) == 1))
    sure = F.filter("spans", lambda x: x["good"] & (x["strict"] | (backed(x) & (1 / (1 + F.exp(-logit(x))) >= SURE))))
    return found.crossJoin(F.broadcast(model)).select("doc_id", F.filter("spans", lambda x: x["good"] & x["strict"]).alias("base"), sure.alias("spans"))  # one row


def find_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the number of base spans of each kind, base_sha256 and spans, as text."""
    f = find(docs, id_col, text_col)
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return f.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
