r"""Personal data by weak supervision (DataFrame functions only).

Base rules give certain spans (e-mail, IP, card, phone). Wider patterns and
failed base matches give candidates. Labelers vote on each candidate: the
pattern's own checks, a gazetteer (top-level domains, card issuers, dialling
forms), the words before the span, and its form. Expectation-maximisation over
the counts of vote patterns (a few hundred rows at most, whatever the corpus)
estimates each labeler's reliability and a probability per vote pattern. With
these as soft labels a naive Bayes span classifier is fitted on form and context
features by one aggregation; candidates that it accepts join the base spans.

Positions are code points, the end exclusive. They are found without a function
of row code: the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so their lengths add up to the positions.

The base patterns are written so that the matcher never re-reads a run of
characters: a match can only start where a run starts (or where the last match
ended), and runs are not given back. The matches are those of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    card   [0-9]([\x20-]?[0-9])+
    phone  \+[0-9][\x20().0-9-]+[0-9]
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, for candidates only.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried on it.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "email_wider": r"[\[(]at[\])]", "phone_wider": r"[0-9]{3}[\x20.-][0-9]{4}"}
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"

# Fixed word lists of the gazetteer and context labelers.
DOMAINS = "com|org|net|edu|gov|de|fr|es|uk|io|info|eu|it|nl|ch|at"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel|adresse|address)\W{0,4}$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse|login|from)\W{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|carte|tarjeta|account|number|no)\W{0,4}$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|cell|telefon|anruf|appel|llame|m[oó]vil|contact)\W{0,4}$",
}
CONTEXT_CHARS = 24
RUN = 64
#: Texts of more spans than this are cut as arrays of characters.
FEW_SPANS = 32
EM_ROUNDS = 30
ACCEPT = 0.9
RULE_ERROR = 200


def running(values: Column, merge, zero: Column) -> Column:
    """For each value, all values before it merged (sums, greatest); runs of ``RUN`` values and then their totals, so long arrays take little time."""

    def merged(v: Column, first: Column, end: Column, start: Column) -> Column:  # by index: slicing an array copies all of it
        return F.when(first >= end, start).otherwise(F.aggregate(F.sequence(first, end - 1), start, lambda a, k: merge(a, F.get(v, k))))

    def of(v: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda c: merged(v, c * RUN, F.least((c + 1) * RUN, F.size(v)), zero))
        bases = let(totals, lambda t: F.transform(t, lambda _, c: merged(t, F.lit(0), c, zero)))
        run = lambda i: F.floor(i / RUN).cast("int")
        return let(bases, lambda b: F.transform(v, lambda _, i: merged(v, run(i) * RUN, i, F.get(b, run(i)))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, of))


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, before, after>> of all matches, with the characters around (of the last two pieces and matches)."""

    def build(x: Column) -> Column:
        p, m = x["p"], x["m"]
        size = F.transform(m, lambda f, i: F.length(F.get(p, i)) + F.length(f))
        near = lambda i: F.right(F.concat(F.coalesce(F.right(F.get(p, i - 1), F.lit(CONTEXT_CHARS)), F.lit("")), F.coalesce(F.get(m, i - 1), F.lit("")), F.get(p, i)), F.lit(CONTEXT_CHARS))
        after = lambda i: F.left(F.concat(F.left(F.get(p, i + 1), F.lit(1)), F.coalesce(F.left(F.get(m, i + 1), F.lit(1)), F.lit(""))), F.lit(1))
        one = lambda f, i, at: F.struct(at.alias("start"), (at + F.length(f)).alias("end"), f.alias("found"), near(i).alias("before"), after(i).alias("after"))
        return let(running(size, lambda a, v: a + v, F.lit(0)), lambda b: F.transform(m, lambda f, i: one(f, i, F.get(b, i) + F.length(F.get(p, i)))))

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), build)


def _luhn(digits: Column) -> Column:
    def check(d: Column) -> Column:
        one = lambda i: F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        worth = lambda i: F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0

    return let(digits, check)


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(OCTETS)
    digits = F.translate(found, " -+().", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("1")).when(no, F.lit("0")).otherwise(F.lit("-"))


def _candidates(text: Column, kind: str, wider: bool) -> Column:
    """Matches of one pattern with base flag, votes (a text of 1, 0 and -) and features."""
    pattern = (WIDER if wider else PATTERNS)[kind]
    gate = GATES[f"{kind}_wider" if wider else kind]
    has = text.contains(gate) if gate == "@" else text.rlike(gate)
    empty = F.array().cast(_SPAN_ARRAY)

    def full(m: Column) -> Column:
        found, digits = m["found"], F.translate(m["found"], " -+().", "")
        before = m["before"]
        ok = F.lit(False) if wider else _valid(kind, found)
        if kind == "email":
            known = found.rlike(rf"(?i)(?:{DOMAINS})$")
            lists = _vote(known, ~known)
            form = _vote(found.rlike("@|dot|\\.[A-Za-z]{2,}$"), F.length(found) > 254)
        elif kind == "ip":
            lists = _vote(ok & found.rlike(r"^(?:[1-9]|1[0-9]{2}|[1-9][0-9]|2[01][0-9]|22[0-3])\."), found.rlike(r"^0|^2[3-9][0-9]\.|^[3-9][0-9]{2}"))
            form = _vote(ok & ~found.rlike(r"(?:^|\.)0[0-9]"), ~ok)
        elif kind == "card":
            lists = _vote(digits.rlike(ISSUERS) & F.length(digits).between(15, 16), ~F.length(digits).between(14, 19))
            form = _vote(found.rlike(r"^[0-9]{15,16}$|^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$"), ~F.length(digits).between(14, 19))
        else:
            lists = _vote(found.rlike(r"^\+?1?\x20?\(?[2-9][0-9]{2}\)?[\x20.-]|^\+(?:33|34|44|49)"), found.rlike(r"^\+0"))
            form = _vote(found.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}$"), ~F.length(digits).between(7, 15))
        rule = F.lit("-") if wider else _vote(ok, ~ok)
        context = _vote(before.rlike(CONTEXT[kind]), F.lit(False))
        after = m["after"]
        side = lambda c: F.when(c == "", "edge").when(c.rlike(r"\w"), "word").when(c.rlike(r"\s"), "space").otherwise("mark")
        features = F.array(
            F.concat(F.lit("rule="), rule), F.concat(F.lit("lists="), lists), F.concat(F.lit("context="), context), F.concat(F.lit("form="), form),
            F.concat(F.lit("digits="), F.least(F.length(digits), F.lit(24)).cast("string")), F.concat(F.lit("left="), side(F.substring(before, -1, 1))), F.concat(F.lit("right="), side(after)),
        )
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), ok.alias("base"),
            F.concat(rule, lists, context, form).alias("votes"), features.alias("features"),
        )

    return F.when(has, F.transform(_positions(text, pattern), full)).otherwise(empty)


_SPAN_ARRAY = "array<struct<start:int,end:int,kind:string,base:boolean,votes:string,features:array<string>>>"


def find_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``found``: every candidate span of the whole text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"), text.alias("text"))
    parts = [_candidates(F.col("text"), k, False) for k in KINDS] + [_candidates(F.col("text"), k, True) for k in WIDER]
    return base.select("row", F.concat(*parts).alias("found"))


# ---- reliabilities and the span classifier ------------------------------------


def expectation_maximisation(counts: list[tuple[str, str, int]], rounds: int = EM_ROUNDS) -> dict[tuple[str, str], float]:
    """P(personal) for each (kind, votes), from how often each vote pattern occurs.

    Dawid-Skene with two classes per kind; votes are 1, 0 or - (abstain), and a
    labeler has for either class a distribution over the three. Smoothed by one
    pseudo-vote, so a pattern seen once cannot be certain.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        post = {v: (1 + 2 * v.count("1")) / (2 + 2 * v.count("1") + 2 * v.count("0")) for v, _ in rows}
        for _ in range(rounds):
            total = sum(n for _, n in rows)
            prior = (1 + sum(post[v] * n for v, n in rows)) / (2 + total)
            like: list[dict[str, tuple[float, float]]] = []
            for j in range(len(rows[0][0])):
                yes, no = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
                yes["1"], no["0"] = 3.0, 3.0  # labelers are taken to be better than chance
                for v, n in rows:
                    yes[v[j]] += post[v] * n
                    no[v[j]] += (1 - post[v]) * n
                a, b = sum(yes[x] for x in "10-"), sum(no[x] for x in "10-")
                like.append({x: (yes[x] / a, no[x] / b) for x in "10-"})
                if j == 0:  # the pattern's own check (checksum, ranges, digit counts) is held to errors of one in RULE_ERROR
                    like[0] = {x: (min(p, 1 / RULE_ERROR) if x == "0" else p, min(q, 1 / RULE_ERROR) if x == "1" else q) for x, (p, q) in like[0].items()}
            for v, _ in rows:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(like[j][x][0] / like[j][x][1]) for j, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def fit(found: DataFrame) -> dict[tuple[str, str], float]:
    """Weights of the span classifier: log-odds by (kind, feature) and, under feature "", by kind.

    Both aggregations are bounded by labelers and features, not by the corpus.
    """
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    counts = [tuple(r) for r in spans.groupBy("kind", "votes").count().collect()]
    if not counts:
        return {}
    soft = expectation_maximisation(counts)
    table = found.sparkSession.createDataFrame([(k, v, p) for (k, v), p in soft.items()], "k string, v string, p double")
    rows = (
        spans.groupBy("kind", "votes", "features").count()
        .join(F.broadcast(table), (F.col("kind") == F.col("k")) & (F.col("votes") == F.col("v")))
        .select("kind", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"), (F.col("p") * F.col("count")).alias("yes"), ((1 - F.col("p")) * F.col("count")).alias("no"))
        .groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    )
    totals = {r["kind"]: (r["yes"] + 1, r["no"] + 1) for r in rows if r["feature"] == ""}
    weights = {}
    for r in rows:
        yes, no = totals[r["kind"]]
        weights[r["kind"], r["feature"]] = math.log(yes / no) if r["feature"] == "" else math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return weights


def _accepted(span: Column, weights: dict[tuple[str, str], float]) -> Column:
    if not weights:
        return F.lit(False)
    table = F.create_map(*(F.lit(x) for (k, f), w in sorted(weights.items()) for x in (f"{k} {f}", round(w, 6))))
    weight = lambda f: F.coalesce(F.try_element_at(table, F.concat(span["kind"], F.lit(" "), f)), F.lit(0.0))
    score = F.aggregate(span["features"], weight(F.lit("")), lambda acc, f: acc + weight(f))
    # digits that fail their own check (sums, ranges, lengths) look just like decoys: only words before them can outweigh that
    refuted = F.substring(span["votes"], 1, 1) == "0"
    return (score > math.log(ACCEPT / (1 - ACCEPT))) & (~refuted | (F.substring(span["votes"], 3, 1) == "1"))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def decided(found: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """``row``, ``base`` and ``spans`` of rows (rid, row, found): sorted by start, then kind as listed. Added spans never overlap base ones."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    slim = lambda a: F.sort_array(F.transform(a, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    base = F.filter("found", lambda s: s["base"])
    if not weights:
        return found.select("row", slim(base).alias("base"), slim(base).alias("spans"))
    most = F.lit(2**31 - 1)

    def extra(v: Column) -> Column:
        """Of all candidates (start, is_base, s) in order: the accepted ones that no base span overlaps, in time linear in their number."""
        reach = running(F.transform(v, lambda x: F.when(x["is_base"], x["s"]["end"]).otherwise(0)), lambda a, e: F.greatest(a, e), F.lit(0))
        come = running(F.transform(F.reverse(v), lambda x: F.when(x["is_base"], x["start"]).otherwise(most)), lambda a, e: F.least(a, e), most)
        apart = lambda o, x, i: (F.get(o["reach"], i) <= x["start"]) & (F.get(o["come"], F.size(o["v"]) - 1 - i) >= x["s"]["end"])
        added = lambda o: F.filter(o["v"], lambda x, i: ~x["is_base"] & apart(o, x, i) & _accepted(x["s"], weights))
        return F.transform(let(F.struct(v.alias("v"), reach.alias("reach"), come.alias("come")), added), lambda x: x["s"])

    # within the row, so that no text is shuffled
    ordered = F.sort_array(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["base"].alias("is_base"), s.alias("s"))))
    more = F.when(F.size("found") > F.size(base), let(ordered, extra)).otherwise(F.array().cast(_SPAN_ARRAY))
    return found.select("row", slim(base).alias("base"), slim(F.concat(base, more)).alias("spans"))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``base`` and ``spans`` for every document.

    Null and empty texts have no spans. Rows are handled one by one: null or
    repeated ids and clashing names do no harm. An empty table gives no rows.
    """
    found = _numbered(find_candidates(docs, text_col))
    return decided(found, fit(found))


def _numbered(found: DataFrame) -> DataFrame:
    """With a row number ``rid`` that is fixed by writing it down."""
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "pii-rows")


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every document."""
    found = _numbered(find_candidates(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), text_col="text").select(F.struct("row.doc_id").alias("row"), "found"))
    out = decided(found, fit(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("row.doc_id", *map(count, KINDS), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def _tag(span: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))


def _cut(text: Column, spans: Column) -> Column:
    """As in ``redact``, in linear time for any number of spans."""

    def of(x: Column) -> Column:
        chars, s = x["chars"], x["spans"]

        def joined(reach: Column) -> Column:  # how far the spans before each reach
            piece = lambda a, b: F.when(a >= b, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(a, b - 1), lambda k: F.get(chars, k)), ""))
            gap = lambda i, to: piece(F.get(reach, i), to)
            one = lambda v, i: F.when(v["start"] < F.get(reach, i), F.lit("")).otherwise(F.concat(gap(i, v["start"]), _tag(v)))
            last = F.greatest(F.get(reach, F.size(s) - 1), F.get(s, F.size(s) - 1)["end"])
            rest = piece(last, F.size(chars))
            return F.concat(F.array_join(F.transform(s, one), ""), rest)

        return let(running(F.transform(s, lambda v: v["end"]), lambda a, v: F.greatest(a, v), F.lit(0)), joined)

    return let(F.struct(F.split(text, "").alias("chars"), spans.alias("spans")), of)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a null text stays null.

    Overlapping spans are cut at the first one's end. Other columns are as they were.
    """
    names = docs.columns
    found = _numbered(find_candidates(docs, text_col))
    out = decided(found, fit(found))
    text = F.col(f"row.`{text_col}`")
    parts = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), _tag(s))).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    parts = F.when(F.size("spans") <= FEW_SPANS, parts).otherwise(_cut(text, F.col("spans")))
    clean = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(parts)
    return out.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names))
