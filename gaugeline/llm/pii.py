"""Personal data by generators of candidates and gradient-boosted trees (operator 11), all in DataFrame functions.

Two generators per kind (email, ip, card, phone) propose spans, which may overlap: the base pattern, whose spans stay
if they pass the base check, and a wide one (numbers inside longer runs, grouped cards, phones
without a plus, addresses with "[at]" and "[.]", addresses of eight hexadecimal groups). Each text is read once;
its candidates are written with small integer features of format (digits, groups, separators, brackets, letters) and
of context (neighbouring characters, cue words before, numbers after).

There are no labelled spans, so boosted trees learn from a check that the features do not show: whether a
candidate's own characters are valid (Luhn digit, octets, number of digits, letters at the end of a domain) and it is
not part of a longer word or number. Where numbers of a format and context are random, few are valid and the
model's probability is low; where they are what they look like, nearly all are. Candidates with equal features are
one weighted row. Every level of a tree is one aggregate (sums of gradients per node, feature and bin), every
tree a CASE expression. Thresholds come from the half of the documents that the trees have not seen: per kind
the lowest probability above which ``PRECISION`` of the candidates are valid. A candidate is added if it is valid, reaches the
threshold of its kind and overlaps no base span.

Positions are code points from zero, ends exclusive; spans go by kind, then start, then end. ``n_email`` to ``n_phone``
count base spans; added ones are counted in ``n_added`` and stand in ``spans``. Null and empty texts have no spans. Rows
are treated one by one, so repeated rows and ids give rows each; a null id stays null. Spans of one kind never tie: a
wide span equal to a base span is that span. Texts of any length are read whole. Without candidates, or with valid or
invalid ones only, the model is constant. An empty table gives no rows. Other columns never enter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, only

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, RATE, RIDGE = 10, 2, 0.4, 1.0
#: Share of valid candidates wanted above a threshold.
PRECISION = 0.9
#: Steps of the probabilities that thresholds are taken from.
STEPS = 200
CONTEXT_BEFORE, CONTEXT_AFTER = 24, 8
#: Lengths are added up in runs of this many, so that a text of n candidates takes about n * RUN steps.
RUN = 256

# Base patterns, written so that no text takes more than linear time: a run of local characters or digits is entered at its
# start (or where the last match ended) and never given back.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?"
_DOT = r" ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?"
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++| (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}",
    "card": r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}|[0-9]{13,19}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}",
}
#: Texts without these can have no match.
_NEEDS = {("email", True): "@", ("phone", True): "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words before a candidate that say what it may be.
CUES = (
    r"\b(?:tel|phone|call|fax|mobile|cell)\b", r"\b(?:e-?mail|contact|write to)\b", r"\b(?:card|visa|credit|amex|pay)\b",
    r"\b(?:ip|host|server|addr|address)\b", r"\b(?:version|ver|release|isbn|issn|doi|id|no|nr|ref|token|key|hash|sha1|license|licence)\b",
)
FEATURES = ("generator", "digits", "separators", "longest", "brackets", "prefix", "before", "after", "cue", "letters", "number_after", "groups")

SPAN = "struct<kind:int,start:int,stop:int>"
CANDIDATE = "struct<kind:int,start:int,stop:int,base:boolean,valid:boolean,f:array<int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column) -> Column:
    """For every element the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def running(part: Column) -> Column:
        return F.aggregate(part, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))

    last = F.floor((F.size(lengths) - 1) / RUN).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: running(F.slice(lengths, b * RUN + 1, F.lit(RUN))))
    return let(parts, lambda p: F.flatten(F.zip_with(p, running(F.transform(p, lambda q: q["at"]))["out"], lambda q, o: F.transform(q["out"], lambda x: x + o))))


def places(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Candidates of one generator: matches from left to right with their positions, features and verdicts."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(values: Column) -> Column:
        # The text between matches gives positions and contexts without reading the whole text again per match.
        return let(F.split(text, pattern, -1), lambda gaps: let(
            sums_before(F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))),
            lambda sums: F.transform(values, lambda v, i: let(
                F.struct(
                    v.alias("value"), (F.get(sums, i) + F.length(F.get(gaps, i))).alias("start"),
                    F.substring(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), F.get(gaps, i)), -CONTEXT_BEFORE, CONTEXT_BEFORE).alias("before"),
                    F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(values, i + 1), F.lit(""))), 1, CONTEXT_AFTER).alias("after"),
                ),
                lambda m: candidate(m["value"], m["start"], m["before"], m["after"], kind, base),
            )),
        ))

    listed = let(found, lambda values: F.when(F.size(values) == 0, none).otherwise(located(values)))
    need = _NEEDS.get((kind, base))
    return listed if need is None else F.when(F.contains(text, F.lit(need)), listed).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_base(value: Column, kind: str) -> Column:
    """The base check of a match of the base pattern."""
    count = F.length(digits_of(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": count.between(16, 19) & F.call_function("luhn_check", digits_of(value)),
        "phone": count.between(8, 15),
    }[kind]


def is_valid(value: Column, kind: str) -> Column:
    """Whether a candidate's own characters are those of its kind."""
    return {
        "email": value.rlike(r"[A-Za-z]{2,24}$"),
        "ip": F.contains(value, F.lit(":")) | F.regexp_replace(value, r" ?[\[(](?:\.|dot)[\])] ?", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.length(digits_of(value)).between(13, 19) & F.call_function("luhn_check", digits_of(value)),
        "phone": F.length(digits_of(value)).between(8, 15),
    }[kind]


def class_of(character: Column) -> Column:
    """0 none or line end, 1 space, 2 letter, 3 digit, 4 quote or bracket, 5 other."""
    return (
        F.when(character.rlike(r"^[\n\r\t]?$"), 0).when(character == " ", 1).when(character.rlike(r"\p{L}"), 2)
        .when(character.rlike("[0-9]"), 3).when(character.rlike(r"""["'()\[\]{}<>]"""), 4).otherwise(5)
    )


def candidate(value: Column, start: Column, before: Column, after: Column, kind: str, base: bool) -> Column:
    """A candidate with its features, all small integers, in the order of FEATURES."""
    sides = F.struct(
        class_of(F.substring(before, -1, 1)).alias("left"), class_of(F.substring(after, 1, 1)).alias("right"),
        F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)).alias("groups"),
    )
    cue = F.lit(0)
    for k, pattern in enumerate(CUES, 1):
        cue = F.when((cue == 0) & F.lower(before).rlike(pattern), k).otherwise(cue)

    def made(s: Column) -> Column:
        # Local parts and plus signs may follow anything; the others must not continue a word or number.
        free = ~s["right"].isin(2, 3) if kind in ("email", "phone") else ~s["right"].isin(2, 3) & ~s["left"].isin(2, 3)
        if kind == "phone":
            free = free & (value.startswith("+") | ~s["left"].isin(2, 3))
        features = [
            F.lit(2 * KINDS.index(kind) + (not base)),
            F.least(F.length(digits_of(value)), F.lit(24)),
            F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(7)),
            F.least(F.coalesce(F.array_max(F.transform(s["groups"], lambda g: F.length(g))), F.lit(0)), F.lit(20)),
            value.rlike(r"[()\[\]{}<>]").cast("int"),
            F.when(value.startswith("+"), 1).when(value.startswith("00"), 2).otherwise(0),
            s["left"], s["right"], cue,
            F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(3)),
            after.rlike("^[ .-]?[0-9]").cast("int"),
            F.least(F.size(s["groups"]), F.lit(9)),
        ]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("stop"),
            (passes_base(value, kind) if base else F.lit(False)).alias("base"), (is_valid(value, kind) & free).alias("valid"), F.array(*features).alias("f"),
        )

    return let(sides, made)


def candidates(docs: DataFrame, carry_text: bool = False) -> DataFrame:
    """doc_id and the candidates of all generators of every row, with the text if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lists = [places(F.col("text"), pattern[kind], kind, base) for kind in KINDS for pattern, base in ((BASE, True), (WIDE, False))]
    return rows.select("doc_id", *(["text"] if carry_text else []), F.concat(*lists).alias("found"))


# ---- boosted trees ------------------------------------------------------------------------


@dataclass
class Split:
    """A node of a tree: rows whose feature is at most ``bin`` go left. Leaves are numbers."""

    feature: int
    bin: int
    left: Split | float
    right: Split | float

    def value(self, f: Column) -> Column:
        sides = [s.value(f) if isinstance(s, Split) else F.lit(s) for s in (self.left, self.right)]
        return F.when(F.get(f, F.lit(self.feature)) <= self.bin, sides[0]).otherwise(sides[1])


@dataclass
class Boosted:
    """Log odds before the first tree, the trees, and the least probability step of an added span per kind."""

    prior: float
    trees: list[Split]
    thresholds: tuple[int, ...]

    def raw(self, f: Column) -> Column:
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + tree.value(f)
        return F.round(total, 6)

    def step(self, f: Column) -> Column:
        """The probability in steps of 1 / STEPS."""
        return F.floor(F.lit(STEPS) / (1 + F.exp(-self.raw(f)))).cast("int")

    def selects(self, kind: Column, f: Column) -> Column:
        return self.step(f) >= F.get(F.array(*[F.lit(t) for t in self.thresholds]), kind)


def leaf(gradient: float, weight: float) -> float:
    return round(RATE * gradient / (weight + RIDGE), 6)


def best_split(cells: list[tuple[int, int, float, float]]) -> tuple[int, int, tuple[float, float], tuple[float, float]] | None:
    """The split of most gain among (feature, bin, gradient, weight) sums of a node; ties go to the first feature and bin."""
    best, found = 1e-6, None
    for feature in sorted({c[0] for c in cells}):
        column = sorted(c[1:] for c in cells if c[0] == feature)
        whole = [sum(c[k] for c in column) for k in (1, 2)]
        left = [0.0, 0.0]
        for value, g, h in column[:-1]:
            left = [left[0] + g, left[1] + h]
            right = [whole[0] - left[0], whole[1] - left[1]]
            gain = round(left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE), 6)
            if gain > best:
                best, found = gain, (feature, value, tuple(left), tuple(right))
    return found


def grow(rows: DataFrame, model: Boosted, depth: int) -> Split | None:
    """The next tree, a level at a time: one aggregate gives the sums of all nodes of a level."""
    chance = 1 / (1 + F.exp(-model.raw(F.col("f"))))
    nodes = {1: None}
    splits: dict[int, tuple] = {}
    for _ in range(depth):
        at = F.lit(1)
        for node in sorted(splits):
            feature, value = splits[node][:2]
            at = F.when(at == node, F.when(F.get("f", F.lit(feature)) <= value, 2 * node).otherwise(2 * node + 1)).otherwise(at)
        sums = rows.select(
            at.alias("node"), (F.col("good") - F.col("n") * chance).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"), F.posexplode("f").alias("feature", "bin")
        ).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        # Nodes x features x bins rows at most, whatever the number of candidates.
        by_node: dict[int, list] = {}
        for r in sums.collect():
            by_node.setdefault(r.node, []).append((r.feature, r.bin, r.g, r.h))
        fresh = {node: best_split(cells) for node, cells in by_node.items() if node in nodes}
        fresh = {node: split for node, split in fresh.items() if split}
        splits |= fresh
        nodes = {child: None for node in fresh for child in (2 * node, 2 * node + 1)}
        if not fresh:
            break

    def built(node: int) -> Split:
        feature, value, left, right = splits[node]
        sides = [built(child) if child in splits else leaf(*sums) for child, sums in ((2 * node, left), (2 * node + 1, right))]
        return Split(feature, value, *sides)

    return built(1) if 1 in splits else None


def thresholds(rows: DataFrame, model: Boosted, precision: float) -> tuple[int, ...]:
    """Per kind the least step from which on ``precision`` of the candidates are valid; STEPS + 1 if there is none."""
    kind = F.floor(F.get("f", F.lit(0)) / 2).cast("int")
    cells = rows.groupBy(kind.alias("kind"), model.step(F.col("f")).alias("step")).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    found = {}
    for r in cells.collect():
        found.setdefault(r.kind, {})[r.step] = (r.n, r.good)
    least = []
    for k in range(len(KINDS)):
        n = good = 0
        best = STEPS + 1
        for step in sorted(found.get(k, {}), reverse=True):
            n, good = n + found[k][step][0], good + found[k][step][1]
            if good >= precision * n:
                best = step
        least.append(best)
    return tuple(least)


def train(found: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Boosted:
    """Trees and thresholds from the candidates of all documents; equal features are one weighted row."""
    seen = found.select((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("held"), F.inline("found"))
    rows = scratch.settle(seen.groupBy("held", "f").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("good")), "features")
    held, used = rows.where("held"), rows.where("not held")
    n, good = used.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    model = Boosted(round(math.log((good + 0.5) / (n - good + 0.5)), 6), [], ())
    for _ in range(trees if 0 < good < n else 0):
        tree = grow(used, model, depth)
        if tree is None:
            break
        model.trees.append(tree)
    model.thresholds = thresholds(held, model, precision)
    return model


# ---- spans --------------------------------------------------------------------------------


def span(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))


def written(spans: Column) -> Column:
    """kind:start:end, with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def detect(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION, carry_text: bool = False) -> DataFrame:
    """doc_id and two sorted lists of spans (kind, start, stop) of every row: base ones and those the model adds."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.settle(candidates(docs, carry_text), "candidates")
    model = train(found.select("doc_id", "found"), scratch, trees, depth, precision)
    scratch.drop("features")
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), span))
    chosen = F.transform(F.filter("found", lambda c: ~c["base"] & c["valid"] & model.selects(c["kind"], c["f"])), span)
    split = found.withColumns({"base": base, "chosen": chosen}).drop("found")
    fresh = F.array_except("chosen", "base")
    apart = F.filter(fresh, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return split.withColumn("added", F.array_sort(apart)).drop("chosen")


def find(docs: DataFrame, **options) -> DataFrame:
    """Base counts, digest of the base spans and all spans of every row of ``docs`` (doc_id, text)."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return detect(docs, **options).select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text of every row with its spans written as [KIND]; overlapping spans are one, named by the first."""
    found = detect(docs, carry_text=True, **options)
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])
        piece = F.when(x["start"] < s["at"], F.lit("")).otherwise(F.concat(gap, F.get(names, x["kind"])))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.array_append(s["out"], piece).alias("out"))

    ended = F.aggregate(spans, state, step)
    text = let(ended, lambda e: F.concat(F.array_join(e["out"], ""), F.substring(F.col("text"), e["at"] + 1, F.length("text"))))
    return found.select("doc_id", text.alias("text"))
