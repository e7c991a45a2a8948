"""Personal data: exact base patterns, and look-alikes selected by boosted trees. DataFrame functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.shared import whole_text
from probewise.workspace import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95       # of what a threshold lets through, on candidates the trees have not seen
LEAST_SEEN = 30        # candidates above a threshold that this must rest on
TREES, DEPTH = 12, 4
LEAST_BINS = 32
CONTEXT = 30

# The base patterns, written so that a regular-expression engine neither recurses nor starts
# again inside a run: they match exactly what the plain forms of the contract match.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# What may be personal data: loose forms, each proposing spans of a kind on its own.
GENERATORS = {
    "email": rf"{_LOCAL}{{1,64}} ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{{1,63}}(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{{1,63}}){{1,6}}",
    "ip": r"(?<![0-9.,])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\(?[0-9][ ().0-9/-]{6,28}[0-9](?![0-9A-Za-z])",
}
# Words that announce a kind.
CLUES = {
    "email": "(?i)mail|contact|write|address|correo|courriel",
    "ip": "(?i)\\bip\\b|host|server|login|addr",
    "card": "(?i)card|visa|credit|account|karte|carte|tarjeta",
    "phone": "(?i)phone|call|tel|fax|mobile|ruf|tél",
}
_DIGITS = "[^0-9]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, _DIGITS, "")


def _located(text: Column, pattern: str) -> Column:
    """(start, end, s) of the matches in order, by code points: what stands between two matches tells where they are."""
    items = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")

    def take(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + F.length(item["s"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(
            start.alias("start"), end.alias("end"), item["s"].alias("s")))).alias("found"))

    walked = F.aggregate(F.filter(items, lambda x: x["s"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")), take)
    return walked["found"]


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the checksum: from the right, every second one doubled."""
    turned = F.split(F.reverse(_digits(s)), "")
    weighed = F.transform(turned, lambda d, i: F.when(d == "", 0).when(
        i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _trigger(kind: str, text: Column, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "phone" and not loose:
        return text.rlike(r"\+[0-9]")
    if kind != "email":
        return text.rlike("[0-9][ ./()-]?[0-9(]" if kind != "ip" else "[0-9][.,][0-9]")
    return (F.instr(text, "@") > 0) | text.rlike(r"\[at\]|\(at\)| at [A-Za-z0-9-]+(?:\.[A-Za-z0-9]| dot |\[dot)") if loose \
        else F.instr(text, "@") > 0


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")


def base_spans(text: Column, kind: str) -> Column:
    """The leftmost non-overlapping matches of a base pattern that pass its check."""
    found = F.filter(_located(text, BASE[kind]), lambda x: _valid(kind, x["s"]))
    return F.when(_trigger(kind, text, False), found).otherwise(_none())


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def _features(number: int, kind: str, text: Column, x: Column) -> Column:
    """Format and context of a candidate, as doubles. What decides a base match (the plus, the
    checksum, the at sign) is left out, so that trees judge look-alikes by all else."""
    s = x["s"]
    before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
    after = F.substring(text, x["end"] + 1, CONTEXT)
    digits = F.length(_digits(s))
    values = [
        F.lit(number), F.length(s), digits, F.length(s) - digits,
        F.size(F.split(s, "[^0-9]+")), F.length(F.regexp_extract(s, "([0-9]+)$", 1)),
        F.length(F.regexp_extract(s, "^[^0-9]*([0-9]+)", 1)), s.rlike("[0-9]{5}").cast("int"), s.rlike("[0-9]{12}").cast("int"),
        F.length(s) - F.length(F.translate(s, ".", "")), F.length(s) - F.length(F.translate(s, "-", "")),
        F.length(s) - F.length(F.translate(s, " ", "")), F.length(s) - F.length(F.translate(s, "()", "")),
        F.length(s) - F.length(F.translate(s, ",/", "")), s.rlike(r"\.(?:com|org|net|edu|gov|info|[a-z]{2})$").cast("int"),
        s.rlike(r"\([0-9]{2,4}\)").cast("int"), before.rlike(CLUES[kind]).cast("int"),
        before.rlike("[0-9A-Za-z]$").cast("int"), before.rlike("[.,:=\"]$").cast("int"), after.rlike("^[0-9A-Za-z]").cast("int"),
        after.rlike("^[%$]").cast("int"), before.rlike("[$€£] ?$").cast("int"),
    ]
    return F.array(*[v.cast("double") for v in values])


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base spans of each kind, and ``loose``, the proposed spans.

    Proposals may overlap each other and base spans; ``hit`` says which overlap a base span of
    their kind. Nothing is shuffled.
    """
    text = F.col("text")
    read = docs.select("doc_id", whole_text().alias("text"))
    based = read.select("doc_id", "text", *[base_spans(text, k).alias(k) for k in KINDS])

    def proposed(number: int, kind: str) -> Column:
        found = F.transform(_located(text, GENERATORS[kind]), lambda x: F.struct(
            F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            _overlaps(F.col(kind), x).alias("hit"), _features(number, kind, text, x).alias("features")))
        none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,hit:boolean,features:array<double>>>)")
        return F.when(_trigger(kind, text, True), found).otherwise(none)

    return based.select(
        "doc_id", *[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS],
        F.concat(*[proposed(i, k) for i, k in enumerate(KINDS)]).alias("loose"))


def _tree(node, features: Column) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(features[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), features)).otherwise(
        _tree(node.rightChild(), features))


class Trees:
    """Boosted trees as a column expression, with a threshold for each kind (None: select nothing)."""

    def __init__(self, nodes: list, weights: list[float], thresholds: dict[int, float]):
        self.nodes, self.weights, self.thresholds = nodes, weights, thresholds

    def chance(self, features: Column) -> Column:
        total = sum((F.lit(float(w)) * _tree(n, features) for n, w in zip(self.nodes, self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))


def fitted(rows: DataFrame) -> Trees | None:
    """Trees from all proposals in ``rows`` (of ``candidates``); None without both classes.

    A proposal counts as personal data if it overlaps a base span of its kind. Proposals are dealt in two halves by a
    hash: one fits the trees, the other, which they have not seen, calibrates: a kind's threshold is the lowest at which
    ``PRECISION`` of at least ``LEAST_SEEN`` proposals above it are right. Equal features are one row with their number as its weight,
    and there are bins enough for trees to look for their splits in all of these.
    """
    every = rows.select("doc_id", F.explode("loose").alias("x")).select("doc_id", "x.*")
    half = F.pmod(F.xxhash64(F.lit("proposals"), "doc_id", "kind", "start"), F.lit(2))
    counted = written(every.groupBy(half.alias("fold"), "kind", F.col("hit").cast("int").alias("label"), "features").agg(
        F.count(F.lit(1)).alias("n")), "proposals")
    learn = counted.filter("fold = 0").select(
        array_to_vector("features").alias("features"), "label", F.col("n").cast("double").alias("weight"))
    counts = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    bins = max(LEAST_BINS, isqrt(sum(counts.values())) + 1)  # of fewer rows than its square the library takes no sample
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, labelCol="label", weightCol="weight", maxBins=bins).fit(learn)
    trees = Trees([t._java_obj.rootNode() for t in model.trees], list(model.treeWeights), {})
    judged = (
        counted.filter("fold = 1").select("kind", "label", "n", F.floor(trees.chance(F.col("features")) * 100).cast("int").alias("step"))
        .groupBy("kind", "step").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("all")).collect())
    for kind in range(len(KINDS)):
        right = seen = 0
        for row in sorted((r for r in judged if r["kind"] == kind), key=lambda r: -r["step"]):
            right, seen = right + row["right"], seen + row["all"]
            if seen >= LEAST_SEEN and right >= PRECISION * seen:
                trees.thresholds[kind] = max(0.5, row["step"] / 100)
    return trees


def _chosen(trees: Trees | None) -> Column:
    """Proposals that pass their threshold and touch no base span; of those that overlap, the likelier."""
    none = F.expr("cast(array() as array<struct<minus:double,kind:int,start:int,end:int>>)")
    if trees is None or not trees.thresholds:
        return none
    levels = [float(trees.thresholds.get(k, 2.0)) for k in range(len(KINDS))]

    def level(kind: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in levels]), kind + 1)

    free = F.filter("loose", lambda x: ~x["hit"] & ~_overlaps(F.concat(*[F.col(k) for k in KINDS]), x))
    judged = F.transform(free, lambda x: F.struct(
        (-trees.chance(x["features"])).alias("minus"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    passed = F.array_sort(F.filter(judged, lambda x: -x["minus"] >= level(x["kind"])))
    return F.aggregate(passed, none, lambda done, x: F.when(_overlaps(done, x), done).otherwise(F.concat(done, F.array(x))))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``.

    The counts and the digest are of base spans; ``spans`` also has the proposals selected by the
    trees, which never touch a base span. Both list kind:start:end by kind, then start.

    A missing text has no spans, and neither has an empty one; a missing id is kept; rows
    repeated whole have the same spans each; no rows give none. Other columns are not read.
    """
    rows = written(candidates(docs), "personal")
    trees = fitted(rows)
    with_added = rows.withColumn("added", _chosen(trees))

    def listed(spans: Column, number: int) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def text_of(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.concat(*[listed(F.col(k), i) for i, k in enumerate(KINDS)])
    added = F.transform("added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return with_added.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat(base, added))).alias("spans"), F.size("added").cast("long").alias("n_added"))
